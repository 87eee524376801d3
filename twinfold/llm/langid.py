"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

Subwords are byte n-grams of lengths ORDERS over the UTF-8 text, with A-Z lower-cased and every run of other ASCII
signs and digits taken as one space. The model is fitted with stochastic gradient descent on a bounded sample of
labelled rows (at most about SAMPLE rows, evenly by language); a part of it is held back to fit a temperature and the
score below which a prediction is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import give_back

ORDERS, BITS, DIM = (2, 3, 4), 16, 16
#: Rows that the model is fitted on, in all and for one language.
SAMPLE, PER_LANGUAGE = 6000, 500
#: Bytes that are learned from a text at most, so that the sample's size is bounded too: of a longer one a piece, from a place drawn by its id.
LONGEST = 1 << 16
#: Bytes of a text whose subwords are looked up together.
SLICE = 1 << 20
#: Share of held-back labelled texts that rejection may cost, and a score that is never rejected.
REJECT_SHARE, SURE = 0.002, 0.5
NONE = "und"
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORDLIKE = re.compile(r"[^\W\d_]")
_GOLD = np.uint32(2654435761)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def cleaned(text: str) -> np.ndarray:
    """The bytes whose n-grams are subwords: letters and signs beyond ASCII, one space between them and at either end."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(_CLEAN) + b" ", np.uint8)
    gap = data == 32
    return data[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]


def buckets(text: str) -> np.ndarray:
    """A bucket for every subword of the text."""
    return hashed(cleaned(text).astype(np.uint32))


def hashed(a: np.ndarray) -> np.ndarray:
    out, gram = [], a
    for n in range(2, max(ORDERS) + 1):
        if len(gram) < 2:
            break
        gram = gram[:-1] << np.uint32(8) | a[n - 1 :]
        if n in ORDERS:
            out.append((gram + np.uint32(n)) * _GOLD >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times output weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        a = cleaned(text)
        if len(a) <= SLICE:
            return self.table[hashed(a.astype(np.uint32))].mean(0) + self.bias
        # Of a long text subwords are counted a slice at a time; those that begin in the next slice are left to it.
        counts, over = np.zeros(len(self.table)), max(ORDERS) - 1
        for i in range(0, len(a), SLICE):
            counts += np.bincount(hashed(a[i : i + SLICE + over].astype(np.uint32)), minlength=len(counts))
            if len(tail := a[i + SLICE : i + SLICE + over]) > 1:
                counts -= np.bincount(hashed(tail.astype(np.uint32)), minlength=len(counts))
        return counts @ self.table / counts.sum() + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability after calibration, rejected."""
        if not isinstance(text, str) or not has_letter(text):
            return NONE, 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], labels: list[str], *, epochs: int = 4, rate: float = 0.3, seed: int = 1) -> Model:
    """Fit on labelled texts and on random cuts of them, which stand for short texts. A text's gradient is not divided among its subwords beyond its first (as if each stood once), so long texts move their subwords as much as short ones."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return Model([NONE], np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    held = rng.random(len(texts)) < 0.2
    rows = []
    for t, y, h in zip(texts, map(languages.index, labels), held):
        cut = int(rng.integers(0, max(1, len(t) - 20)))
        for piece in (t, t[cut : cut + int(rng.integers(20, 200))]):
            if has_letter(piece):
                ids, n = np.unique(buckets(piece), return_counts=True)
                rows.append((ids, (n / n.sum()).astype(np.float32), y, h, piece))
    train, check = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            ids, share, y, _, _ = train[k]
            hidden = share @ embed[ids]
            gradient = softmax(hidden @ out + bias)
            gradient[y] -= 1
            step = rate * (1 - done / steps)
            embed[ids] -= step * np.outer(np.minimum(1, share * len(ids)), out @ gradient)
            out -= step * np.outer(hidden, gradient)
            bias -= step * gradient
            done += 1
    model = Model(languages, (embed @ out).astype(np.float32), bias, 1.0, 0.0)
    if check:
        scores, right = np.array([model.logits(r[4]) for r in check]), np.array([r[2] for r in check])
        loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(right)), right] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))
        p = softmax(scores / model.temperature).max(-1)
        model.threshold = float(min(SURE, np.quantile(p, REJECT_SHARE)))
    return model


def labelled_sample(rows: DataFrame) -> DataFrame:
    """At most about SAMPLE rows of (text, lang), evenly by language, chosen by a hash of the id."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()}
    if not counts:
        return rows.limit(0)
    each = min(PER_LANGUAGE, SAMPLE // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(drawn < F.try_element_at(share, F.col("lang")))


def train(docs: DataFrame, *, doc="doc_id", text="text", lang="lang") -> Model:
    """Learn from labelled rows whose id doesn't fall in the held-out fold."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    most = LONGEST // 4  # code points
    place = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.lit(1), F.length("text") - most)).cast("int") + 1
    rows = rows.withColumn("text", F.when(F.octet_length("text") > LONGEST, F.substr("text", place, F.lit(most))).otherwise(F.col("text")))
    sample = labelled_sample(rows).select("text", "lang", "doc_id").where(F.col("text").isNotNull()).orderBy("doc_id", "text").toPandas()
    return fit(list(sample["text"]), list(sample["lang"]))


def held_out(doc) -> F.col:
    """Whether an id is in the held-out fold; a null id isn't in any fold and is never learned from."""
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, model: Model, *, text="text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected, which take the place of columns of these names. Null texts and texts without letters are `und` and rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    free = max(docs.columns, key=len, default="") + "_language"
    named = docs.withColumn(free, predict(F.col(text)))
    return named.withColumns({"lang_pred": named[free]["lang_pred"], "lang_score": named[free]["score"], "lang_rejected": named[free]["rejected"]}).drop(free)


def drop_unidentified(docs: DataFrame, *, doc="doc_id", text="text", lang="lang") -> DataFrame:
    """Rows of docs whose language is identified, all columns; texts without letters and rejected ones go."""
    model = train(docs, doc=doc, text=text, lang=lang)

    @F.pandas_udf("boolean")
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not model.predict(t)[2] for t in texts], dtype=bool)
        give_back()

    return docs.where(accepted(F.col(text)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the labelled ones outside the held-out fold; `und` and score 0 for texts without letters. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    named = identify(docs.select("doc_id", "text"), train(docs))
    return named.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
