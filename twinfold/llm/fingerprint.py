"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is WIDTH consecutive bytes of the UTF-8 text (the whole text if shorter; an empty text has none).
The sketch holds the K smallest distinct 48-bit hashes, as base64 of six little-endian bytes each, ascending.
Sketches of parts merge into the sketch of the whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import partitions
from .text import mix

WIDTH, K = 12, 128
SPACE = 1 << 48
_MASK = np.uint64(SPACE - 1)
#: Documents that a part of their order is planned for, and ids that are drawn for each part to plan by.
ROWS, DRAWN = 50_000, 60


def shingle_hashes(data: bytes) -> np.ndarray:
    """48-bit hashes of all shingles, repeats included."""
    if not data:
        return np.empty(0, np.uint64)
    if len(data) < WIDTH:
        data = data.ljust(WIDTH, b"\0")
    h = np.frombuffer(data, np.uint8).astype(np.uint64)
    h = h[:-1] | h[1:] << np.uint64(8)
    h = h[:-2] | h[2:] << np.uint64(16)
    return mix(mix(h[:-8] | h[4:-4] << np.uint64(32)) + h[8:]) & _MASK


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(hashes) > 8 * k:
        few = np.unique(hashes[hashes <= np.uint64(SPACE * 3 * k // len(hashes))])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K) -> np.ndarray:
    return bottom(shingle_hashes((text or "").encode("utf-8", "surrogatepass")), k)


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([raw, np.zeros((len(raw), 2), np.uint8)], 1).copy().view("<u8").reshape(-1)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) / (float(s[k - 1]) / SPACE)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of two sketches; two empty ones are alike."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum() / len(both))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    own = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / own) if own else 1.0


def fingerprints(docs: DataFrame, *, doc="doc_id", text="text", k: int = K) -> DataFrame:
    """doc_id, n_chars, fingerprint, n_shingles (estimate) of each row; null counts as empty."""

    @F.pandas_udf("fingerprint string, n_shingles double")
    def taken(texts: pd.Series) -> pd.DataFrame:
        found = [sketch(t, k) for t in texts]
        return pd.DataFrame({"fingerprint": [to_text(s) for s in found], "n_shingles": [distinct(s, k) for s in found]})

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), taken("text").alias("s")).select("doc_id", "n_chars", "s.fingerprint", "s.n_shingles")


def merge_fingerprints(parts: DataFrame, by: str, *, fingerprint="fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per value of `by` (by, fingerprint, n_shingles). Tasks merge what they hold before the shuffle, so that a frequent value costs a row a task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: dict = {}
            for key, s in zip(pdf["key"], pdf["fingerprint"]):
                held[key] = merge(held[key], from_text(s), k) if key in held else from_text(s)
            yield pd.DataFrame({"key": list(held), "fingerprint": [to_text(s) for s in held.values()]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.empty(0, np.uint64)
        for s in pdf["fingerprint"]:
            whole = merge(whole, from_text(s), k)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "fingerprint": [to_text(whole)], "n_shingles": [distinct(whole, k)]})

    kind = dict(parts.dtypes)[by]
    few = parts.select(F.col(by).alias("key"), F.col(fingerprint).alias("fingerprint")).mapInPandas(partial, f"key {kind}, fingerprint string")
    return few.groupBy("key").applyInPandas(final, f"key {kind}, fingerprint string, n_shingles double").withColumnRenamed("key", by)


def with_next(docs: DataFrame, visit, schema: str, *, doc="doc_id", text="text") -> DataFrame:
    """visit(rows of (doc_id, text, next text)) over documents in descending order of id; after the last comes the first.

    The order is cut into parts of about ROWS documents at ids of real documents, drawn by a hash (DRAWN for each part come to the
    driver, 8 bytes each). Each part is a task of its own, and its first document is also sent to the part before it, so the
    texts move once and no task sees more than its part. Null ids come last, equal ids go by text and stay in one part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = rows.where("doc_id is not null").select("doc_id")
    total, top = ids.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    n = max(2 * partitions(spark), -(-total // ROWS))
    share = min(1.0, n * DRAWN / max(1, total))
    drawn = np.sort(np.array([r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).distinct().collect()], np.int64))
    bounds = np.unique(np.append(drawn[[len(drawn) * i // n for i in range(1, n)]] if len(drawn) else drawn, np.int64(top or 0)))
    shared = spark.sparkContext.broadcast(bounds)
    last = len(bounds) - 1

    @F.pandas_udf("part int, first boolean")
    def deal(ids: pd.Series, there: pd.Series) -> pd.DataFrame:
        """The part of each id, counted from the largest, and whether the id is the part's first."""
        known = shared.value
        at = np.minimum(np.searchsorted(known, ids.to_numpy(np.int64)), last)
        return pd.DataFrame({"part": np.where(there, last - at, last), "first": there & (known[at] == ids)})

    dealt = rows.withColumn("_deal", deal(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNotNull()))
    # Without any id the part before the first is that of the null ids itself, and any of them may be its first.
    part, first = F.col("_deal.part"), F.col("_deal.first") if top is not None else F.lit(True)
    own = F.struct(part.alias("part"), F.lit(False).alias("extra"))
    sent = F.struct(F.when(part == 0, last).otherwise(part - 1).alias("part"), F.lit(True).alias("extra"))
    placed = dealt.withColumn("to", F.explode(F.when(first, F.array(own, sent)).otherwise(F.array(own))))
    dealt = placed.select("to.part", "to.extra", "doc_id", "text").repartitionById(last + 1, "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text")
    dealt = dealt.select("part", "extra", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            ready = []
            for p, extra, d, there, t in zip(pdf["part"], pdf["extra"], pdf["doc_id"].tolist(), pdf["named"], pdf["text"]):
                t, d = t if isinstance(t, str) else "", d if there else None
                if held and held[0] == p:
                    ready.append((held[1], held[2], t))
                held = None if extra else (p, d, t)
            if ready:
                yield visit(ready)

    return dealt.mapInPandas(run, schema)


FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(rows: list[tuple]) -> pd.DataFrame:
    out, ahead, ahead_sketch = [], None, None
    for d, t, after in rows:
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own = ahead_sketch if t is ahead else sketch(t)
        ahead, ahead_sketch, changed = after, sketch(after), sketch(edited)
        out.append((d, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(changed), resemblance(own, changed), resemblance(own, ahead_sketch)))
    pdf = pd.DataFrame(out, columns=[c.split()[0] for c in FINGERPRINTED.split(", ")])
    return pdf.assign(doc_id=pd.array([r[0] for r in out], "Int64"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints of every document and of its text edited with that of the next one; null texts are empty, whose sketches are empty and alike."""
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), _edited, FINGERPRINTED)
