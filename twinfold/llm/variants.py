"""Spelling variants of a vocabulary by a reduced alphabet.

Letters are hashed to a few symbols, so that words become reduced words, of which there are fewer. The one-edit
neighbourhood of every reduced word is generated and joined with the reduced vocabulary; the words behind two reduced words
that meet are compared as they are. Two words that differ by one edit have reduced words that are equal or differ by one
edit, so none is missed. Of an insertion and a deletion, and of a replacement and its reverse, one is generated: the pair meets in it, and is then
taken both ways. Neighbours are named by 64-bit polynomial hashes that follow from their word's in one step each, so a word of any length costs rows
in proportion to its length, and a hash that stands for two neighbours only adds a pair that the comparison refuses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, settle
from .text import UPPER, ascii_lower, mix

SHORTEST, LEAST, RATIO = 7, 2, 10
#: The noise of op13: one run in so many loses a letter.
NOISE = 31
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
RUN = r"[A-Za-zÀ-ÿ]+"
#: Neighbours that a task makes at once.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def symbols_for(words: int) -> int:
    """How many symbols: so many that the shortest reduced words are about as many as the words."""
    return max(4, min(64, int(np.ceil(max(1, words) ** (1 / SHORTEST)))))


def reduced(word: Column, symbols: int) -> Column:
    """The word with every letter replaced by its symbol; other signs share one."""
    of = lambda c: chr(ord("0") + int(mix(np.array([ord(c)], np.uint64))[0] % np.uint64(symbols)))
    return F.translate(F.regexp_replace(word, f"[^{LETTERS}]", "a"), LETTERS, "".join(map(of, LETTERS)))


def neighbour_keys(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, key) of each reduced word, its deletions and its replacements by larger symbols, in slices."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer("".join(words).encode("ascii"), np.uint8).astype(np.uint64) - np.uint64(ord("0") - 1)
    start = np.repeat(ends - sizes, sizes)
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(sizes.max(initial=0)), _BASE, np.uint64))))
    at = power[np.arange(len(data)) - start]
    worth = data * at
    sums = np.concatenate(([np.uint64(0)], np.cumsum(worth, dtype=np.uint64)))
    before = sums[:-1] - np.repeat(sums[ends - sizes], sizes)
    whole = sums[ends] - sums[ends - sizes]
    name = lambda h, n: mix(h + mix(n.astype(np.uint64))).view(np.int64)
    yield np.arange(len(words)), name(whole, sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    last = np.append(data[1:] != data[:-1], True)[: len(data)]
    last[ends[sizes > 0] - 1] = True
    for i in range(0, len(data), SLICE):
        part = slice(i, i + SLICE)
        o, value, total = owner[part], data[part], whole[owner[part]]
        n = sizes[o]
        one = last[part]  # of equal letters in a row one is deleted
        cut = before[part] + (total - before[part] - worth[part]) * _INVERSE
        yield o[one], name(cut[one], n[one] - 1)
        for c in range(2, symbols + 1):
            larger = value < c
            yield o[larger], name(total[larger] + (np.uint64(c) - value[larger]) * at[part][larger], n[larger])


def neighbours(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """key, r of the reduced words (r): of each itself, its deletions and its replacements by larger symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                part = pdf["r"].iloc[i : i + 4096].to_numpy()
                for owner, key in neighbour_keys(list(part), symbols):
                    yield pd.DataFrame({"key": key, "r": part[owner]})

    return vocabulary.mapInPandas(run, "key long, r string")


def own_keys(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """key, r of the reduced words alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, key = next(neighbour_keys(list(pdf["r"]), symbols))
            yield pd.DataFrame({"key": key, "r": pdf["r"]})

    return vocabulary.mapInPandas(run, "key long, r string")


def near_words(counts: DataFrame, *, symbols: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """word, n, other, m: pairs of words (word, n) that differ by exactly one inserted, deleted or replaced code point, both ways."""
    scratch = scratch or Scratch(counts.sparkSession)
    symbols = symbols or symbols_for(counts.count())
    named = scratch.settle(counts.select("word", "n", reduced(F.col("word"), symbols).alias("r")), "reduced")
    vocabulary = scratch.settle(named.select("r").distinct(), "vocabulary")
    met = neighbours(vocabulary, symbols).join(own_keys(vocabulary, symbols).withColumnRenamed("r", "r2"), "key").select("r", "r2")
    met = scratch.settle(met, "met")
    pairs = met.join(named, "r").join(named.select(F.col("r").alias("r2"), F.col("word").alias("other"), F.col("n").alias("m")), "r2")
    pairs = pairs.where((F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1))
    # Words of one reduced word meet both ways by themselves.
    ways = F.when(F.col("r") == F.col("r2"), F.array(F.struct("word", "n", "other", "m"))).otherwise(F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))))
    return pairs.select(F.explode(ways).alias("p")).select("p.*")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of words that have a form (word, form): forms are followed to the last, twice as far each round."""
    now = scratch.settle(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = scratch.settle(now.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(counts: DataFrame, *, ratio: int = RATIO, symbols: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of counts (word, n).

    n_near counts the words at one edit. form is the most frequent of them (ties: the first in code-point order) if it
    occurs `ratio` times as often; counts grow along forms, so following them ends. Null words and counts are left out; words must be distinct
    (word_counts gives them so). Columns beside word and n don't matter; an empty table gives none.
    """
    scratch = Scratch(counts.sparkSession)
    counts = scratch.settle(counts.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word is not null and n is not null"), "words")
    near = near_words(counts, symbols=symbols, scratch=scratch)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    out = counts.join(best, "word", "left")
    enough = -F.col("best.m") >= ratio * F.col("n")
    formed = scratch.settle(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).cast("long").alias("form_n")), "forms")
    last = roots(formed.where("form is not null"), scratch)
    found = settle(formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    scratch.clear()
    return found


def runs(docs: DataFrame, *, doc="doc_id", text="text") -> DataFrame:
    """doc (its id as text, empty for null), run: maximal runs of letters of every text, A-Z lower-cased; null texts have none."""
    name = F.coalesce(F.col(doc).cast("string"), F.lit(""))
    each = docs.select(name.alias("doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    return each.select("doc", ascii_lower(F.col("run")).alias("run"))


def noisy(found: DataFrame, every: int = NOISE) -> DataFrame:
    """run: runs (doc, run), of which those whose crc32 of `<doc>:<run>` is divisible by `every` have lost the code point at its remainder by their length."""
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("_h"), F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    return found.where(F.length("run") >= SHORTEST).withColumn("_h", h).select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("run")).alias("run"))


def word_counts(found: DataFrame, *, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n of runs (run) of at least `shortest` code points that occur `least` times or more."""
    long = found.where(F.length("run") >= shortest)
    return long.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one letter dropped from one run in 31, with their near words, forms and roots; see variants. Null texts have no words, null ids count as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(word_counts(noisy(runs(docs))))


_TABLE = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
OP13_SQL = f"""WITH RECURSIVE step AS (SELECT unnest(range(256)) AS i, unnest(range(256))::BIGINT AS c, 0 AS k UNION ALL SELECT i, {_TABLE}, k + 1 FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{UPPER.lower()}') AS run FROM documents),
each_run AS (SELECT doc, run, count(*) AS k FROM found WHERE length(run) >= {SHORTEST} GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM each_run),
hashed AS (SELECT doc, run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x: xor(t[xor(h & 255, x) + 1], h >> 8)), 4294967295) AS h FROM bytes, crc),
dropped AS (SELECT k, CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM dropped WHERE length(word) >= {SHORTEST} GROUP BY 1 HAVING sum(k) >= {LEAST}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masks AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS m FROM places),
cuts AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS m FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM masks a JOIN masks b ON a.m = b.m AND a.word <> b.word
UNION ALL SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.m UNION ALL SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.m),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= {RATIO} * w.n THEN best.m END AS form_n FROM words w LEFT JOIN best USING (word)),
formed AS MATERIALIZED (SELECT f.word, f.n, f.n_near, f.form_n, min(near.other) AS form FROM form f LEFT JOIN near ON near.word = f.word AND near.m = f.form_n GROUP BY ALL),
walk AS (SELECT word, word AS spot, 0 AS d FROM formed UNION ALL SELECT w.word, f.form, d + 1 FROM walk w JOIN formed f ON f.word = w.spot WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(spot, d) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed JOIN walk USING (word) GROUP BY ALL"""
