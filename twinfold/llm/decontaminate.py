"""Benchmark decontamination by word windows (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .text import alnum_words

WIDTH = 10
#: Most bytes of benchmark windows that are broadcast; beyond it the join shuffles.
MAX_BROADCAST = 64 << 20
#: Most documents whose ids are broadcast to take them out.
MAX_GONE = 500_000
#: Words that a window is first looked up by, and parts that a frequent window's occurrences are dealt to when they are shuffled.
LEAD, SALTS = 3, 16


def benchmark_windows(items: DataFrame, width: int = WIDTH, *, item="item_id", text="text") -> DataFrame:
    """item, n, window, key: every distinct window of every item; an item of fewer words is one window."""
    words = items.select(F.col(item).alias("item"), alnum_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    sized = words.withColumn("n", F.least(F.size("words"), F.lit(width)))
    spots = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.slice("words", i, F.col("n")))
    each = sized.select("item", "n", F.explode(F.array_distinct(spots)).alias("window"))
    return each.distinct().withColumn("key", F.xxhash64("n", "window"))


def find_hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, *, doc="doc_id", text="text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, hits (array of pos, n, item), positions from 0.

    Each word is hashed once. Places whose first LEAD words begin a benchmark window are found in a hash set of these, and
    the whole window is then looked up and compared word by word. Where the windows are too large to broadcast, all windows of
    the documents are joined by a shuffle, dealt to SALTS parts each.
    Rows are told apart by id and a hash of the text; equal rows come back as often as they were given. Null ids and texts are
    kept, a null or empty text has no words; an empty benchmark hits nothing.
    """
    windows = settle(benchmark_windows(items, width), "windows")
    bytes_of = F.length(F.array_join("window", " ")) * 2 + F.length(F.col("item").cast("string")) + 100
    total, sizes = windows.agg(F.coalesce(F.sum(bytes_of), F.lit(0)), F.array_sort(F.collect_set("n"))).first()  # at most `width` sizes
    base = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_key"), alnum_words(F.col(text)).alias("words"))
    # The first entry of each document stands for the document itself and matches nothing.
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.xxhash64("doc_id", "text_key").alias("first")))
    build = windows.select(F.col("key").alias("of"), F.col("n").alias("size"), F.col("window").alias("wanted"), "item")
    here = F.slice("words", F.col("pos") + 1, F.col("n"))
    if total <= max_broadcast:
        leads = sorted({min(n, LEAD) for n in sizes})
        coded = base.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))

        def places(n: int) -> Column:
            at = lambda c, i: F.struct(i.alias("pos"), F.xxhash64(F.lit(n), c, *[F.col("codes")[i + k] for k in range(1, n)]).alias("first"))
            return F.when(F.size("codes") >= n, F.transform(F.slice("codes", F.lit(1), F.size("codes") - n + 1), at)).otherwise(F.slice(own, 1, 0))

        spread = coded.select("doc_id", "text_key", "words", F.explode(F.concat(own, *map(places, leads))).alias("at"))
        begin = F.transform(F.slice("window", F.lit(1), F.least("n", F.lit(LEAD))), lambda w: F.xxhash64(w))
        firsts = [windows.where(F.least("n", F.lit(LEAD)) == n).select(F.xxhash64(F.lit(n), *[begin[k] for k in range(n)]).alias("lead"), "n").distinct() for n in leads]
        known = windows.select(F.lit(0).cast("long").alias("lead"), "n").limit(0)
        for f in firsts:
            known = known.unionByName(f)
        began = spread.select("doc_id", "text_key", "words", "at.pos", "at.first").join(F.broadcast(known), F.col("first") == F.col("lead"), "left")
        began = began.where((F.col("pos") < 0) | (F.col("n").isNotNull() & (F.col("pos") + F.col("n") <= F.size("words"))))
        keyed = began.withColumn("window", F.when(F.col("pos") >= 0, here)).withColumn("key", F.when(F.col("pos") < 0, F.col("first")).otherwise(F.xxhash64("n", "window")))
        met = keyed.join(F.broadcast(build), (F.col("key") == F.col("of")) & (F.col("n") == F.col("size")) & (F.col("window") == F.col("wanted")), "left")
    else:
        salt = lambda: F.pmod(F.xxhash64("doc_id", "text_key", "at.pos"), F.lit(SALTS)).cast("int").alias("salt")

        def spots(n: int) -> Column:
            at = lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"))
            return F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), at)).otherwise(F.array().cast("array<struct<pos:int,n:int>>"))

        mine = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("n")))
        spread = base.select("doc_id", "text_key", "words", F.explode(F.concat(mine, *map(spots, sizes))).alias("at"))
        # What is shuffled has its own words only, not the document's.
        keyed = spread.select("doc_id", "text_key", F.when(F.col("at.pos") < 0, F.size("words")).alias("n_words"), salt(), "at.pos", "at.n", F.when(F.col("at.pos") >= 0, F.slice("words", F.col("at.pos") + 1, F.col("at.n"))).alias("window"))
        keyed = keyed.withColumn("key", F.xxhash64("n", F.coalesce("window", F.array(F.col("doc_id").cast("string"), F.col("text_key").cast("string")))))
        dealt = build.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.join(dealt, (F.col("key") == F.col("of")) & (F.col("salt") == F.col("part")) & (F.col("n") == F.col("size")) & (F.col("window") == F.col("wanted")), "left")
    hit = F.when(F.col("wanted").isNotNull(), F.struct("pos", "n", "item"))
    words = F.when(F.col("pos") < 0, F.size("words") if total <= max_broadcast else F.col("n_words"))
    seen = met.where((F.col("pos") < 0) | F.col("wanted").isNotNull()).select("doc_id", "text_key", words.alias("n_words"), hit.alias("hit"))
    grouped = seen.groupBy("doc_id", "text_key").agg(F.max("n_words").cast("long").alias("n_words"), F.count("n_words").cast("int").alias("copies"), F.collect_set("hit").alias("hits"))
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def hit_words(hits: Column) -> Column:
    """Number of words inside any hit, by a sweep over hits in order of place."""

    def step(at: Column, h: Column) -> Column:
        end = h["pos"] + h["n"]
        new = F.greatest(F.lit(0), end - F.greatest(at["end"], h["pos"]))
        return F.struct((at["sum"] + new).alias("sum"), F.greatest(at["end"], end).alias("end"))

    return F.aggregate(F.array_sort(hits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")), step)["sum"].cast("long")


def hit_items(hits: Column) -> Column:
    """Item ids of the hits as text, each once, in text order."""
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item"].cast("string"))))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, *, doc="doc_id", text="text") -> DataFrame:
    """Rows of docs without any hit; all columns stay. Documents stay where they are unless MAX_GONE or more are hit."""
    found = find_hits(docs, items, width, doc=doc, text=text).where(F.size("hits") > 0).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    found = settle(found, "contaminated")
    gone = F.broadcast(found) if found.count() <= MAX_GONE else found
    return docs.join(gone, docs[doc].eqNullSafe(gone["_doc"]) & (F.xxhash64(docs[text]) == gone["_key"]), "left_anti")


def cut_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH, *, doc="doc_id", text="text") -> DataFrame:
    """Documents' ids with their normalised words outside hits, joined by spaces: the gentler remedy."""
    words = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("text_key"), alnum_words(F.col(text)).alias("words")).distinct()
    found = find_hits(docs, items, width, doc=doc, text=text)
    joined = found.join(words.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"}), found.doc_id.eqNullSafe(F.col("_d")) & (found.text_key == F.col("_k")))
    keep = F.filter("words", lambda w, i: ~F.exists("hits", lambda h: (i >= h["pos"]) & (i < h["pos"] + h["n"])))
    return joined.select("doc_id", F.array_join(keep, " ").alias("text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = found.select("doc_id", "n_words", hit_words(F.col("hits")).alias("n_hit"), hit_items(F.col("hits")).alias("items"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, rid, i, n, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, ns WHERE len(words) >= n)),
hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
