"""MinHash near-duplicates by an inverted join on signature coordinates, confirmed on full shingle sets.

A signature has COORDS coordinates; each is a hash of ROWS minima over the document's shingles, so that two sets
of similarity s agree in a coordinate with probability s ** ROWS. Documents are posted under (coordinate, value).
A pair that agrees in at least MATCH coordinates meets in the first COORDS - MATCH + 1, so only these are posted.
Agreements of the pairs that meet are counted over whole signatures, and those with MATCH or more are confirmed
on full sets. With 24 coordinates of 3 minima and MATCH 2 a pair of similarity 0.8 is missed once in a million.

Equal sets are one node. In a first round each posting list is joined with its most central node only, the one whose
lists are longest in all; what this links becomes components. Nodes of lists that still hold several components are
then joined by an exact prefix filter on their shingles, rarest first, with bounds from the place of the common shingle
and from the shingles that no other such node has. So a group of copies costs rows in proportion to its size,
and no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, settle
from .text import give_back, mix, space_words

WIDTH, PERCENT = 5, 80
COORDS, ROWS, MATCH = 24, 3, 2
#: Most ids that are broadcast, 8 bytes each, to pick documents; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Pairs of one document that are confirmed in one place; those of a document with more are dealt to several.
HUB = 256
_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(1, 2**63, COORDS * ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(1, 2**63, COORDS * ROWS, dtype=np.int64).astype(np.uint64)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; fewer words than width make one shingle, no word makes none."""
    words, counts = space_words([t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts])
    joined = words
    for _ in range(width - 1):  # entries that reach into the next text aren't used
        joined = joined[:-1] * _A + words[len(words) - len(joined) + 1 :] if len(joined) > 1 else joined[:0]
    joined = mix(joined)
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(joined[at : at + n - width + 1]))
        elif n:
            h = np.array([n], np.uint64) * _B
            for w in words[at : at + n]:
                h = h * _A + w
            out.append(mix(h))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Coordinates (texts x COORDS) of non-empty sets."""
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDS), np.uint64)
    for c in range(COORDS):
        h = np.full(len(sets), c, np.uint64)
        for r in range(c * ROWS, (c + 1) * ROWS):
            h = mix(h + np.minimum.reduceat(every * _FACTORS[r] + _SHIFTS[r], starts))
        out[:, c] = h
    return out


def sign(docs: DataFrame, width: int, *, doc="doc_id", text="text") -> DataFrame:
    """doc_id, n (set size), set_a, set_b (a 128-bit name of the set), signature (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # few texts become Python objects together
                part = batch.slice(i, 64)
                sets = shingle_sets(part.column("text").to_pylist(), width)
                full = [s for s in sets if len(s)]
                found = iter(signatures(full).view(np.int64) if full else ())
                name = [(mix(s ^ _A).sum(dtype=np.uint64), mix(s ^ _B).sum(dtype=np.uint64)) for s in sets]
                set_a, set_b = (np.array([x[k] for x in name], np.uint64).view(np.int64) for k in (0, 1))
                signed = pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_a), pa.array(set_b), signed], names=["doc_id", "n", "set_a", "set_b", "signature"])
        give_back()

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, set_a long, set_b long, signature array<long>")


def alike(n: str, m: str, percent: int):
    """Sizes that allow the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def picked(docs: DataFrame, ids: DataFrame, doc: str, text: str, scratch: Scratch) -> DataFrame:
    """id, text of the documents with these ids."""
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    ids = scratch.settle(ids, "picked")
    return rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, "id", "left_semi")


def counted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in MATCH coordinates or more."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}"))
    both = pairs.distinct().join(side("b"), "b").join(side("a"), "a")
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.where(equal >= MATCH).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, *, doc="doc_id", text="text") -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets (64-bit hashes of shingles) of the documents they name.

    The pairs of a document stand behind it in one place, or in several of about HUB pairs, so its text is sent once for
    each place and not for each pair.
    """
    pairs = scratch.settle(pairs, "pairs")
    rows = picked(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), doc, text, scratch)
    hubs = scratch.settle(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("places")), "hubs")
    heads = hubs.select("a", F.explode(F.sequence(F.lit(1), "places")).alias("place")).join(rows.withColumnRenamed("id", "a"), "a").select("a", "place", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("b"), "text")
    keyed = pairs.join(hubs, "a").select("a", (F.pmod(F.xxhash64("b"), F.col("places")) + 1).cast("int").alias("place"), F.lit(1).alias("kind"), "b")
    rest = keyed.join(rows.withColumnRenamed("id", "b"), "b").select("a", "place", "kind", "b", "text")
    dealt = heads.unionByName(rest).repartition("a", "place").sortWithinPartitions("a", "place", "kind", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                for a, place, kind, b, s in zip(part["a"].tolist(), part["place"].tolist(), part["kind"], part["b"].tolist(), shingle_sets(list(part["text"]), width)):
                    if kind == 0:  # an id may stand for several texts
                        held = [*held, s] if at == (a, place) else [s]
                        at = a, place
                        continue
                    common = [(len(np.intersect1d(h, s, assume_unique=True)), len(h)) for h in held]
                    if any(n and 100 * n >= percent * (size + len(s) - n) for n, size in common):
                        out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])
        give_back()

    return dealt.mapInPandas(run, "a long, b long")


def prefix_pairs(nodes: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, *, doc="doc_id", text="text") -> DataFrame:
    """Pairs (a, b) of nodes (node, component) in different components that may be similar; none that is similar is missing.

    With shingles ordered from rare to frequent, a similar pair has a common one in the first n - ceil(2p/(100+p) n) + 1
    of the smaller set and the first m - ceil(p/100 m) + 1 of the larger. If the first common one stands at i and j,
    the sets share 1 + min(n - i - 1, m - j - 1) at most; and never more than what other nodes share with each.
    """
    nodes = scratch.settle(nodes, "rest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                sets = shingle_sets(list(part["text"]), width)
                yield pd.DataFrame({"node": part["id"], "h": [x.view(np.int64) for x in sets]})

    sets = picked(docs, nodes.select(F.col("node").alias("id")), doc, text, scratch).mapInPandas(run, "node long, h array<long>")
    sets = scratch.settle(sets.select("node", F.array_distinct("h").alias("h"), F.size("h").alias("n")).dropDuplicates(["node"]), "rest-sets")
    each = sets.select("node", F.explode("h").alias("h"))
    alone = each.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    core = nodes.join(sets.select("node", "n"), "node").join(alone, "node", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("most") * 100 >= F.col("n") * percent)
    core = scratch.settle(core.select("node", "component", "most"), "core")
    few = F.broadcast(core) if core.count() <= MAX_BROADCAST else core
    held = sets.join(few, "node").select("node", "component", "n", "most", F.explode("h").alias("h"))
    ranked = held.join(held.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "h")
    # Shingles of one node only come first in its order and meet nobody; places are counted from behind them.
    ordered = ranked.groupBy("node", "component", "n", "most").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("order"))
    own = F.col("n") - F.size("order")
    wide = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    narrow = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    rows = scratch.settle(ordered.select("node", "component", "n", "most", narrow.alias("narrow"), own.alias("own"), F.posexplode(F.slice("order", F.lit(1), F.greatest(F.lit(0), (wide - own).cast("int")))).alias("p", "s")), "prefixes")
    rows = rows.select("node", "component", "n", "most", "narrow", (F.col("own") + F.col("p")).alias("at"), F.col("s.h").alias("h"))
    small = rows.where(F.col("at") < F.col("narrow")).withColumnsRenamed({c: f"{c}_" for c in rows.columns if c != "h"})
    after = (F.col("n") > F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("node") > F.col("node_")))
    common = F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_"), F.col("most"), F.col("most_"))
    enough = common * (100 + percent) >= (F.col("n") + F.col("n_")) * percent
    met = small.join(rows, "h").where((F.col("component") != F.col("component_")) & after & alike("n", "n_", percent) & enough)
    return met.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """node, component (smallest node reachable) of every node with an edge. Labels take the least of their neighbours', then of the node they point to, until nothing changes."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = scratch.settle(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = scratch.settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        drawn = labels.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.least("label", "near").alias("to"), "label")
        head = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        moved = scratch.settle(drawn.join(head, "to", "left").select("node", F.least("to", "beyond").alias("label"), F.col("label").alias("was")), name)
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("was")).isEmpty():
            return labels.withColumnRenamed("label", "component")


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, doc="doc_id", text="text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for every row; component_id is the smallest linked doc_id, kept where it is its own.

    Null and empty texts have no shingles and are linked with nothing. Rows without an id are linked with nothing, have
    no component and are kept. Rows that share an id and a set are alike in all columns; rows that share an id and
    differ in text are nodes of their own unless the id stands for both sets, which links them.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.settle(sign(docs, width, doc=doc, text=text), "signed")
    named = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    nodes = scratch.settle(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("signature").alias("signature")), "nodes")
    posted = nodes.select("node", "n", F.posexplode(F.slice("signature", 1, COORDS - MATCH + 1)).alias("c", "value")).select(F.xxhash64("c", "value").alias("list"), "node", "n")
    # Facts of lists are tables of their own, so that a long list's postings can be split where they meet them.
    sizes = scratch.settle(posted.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = scratch.settle(posted.join(sizes, "list"), "shared")
    central = shared.join(shared.groupBy("node").agg(F.sum("size").alias("score")), "node")
    heads = scratch.settle(central.groupBy("list").agg(F.max(F.struct("score", (-F.col("node")).alias("first"), "node", "n")).alias("head")), "heads")
    lists = scratch.settle(shared.select("list", "node", "n").join(heads, "list"), "lists")
    first = lists.where((F.col("node") != F.col("head.node")) & alike("n", "head.n", percent)).select(F.col("head.node").alias("a"), F.col("node").alias("b"))
    edges = scratch.settle(confirmed(counted(first, nodes), docs, width, percent, scratch, doc=doc, text=text), "edges")
    known = components(edges, scratch)

    placed = lists.join(known, "node", "left").select("list", "node", F.col("head.node").alias("head"), F.coalesce("component", "node").alias("component"))
    open_lists = scratch.settle(placed.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("list"), "open")
    rest = placed.where("node != head").join(open_lists, "list", "left_semi").groupBy("node").agg(F.first("component").alias("component"))
    more = scratch.settle(confirmed(prefix_pairs(rest, docs, width, percent, scratch, doc=doc, text=text), docs, width, percent, scratch, doc=doc, text=text), "edges")
    if not more.isEmpty():
        known = components(edges.unionByName(more), scratch)

    whole = nodes.select("set_a", "set_b", "node").join(known, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n", "set_a", "set_b").join(whole, ["set_a", "set_b"], "left")
    component = F.when(F.col("n") > 0, F.least("doc_id", "component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    found = settle(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near")
    scratch.clear()
    return found


def drop_near_duplicates(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, doc="doc_id", text="text") -> DataFrame:
    """Rows of docs, all columns, of which each class keeps the one with its smallest id; of equal rows of that id one stays."""
    found = near_duplicates(docs, width=width, percent=percent, doc=doc, text=text)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    few = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone
    kept = docs.join(few, docs[doc] == few["_gone"], "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    named = kept.where(F.col(doc).isNotNull()).dropDuplicates([doc, text])
    return named.unionByName(kept.where(F.col(doc).isNull()))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of four-word shingles, component and whether it is kept; see near_duplicates for nulls, empty texts and repeated rows."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)
