"""Exact groups, greedy leader clusters and the election of originals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import name_prefix, pixels
from ..session import Scratch, settle
from .hamming import distance, distinct_hashes, hash_pairs, parse_phash, self_pairs
from .mutations import assign_ids

#: Rounds of leader clusters before components are decided alone, and edges of a component that one task decides.
ROUNDS, SMALL = 8, 1_000_000
#: Hashes of the first batch of leader clusters, and pairs of a batch that are decided in one task.
BATCH, EDGES = 1 << 15, 1_000_000


def exact_groups(files: DataFrame) -> DataFrame:
    """file_id, cluster (smallest file_id) of files that share their content with another."""
    known = files.where("hash_sha256 is not null")
    groups = known.groupBy("hash_sha256").agg(F.min("file_id").alias("cluster"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(groups, "hash_sha256").select("file_id", "cluster")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (smallest node reachable) of edges (low, high). Labels take the least of their neighbours' and then of the node they point to, so a chain is done in about as many rounds as its length has digits."""
    both = scratch.settle(edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select("high", "low")).distinct(), "both")
    labels = scratch.settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        drawn = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), "label")
        beyond = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        moved = scratch.settle(drawn.join(beyond, "to", "left").select("node", F.least("to", "beyond").alias("label"), F.col("label").alias("was")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")


def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """The leaders of one component's edges (low, high), in rank order."""
    ahead: dict[int, list[int]] = {}
    for low, high in zip(pdf["low"].tolist(), pdf["high"].tolist()):
        ahead.setdefault(low, []).append(high)
    claimed, out = set(), []
    for node in sorted({*pdf["low"].tolist(), *pdf["high"].tolist()}):
        if node not in claimed:
            out.append(node)
            claimed.update(ahead.get(node, ()))
    return pd.DataFrame({"node": out})


def leaders(edges: DataFrame) -> DataFrame:
    """leader, member (ranks) of greedy clusters, for every rank that has an edge (low, high); leaders are members of their own.

    In rank order an unclaimed hash becomes leader and claims every unclaimed neighbour. A round decides all hashes whose
    lower neighbours are decided. What is open after ROUNDS, long chains of decisions, is cut into components; those of up to
    SMALL edges are decided in one task each, and rounds go on for larger ones.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.settle(edges.select("low", "high").distinct(), "pairs")
    open_nodes = scratch.settle(edges.select(F.col("low").alias("node")).union(edges.select("high")).distinct(), "open")
    open_edges, chosen, rounds = edges, open_nodes.limit(0), 0
    while not open_nodes.isEmpty():
        new = scratch.settle(open_nodes.join(open_edges.select(F.col("high").alias("node")), "node", "left_anti"), "leaders")
        chosen = chosen.unionByName(new)
        claimed = open_edges.join(new.withColumnRenamed("node", "low"), "low", "left_semi").select(F.col("high").alias("node")).distinct()
        open_nodes = scratch.settle(open_nodes.join(new, "node", "left_anti").join(claimed, "node", "left_anti"), "open")
        both = open_edges.join(open_nodes.withColumnRenamed("node", "low"), "low", "left_semi")
        open_edges = scratch.settle(both.join(open_nodes.withColumnRenamed("node", "high"), "high", "left_semi"), "pairs")
        rounds += 1
        if rounds == ROUNDS and not open_edges.isEmpty():
            named = open_edges.join(components(open_edges, scratch).withColumnRenamed("node", "low"), "low")
            sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= SMALL)
            small = scratch.settle(named.join(sizes, "component").select("component", "low", "high"), "small")
            chosen = chosen.unionByName(scratch.settle(small.groupBy("component").applyInPandas(greedy, "node long"), "leaders"))
            inside = small.select(F.col("low").alias("node")).union(small.select("high")).distinct()
            open_nodes = scratch.settle(open_nodes.join(inside, "node", "left_anti"), "open")
            open_edges = scratch.settle(open_edges.join(open_nodes.withColumnRenamed("node", "low"), "low", "left_semi"), "pairs")
    members = edges.join(chosen.withColumnRenamed("node", "low"), "low", "left_semi").join(chosen.withColumnRenamed("node", "high"), "high", "left_anti")
    members = members.groupBy("high").agg(F.min("low").alias("leader")).select("leader", F.col("high").alias("member"))
    out = settle(chosen.select(F.col("node").alias("leader"), F.col("node").alias("member")).unionByName(members), "members")
    scratch.clear()
    return out


def decided(pdf: pd.DataFrame) -> pd.DataFrame:
    """leader, member of the claimed ones of one batch's edges (low, high), in rank order."""
    edges = pdf.sort_values(["low", "high"])
    nodes, ends = np.unique(edges["low"].to_numpy(), return_index=True)
    highs = edges["high"].to_numpy()
    owner: dict[int, int] = {}
    for low, i, j in zip(nodes.tolist(), ends.tolist(), [*ends[1:].tolist(), len(highs)]):
        if low not in owner:
            for high in highs[i:j].tolist():
                owner.setdefault(high, low)
    return pd.DataFrame({"leader": np.array(list(owner.values()), np.int64), "member": np.array(list(owner), np.int64)})


def claims(hashes: DataFrame, k: int, *, also: tuple[str, ...] = ()) -> DataFrame:
    """leader, member (ranks) of greedy clusters of hashes (h, rank, also), for every member that a leader claims; all others lead.

    Hashes are decided in batches in rank order: pairs are formed within a batch only, and its leaders then claim what follows. So pairs of claimed
    hashes, which are the most by far where many are alike, are never formed. A batch with more than EDGES pairs is made smaller, one with few larger.
    """
    scratch, result = Scratch(hashes.sparkSession), Scratch(hashes.sparkSession)
    left = scratch.settle(hashes.select(*also, "h", "rank"), "open")
    n, size, out = left.count(), BATCH, None
    while n:
        share = min(1.0, size / n)
        if share < 1:
            ends = left.groupBy(*also).agg(F.percentile_approx("rank", share).alias("_end"))
            split = left.join(ends, list(also)) if also else left.crossJoin(ends)
            split = scratch.settle(split.select(*also, "h", "rank", (F.col("rank") <= F.col("_end")).alias("_now")), "split")
        else:
            split = left.withColumn("_now", F.lit(True))
        batch, later = split.where("_now").drop("_now"), split.where("not _now").drop("_now")
        edges = scratch.settle(self_pairs(batch, k, also=also, wide=False), "edges")
        found = edges.count()
        if found > EDGES and size > 1:
            size = max(1, size // 4)
            continue
        new = result.settle(edges.groupBy(*also).applyInPandas(decided, "leader long, member long"), "claims")
        out = new if out is None else out.unionByName(new)
        if share == 1:
            break
        leading = batch.join(new.select(F.col("member").alias("rank")), "rank", "left_anti")
        near = hash_pairs(later.withColumnRenamed("rank", "x"), leading.select(*also, "h", F.col("rank").alias("y"), F.lit(0).cast("long").alias("z")), k, also=also, pick="first", wide=False)
        taken = result.settle(near.groupBy(F.col("x").alias("member")).agg(F.min("y").alias("leader")).select("leader", "member"), "claims")
        out = out.unionByName(taken)
        left = scratch.settle(later.join(taken.select(F.col("member").alias("rank")), "rank", "left_anti").select(*also, "h", "rank"), "open")
        n, size = left.count(), size * (4 if 16 * found < EDGES else 2 if 4 * found < EDGES else 1)
    scratch.clear()
    return hashes.sparkSession.createDataFrame([], "leader long, member long") if out is None else out


def leader_clusters(files: DataFrame, k: int = 5) -> DataFrame:
    """file_id, cluster (the leader hash's first file) of files in clusters of two or more, in order of first appearance."""
    hashes = settle(distinct_hashes(files), "hashes")
    claimed = claims(hashes, k)
    named = hashes.join(claimed.withColumnRenamed("member", "rank"), "rank", "left").select("h", F.coalesce("leader", "rank").alias("cluster"))
    each = files.select("file_id", parse_phash(F.col("phash")).alias("h")).join(named, "h")
    return large_only(each.select("file_id", "cluster"))


def large_only(each: DataFrame) -> DataFrame:
    sizes = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    return each.join(sizes, "cluster", "left_semi").select("file_id", "cluster")


def leader_clusters_bucketed(files: DataFrame, k: int = 5, bucket_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """As leader_clusters, within buckets of size and in ascending order of unsigned hashes; cluster is the smallest file of the leader's hash in its bucket."""
    sized = files.withColumn("bucket", F.floor(F.col("size_bytes") / bucket_bytes))
    hashes = distinct_hashes(sized, also=("bucket",)).withColumnRenamed("rank", "first")
    # Flipping the sign bit makes signed order that of unsigned numbers.
    order = F.struct("bucket", F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
    hashes = settle(hashes.withColumn("key", order), "hashes")
    ranked = settle(assign_ids(hashes, ["key"], "rank"), "ranked")
    claimed = claims(ranked.select("bucket", "h", "rank"), k, also=("bucket",))
    lead = ranked.select(F.col("rank").alias("leader"), F.col("first").alias("cluster"))
    named = ranked.join(claimed.withColumnRenamed("member", "rank"), "rank", "left").withColumn("leader", F.coalesce("leader", "rank")).join(lead, "leader").select("bucket", "h", "cluster")
    each = sized.select("file_id", "bucket", parse_phash(F.col("phash")).alias("h")).join(named, ["bucket", "h"])
    return large_only(each.select("file_id", "cluster"))


def dedup_cascade(files: DataFrame, k: int = 5) -> DataFrame:
    """file_id, cluster, how: equal contents first, other images by leader clusters, the rest alone."""
    exact = settle(exact_groups(files), "exact")
    rest = files.join(exact, "file_id", "left_anti")
    near = settle(leader_clusters(rest.where("type = 'image'"), k), "near")
    both = exact.withColumn("how", F.lit("exact")).unionByName(near.withColumn("how", F.lit("near")))
    single = files.select("file_id").join(both, "file_id", "left_anti").select("file_id", F.col("file_id").alias("cluster"), F.lit("single").alias("how"))
    return both.unionByName(single)


def elect_original(files: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, original, members: the member of most pixels, then bytes, then of the smallest id. Built-in aggregation, so a large cluster needs no sort."""
    best = F.max(F.struct(pixels(F.col("width"), F.col("height")).alias("p"), "size_bytes", (-F.col("file_id")).alias("f")))
    return clusters.select("file_id", "cluster").join(files, "file_id").groupBy("cluster").agg((-best["f"]).alias("original"), F.count(F.lit(1)).alias("members"))


def assign_groups(files: DataFrame, clusters: DataFrame, *, first_id: int = 1) -> DataFrame:
    """file_id, group_id, duplicate_of: clusters of two or more get ids in order; their originals and all others have no duplicate_of."""
    elected = elect_original(files, clusters.where("how <> 'single'") if "how" in clusters.columns else clusters)
    named = assign_ids(elected.where("members > 1"), ["cluster"], "group_id", start=first_id)
    placed = clusters.select("file_id", "cluster").join(named, "cluster", "left")
    return placed.select("file_id", "group_id", F.when(F.col("original") != F.col("file_id"), F.col("original")).alias("duplicate_of"))


def reuse_group(elected: DataFrame, files: DataFrame, *, first_id: int) -> DataFrame:
    """cluster, original, group_id: the original's group if it has one, else a new id."""
    held = elected.join(files.select(F.col("file_id").alias("original"), F.col("group_id").alias("held")), "original", "left")
    new = assign_ids(held.where("held is null").select("cluster"), ["cluster"], "fresh", start=first_id)
    return held.join(new, "cluster", "left").select("cluster", "original", F.coalesce("held", "fresh").alias("group_id"))


def group_every_single(files: DataFrame, *, first_id: int) -> DataFrame:
    """file_id, group_id: every file original of a group of its own."""
    return assign_ids(files.select("file_id"), ["file_id"], "group_id", start=first_id)


def should_promote(p: Column, size: Column, old_p: Column, old_size: Column, has_original: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return ~has_original | (zero(p) > zero(old_p)) | ((zero(p) == zero(old_p)) & (zero(size) > zero(old_size)))


def join_existing_groups(files: DataFrame, groups: DataFrame, matches: DataFrame) -> DataFrame:
    """file_id, group_id, duplicate_of, promoted of matched new files (file_id, group_id): the best of old original and new members is original."""
    news = matches.select("file_id", "group_id").join(files.select("file_id", pixels(F.col("width"), F.col("height")).alias("p"), "size_bytes"), "file_id").withColumn("new", F.lit(1))
    held = groups.join(matches.select("group_id").distinct(), "group_id", "left_semi").where("original_file_id is not null").select("group_id", F.col("original_file_id").alias("file_id"))
    olds = held.join(files.select("file_id", pixels(F.col("width"), F.col("height")).alias("p"), "size_bytes"), "file_id").withColumn("new", F.lit(0))
    best = news.unionByName(olds).groupBy("group_id").agg(F.max(F.struct("p", "size_bytes", (-F.col("new")).alias("old"), (-F.col("file_id")).alias("f"))).alias("b")).select("group_id", (-F.col("b.f")).alias("original"))
    return news.join(best, "group_id").select("file_id", "group_id", F.when(F.col("original") != F.col("file_id"), F.col("original")).alias("duplicate_of"), (F.col("original") == F.col("file_id")).cast("int").alias("promoted"))


def dedup_summary(clusters: DataFrame) -> DataFrame:
    """n_groups with duplicates, n_singles, n_duplicates."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(F.col("n") > 1).alias("n_groups"), F.count_if(F.col("n") == 1).alias("n_singles"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("long").alias("n_duplicates"))


def evaluate_pairs(images: DataFrame, k: int = 5) -> DataFrame:
    """expected, predicted, n over pairs of (name, phash) that share the text before the first `_`; pairs of which one name says `fail` are left out.

    Pairs of which both names say `fail` are expected to differ, all others to match.
    Pairs of different prefixes aren't formed; those within k bits would be wrong, and hamming_join finds them.
    """
    side = lambda x: images.select(name_prefix(F.col("name")).alias("prefix"), F.col("name").alias(f"name{x}"), parse_phash(F.col("phash")).alias(f"h{x}"))
    met = side("a").join(side("b"), "prefix").where((F.col("namea") < F.col("nameb")) & (F.col("namea").contains("fail") == F.col("nameb").contains("fail")))
    return met.groupBy((~F.col("namea").contains("fail")).alias("expected"), (distance(F.col("ha"), F.col("hb")) <= k).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
