"""Hamming joins of 64-bit hashes by bands, without comparing all pairs.

Up to WIDE hashes are cut into k + 1 bands, one of which is equal in a pair within k bits. With N hashes spread evenly each
meets N / 2**(64 / (k + 1)) others in a band (for k = 5, N / 1600), so beyond WIDE they are cut into k // 2 + 1 bands, one of which
differs by a bit at most: one side has its bands and the other theirs with each bit changed (for k = 5, 67 probes that meet N / 2**21
each). Both ways find the same pairs. The hashes of a cell (a band and its value) are compared in numpy, in blocks of bounded size, see met_in_cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import partitions, settle

#: Hashes beyond which the wide bands are used, and comparisons of a cell beyond which it is dealt to several tasks.
WIDE, HEAVY = 20_000_000, 1 << 30
#: Comparisons made at once, pairs handed on at once, rows and comparisons for each task to aim at.
STEP, PAIRS, ROWS, WORK = 1 << 20, 1 << 19, 250_000, 4 << 30


def parse_phash(text: Column) -> Column:
    """Hex digits, with or without 0x, as a signed 64-bit number; NULL for anything else."""
    clean = F.lpad(F.regexp_replace(F.lower(F.trim(text)), "^0x", ""), 16, "0")
    half = lambda at: F.conv(F.substring(clean, at, 8), 16, 10).cast("long")
    return F.when(F.regexp_replace(F.lower(F.trim(text)), "^0x", "").rlike("^[0-9a-f]{1,16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(k: int) -> list[tuple[int, int]]:
    """(shift, mask) of k + 1 bands: two hashes within k bits agree in one of them at least."""
    edges = [64 * i // (k + 1) for i in range(k + 2)]
    return [(a, (1 << (b - a)) - 1 if b - a < 64 else -1) for a, b in zip(edges, edges[1:])]


def band(h: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(mask).cast("long"))


def wide_bands(k: int) -> list[tuple[int, int]]:
    """(shift, mask) of k // 2 + 1 bands: two hashes within k bits differ by one bit at most in one of them."""
    n = k // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, (1 << (b - a)) - 1 if b - a < 64 else -1) for a, b in zip(edges, edges[1:])]


def banded(df: DataFrame, h: str, cuts: list[tuple[int, int]]) -> DataFrame:
    return df.select("*", F.posexplode(F.array(*[band(F.col(h), *b) for b in cuts])).alias("_band", "_value"))


def probed(df: DataFrame, h: str, cuts: list[tuple[int, int]]) -> DataFrame:
    """As banded, with a row more for each bit of each band, changed."""

    def probes(shift: int, mask: int) -> Column:
        value, width = band(F.col(h), shift, mask), 64 if mask == -1 else mask.bit_length()
        return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))))

    each = df.select("*", F.posexplode(F.array(*[probes(*b) for b in cuts])).alias("_band", "_values"))
    return each.withColumn("_value", F.explode("_values")).drop("_values")


def close(left: np.ndarray, right: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of unsigned hashes within k bits, STEP comparisons at a time."""
    step = max(1, STEP // max(1, len(right)))
    for i in range(0, len(left), step):
        at = np.flatnonzero(np.bitwise_count(left[i : i + step, None] ^ right[None, :]).ravel() <= k)
        if len(at):
            yield i + at // len(right), at % len(right)


def compare(batches: Iterator[pd.DataFrame], k: int, cuts: list[tuple[int, int]], most: int, key: list[str], also: tuple[str, ...], pick: str) -> Iterator[pd.DataFrame]:
    """The pairs of the cells of one task. Sides: 0 left, 1 right, 2 one set that meets itself."""
    parts = [pdf for pdf in batches if len(pdf)]
    if not parts:
        return
    pdf = pd.concat(parts, ignore_index=True)
    parts.clear()
    codes = pdf.groupby(key, sort=False).ngroup().to_numpy() if len(key) > 1 else pd.factorize(pdf[key[0]])[0]
    order = np.lexsort((pdf["_side"].to_numpy(), codes))
    codes, side, band_of = codes[order], pdf["_side"].to_numpy()[order], pdf["_band"].to_numpy()[order]
    h, x, z = pdf["h"].to_numpy()[order].view(np.uint64), pdf["x"].to_numpy()[order], pdf["z"].to_numpy()[order]
    own = {c: pdf[c].to_numpy()[order] for c in also}
    del pdf
    edges = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
    middles = edges[:-1] + np.add.reduceat((side == 0).astype(np.int64), edges[:-1])
    alone = side[edges[:-1]] == 2
    # Cells in which a side is missing have no pairs.
    full = np.flatnonzero(np.where(alone, np.diff(edges) > 1, (middles > edges[:-1]) & (middles < edges[1:])))

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for c in full:
            first, middle, end, band_at = edges[c], middles[c], edges[c + 1], band_of[edges[c]]
            if alone[c]:
                # Strips of the triangle: rows meet what comes after the strip's first row.
                ranges, step = [], max(128, (end - first) // 16)
                for i in range(first, end, step):
                    ranges.append((i, min(end, i + step), i, end))
            else:
                ranges = [(first, middle, middle, end)]
            for i, i_end, j, j_end in ranges:
                for a, b in close(h[i:i_end], h[j:j_end], k):
                    a, b = a + i, b + j
                    if alone[c]:
                        a, b = a[b > a], b[b > a]
                    # A pair is emitted in the first band that finds it only.
                    differ, there = h[a] ^ h[b], np.ones(len(a), bool)
                    for shift, mask in cuts[:band_at]:
                        there &= np.bitwise_count(differ >> np.uint64(shift) & np.uint64(mask & (1 << 64) - 1)) > most
                    if there.any():
                        yield a[there], b[there]

    def rows(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        low, high = x[a], x[b]
        if pick == "pairs":
            low, high = np.minimum(low, high), np.maximum(low, high)
        out = {**{c: v[a] for c, v in own.items()}, "x": low, "y": high, "z": z[b], "distance": np.bitwise_count(h[a] ^ h[b]).astype(np.int32)}
        out = pd.DataFrame(out)
        if pick in ("nearest", "first"):  # one row for each on the left
            by = ["x", *also, *(["distance"] if pick == "nearest" else []), "y", "z"]
            out = out.sort_values(by).drop_duplicates(["x", *also])
        return out

    held, n = [], 0
    for pair in found():
        held.append(pair)
        n += len(pair[0])
        if n >= PAIRS:
            yield rows(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield rows(*map(np.concatenate, zip(*held)))


def met_in_cells(a: DataFrame, b: DataFrame | None, k: int, cuts: list[tuple[int, int]], *, most: int = 0, also: tuple[str, ...] = (), pick: str = "all", heavy: int = HEAVY) -> DataFrame:
    """also, x, y, z, distance of rows a (_band, _value, h, x, also) and b (the same with y, z) of one cell whose hashes differ in at most k bits, each pair
    once. Without b, pairs of a with x < y (pick: pairs); its hashes must differ. most: bits in which the band of a pair may differ.

    pick: all pairs; or for each x the nearest (by distance, y, z) or the first (by y), of a task, so that a further aggregation is small.

    Cells of more than `heavy` comparisons are found by counting, and their sides are dealt in blocks. Each block of one side meets each of the other in a
    task of its own, so no task holds more than some blocks, however many hashes share a cell.
    """
    key, side = ["_band", "_value", *also], max(1, math.isqrt(heavy))
    if also:
        a, b = a.dropna(subset=list(also)), b and b.dropna(subset=list(also))
    n = a.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    sizes = n.withColumn("_m", F.col("_n")) if b is None else n.join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")), key)
    blocks = lambda c: F.ceil(F.col(c) / side).cast("int")
    sizes = settle(sizes.where("_n > 1" if b is None else "_m > 0").select(*key, "_n", "_m", blocks("_n").alias("_left"), blocks("_m").alias("_right")), "sizes")
    moved = "_n * _right" if b is None else "_n * _right + _m * _left"
    total = sizes.agg(F.sum(F.expr(moved)).alias("rows"), F.sum(F.expr("double(_n) * _m")).alias("work"), F.max(F.greatest("_left", "_right")).alias("most")).first()
    spark = a.sparkSession
    if most:  # probes are many, and most of them meet nothing
        a, b = a.join(sizes.select(*key), key, "left_semi"), b.join(sizes.select(*key), key, "left_semi")
    tasks = max(partitions(spark), (total["rows"] or 0) // ROWS, int(total["work"] or 0) // WORK) + 1

    # There are fewer large cells than rows / side.
    large = F.broadcast(sizes.where("_left > 1 or _right > 1").select(*key, "_left", "_right"))

    def dealt(df: DataFrame, mine: str, others: str, which: int) -> DataFrame:
        if (total["most"] or 1) > 1:
            df = df.join(large, key, "left").withColumns({mine: F.coalesce(mine, F.lit(1)), others: F.coalesce(others, F.lit(1))})
            df = df.withColumn("_own", F.pmod(F.xxhash64("h", "x"), F.col(mine)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        else:
            df = df.withColumns({"_own": F.lit(0), "_other": F.lit(0)})
        own, other = F.col("_own"), F.col("_other")
        if b is None:
            place = {"_i": F.least(own, other), "_j": F.greatest(own, other), "_side": F.when(own < other, 0).when(own > other, 1).otherwise(2)}
        else:
            place = {"_i": other if which else own, "_j": own if which else other, "_side": F.lit(which)}
        return df.withColumns({c: v.cast("int") for c, v in place.items()}).select(*key, "_i", "_j", "_side", F.col("h"), "x", "z")

    left = a.withColumn("z", F.lit(0).cast("long"))
    rows = dealt(left, "_left", "_right", 0)
    if b is not None:
        rows = rows.unionByName(dealt(b.withColumnRenamed("y", "x"), "_right", "_left", 1))
    cell = [*key, "_i", "_j"]
    schema = "".join(f"`{c}` {a.schema[c].dataType.simpleString()}, " for c in also) + "x long, y long, z long, distance int"
    return rows.repartition(tasks, *cell).mapInPandas(lambda batches: compare(batches, k, cuts, most, cell, also, pick), schema)


def in_cells(df: DataFrame, cuts: list[tuple[int, int]], *, probe: bool = False) -> DataFrame:
    return (probed if probe else banded)(df, "h", cuts).withColumn("_band", F.col("_band").cast("int"))


def hash_pairs(a: DataFrame, b: DataFrame, k: int, *, also: tuple[str, ...] = (), pick: str = "all", wide: bool | None = None, heavy: int = HEAVY) -> DataFrame:
    """met_in_cells of hashes a (h, x, also) and b (h, y, z, also)."""
    wide = b.count() > WIDE if wide is None else wide
    cuts = wide_bands(k) if wide else bands(k)
    return met_in_cells(in_cells(a, cuts, probe=wide), in_cells(b, cuts), k, cuts, most=int(wide), also=also, pick=pick, heavy=heavy)


def hamming_join(left: DataFrame, right: DataFrame, k: int, *, on: tuple[str, str] = ("h", "h"), where: Column | None = None, also: tuple[str, ...] = (), wide: bool | None = None, heavy: int = HEAVY) -> DataFrame:
    """Pairs of rows whose hashes differ in at most k bits, with `distance`. Column names of both sides must differ but for `also`, which must be equal. wide: which way; by the number of distinct hashes of the right side if not given.

    Distinct hashes are compared, see met_in_cells (and for `heavy`); rows are joined to the pairs of hashes that are found.
    """
    a = left.select(*also, F.col(on[0]).alias("h")).where("h is not null").distinct()
    b = right.select(*also, F.col(on[1]).alias("h")).where("h is not null").distinct()
    found = hash_pairs(a.withColumn("x", F.col("h")), b.withColumns({"y": F.col("h"), "z": F.lit(0).cast("long")}), k, also=also, wide=wide, heavy=heavy)
    found = found.select(*also, F.col("x").alias(on[0]), F.col("y").alias("_right"), "distance")
    out = left.join(found, [*also, on[0]]).join(right.withColumn("_right", F.col(on[1])), [*also, "_right"]).drop("_right")
    return out if where is None else out.where(where)


def distinct_hashes(files: DataFrame, *, phash="phash", order="file_id", also: tuple[str, ...] = ()) -> DataFrame:
    """h, rank (the first file's id), n of each distinct readable hash."""
    return files.select(*also, parse_phash(F.col(phash)).alias("h"), order).where("h is not null").groupBy(*also, "h").agg(F.min(order).alias("rank"), F.count(F.lit(1)).alias("n"))


def self_pairs(hashes: DataFrame, k: int, *, also: tuple[str, ...] = (), wide: bool | None = None) -> DataFrame:
    """low, high (ranks), distance of pairs of distinct hashes within k bits."""
    rows = hashes.select(*also, "h", F.col("rank").alias("x"))
    if hashes.count() > WIDE if wide is None else wide:
        b = rows.select(*also, "h", F.col("x").alias("y"), F.lit(0).cast("long").alias("z"))
        found = hash_pairs(rows, b, k, also=also, wide=True).where("x < y")
    else:
        found = met_in_cells(in_cells(rows, bands(k)), None, k, bands(k), also=also, pick="pairs")
    return found.select(*also, F.col("x").alias("low"), F.col("y").alias("high"), "distance")


def nearest_of(found: DataFrame) -> DataFrame:
    """x, group_id, distance of the nearest of each x (tasks give one for each of theirs)."""
    best = found.groupBy("x").agg(F.min(F.struct("distance", "y", "z")).alias("best"))
    return best.select("x", F.col("best.z").alias("group_id"), "best.distance")


def nearest_hash(queries: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """For every query (q, h) the known hash (group_id, h, rank) with the smallest distance, ties to the first seen: q, group_id, distance."""
    asked = queries.select("h").where("h is not null").distinct().withColumn("x", F.col("h"))
    found = hash_pairs(asked, known.select("h", F.col("rank").alias("y"), F.col("group_id").alias("z")).where("h is not null"), k, pick="nearest")
    return queries.select("q", F.col("h").alias("x")).join(nearest_of(found), "x").select("q", "group_id", "distance")


def match_existing(new: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """file_id, group_id, how: the group of equal content, else for images the nearest hash's; files without a match aren't listed.

    new: file_id, hash_sha256, phash, type. known: file_id, group_id, hash_sha256, phash.
    """
    sha = known.where("hash_sha256 is not null and group_id is not null").groupBy("hash_sha256").agg(F.min_by("group_id", "file_id").alias("sha_group"))
    exact = new.join(sha, "hash_sha256", "left").select("file_id", "phash", "type", "sha_group")
    queries = exact.where("sha_group is null and type = 'image'").select(F.col("file_id").alias("q"), parse_phash(F.col("phash")).alias("h")).where("h is not null")
    hashes = known.where("group_id is not null").select("file_id", "group_id", parse_phash(F.col("phash")).alias("h")).where("h is not null")
    hashes = hashes.groupBy("h").agg(F.min("file_id").alias("rank"), F.min_by("group_id", "file_id").alias("group_id"))
    near = nearest_hash(queries, hashes, k).select(F.col("q").alias("file_id"), F.col("group_id").alias("near_group"))
    found = exact.join(near, "file_id", "left").withColumn("group_id", F.coalesce("sha_group", "near_group"))
    return found.where("group_id is not null").select("file_id", "group_id", F.when(F.col("sha_group").isNotNull(), "exact").otherwise("near").alias("how"))
