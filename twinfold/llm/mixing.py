"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are token shares raised to an exponent and normalised. The exponent is found by bisection: the smallest (the
flattest mixture) under which no source repeats more than `limit` times, or the one whose weights have a target entropy.
A source's epochs are permutations of its rows by a hash. A row's place in its permutation says how far the source has come, and so in
which block it stands: every block of about BLOCK tokens takes each source's weight's share of them, so weights hold in each block up to the
chance of the permutation. The rows of a block are then permuted together by another hash, so that sources alternate as in a plain shuffle.
Sources are a table throughout; nothing depends on their number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import Scratch

BLOCK = 5_000_000
LIMIT = 2.0
#: Places of a permutation, as a power of two, and by how many bits the place of a cut is narrowed at a time.
PLACES, STEP = 40, 14
#: Most sources whose facts are broadcast, about 100 bytes each.
MAX_BROADCAST = 200_000
#: Points looked at in a round of the bisection, and rounds: the exponent is right to about 1e-9.
POINTS, ROUNDS = 31, 6


@dataclass(frozen=True)
class Target:
    """limit: most repeats of a source; entropy: of the weights, in nats, instead; budget: tokens (None: every source is used once at least)."""

    limit: float = LIMIT
    entropy: float | None = None
    budget: int | None = None


def exponent(sources: DataFrame, target: Target) -> float:
    """Between 0 (equal weights) and 1 (as in the corpus) for sources (tokens); 1 where even that can't meet the limit."""
    known = sources.where("tokens > 0")
    total, n, least, most = known.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if n < 2:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def too_flat(points: list[float]) -> list[bool]:
        if target.entropy is None and target.budget is None:
            return [(most / least) ** (1 - x) > target.limit * (1 + 1e-12) for x in points]
        sums = known.agg(*[F.sum(F.pow(share, F.lit(x))).alias(f"z{i}") for i, x in enumerate(points)], *[F.sum(F.pow(share, F.lit(x)) * F.log(share)).alias(f"l{i}") for i, x in enumerate(points)]).first()
        if target.entropy is not None:
            return [math.log(sums[f"z{i}"]) - x * sums[f"l{i}"] / sums[f"z{i}"] > target.entropy for i, x in enumerate(points)]
        return [(least / total) ** (x - 1) / sums[f"z{i}"] * target.budget / total > target.limit * (1 + 1e-12) for i, x in enumerate(points)]

    if not too_flat([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        below = sum(too_flat(points))  # it holds up to the point looked for
        low, high = ([low] + points)[below], (points + [high])[below]
    return high


def words(text: Column) -> Column:
    """Words between white space; a text without any, or null, counts as one token, so that every row has a place."""
    return F.greatest(F.lit(1), F.size(F.split(F.trim(F.coalesce(text, F.lit(""))), r"[ \t\n\r\x0B\f]+"))).cast("long")


def weigh(sources: DataFrame, target: Target) -> DataFrame:
    """sources (source, tokens) with weight, whole (epochs used in full), part (tokens of the last, partial one) and exponent."""
    x = exponent(sources, target)
    total, powers = sources.agg(F.sum("tokens"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(x)))).first()
    weighed = sources.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(x)) / F.lit(powers or 1.0))
    budget = target.budget if target.budget is not None else weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    epochs = F.col("weight") * F.lit(float(budget)) / F.col("tokens") + 1e-9
    return weighed.withColumn("whole", F.floor(epochs).cast("int")).withColumn("part", F.floor((epochs - F.col("whole")) * F.col("tokens"))).withColumn("exponent", F.lit(x))


def place(base: Column, epoch: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), epoch, base), F.lit(1 << PLACES))


def shuffled(base: Column, epoch: Column, block: Column, seed: int) -> Column:
    """A row's place in its block, by a hash that its place in its source's permutation says nothing about."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), block, epoch, base), F.lit(1 << PLACES))


def cut_places(slim: DataFrame, facts: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """source, until: the place at which the partial epoch of each source ends, so that the rows before it have at most `part` tokens.

    The stretch in which the running sum passes `part` is narrowed by a factor of 2**STEP a round, with sums by stretch, whatever the number of rows.
    """
    left = PLACES
    state = scratch.settle(facts.where("part > 0").select("source", "whole", F.lit(0).cast("long").alias("low"), F.col("part").alias("room")), "cuts")
    rows = scratch.settle(joined(slim, state.select("source", "whole")).select("source", "tokens", place(F.col("base"), F.col("whole"), seed).alias("place")), "partial")
    while left > 0:
        width = 1 << max(0, left - STEP)
        here = joined(rows, state).where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.lit(1 << left)))
        sums = here.groupBy("source", "whole", "low", "room", F.expr(f"(place - low) div {width}").alias("at")).agg(F.sum("tokens").alias("n"))
        run = sums.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("at")))
        # A source whose rows all fit in what is left is cut behind this stretch.
        first = run.groupBy("source", "whole", "low", "room").agg(F.min(F.when(F.col("end") > F.col("room"), F.struct("at", (F.col("end") - F.col("n")).alias("before")))).alias("cut"))
        low = F.coalesce(F.col("low") + F.col("cut.at") * width, F.col("low") + F.lit(1 << left))
        state = scratch.settle(first.select("source", "whole", low.alias("low"), (F.col("room") - F.coalesce("cut.before", F.lit(0))).alias("room"), F.col("cut").isNull().alias("over")), "cuts").withColumn("room", F.when(F.col("over"), F.lit(1 << 62)).otherwise(F.col("room"))).drop("over")
        left = max(0, left - STEP)
    return state.select("source", F.col("low").alias("until"))


def joined(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their source, null being a source too; facts are broadcast where there are few sources."""
    few = F.broadcast(facts) if facts.count() <= MAX_BROADCAST else facts
    own = few.withColumnRenamed("source", "_of")
    return rows.join(own, rows["source"].eqNullSafe(own["_of"])).drop("_of")


def mix(docs: DataFrame, target: Target = Target(), *, block: int = BLOCK, seed: int = 0, doc="doc_id", text="text", source="source") -> DataFrame:
    """row (all columns of docs as a struct, so that no name can clash), weight, epoch, block, place: rows of docs, each as often as its source's epochs say.

    The order by (block, place) is the mixture. Rows without a source are a source of their own. The last, partial epoch
    takes the start of its permutation up to the first row that would pass the source's share of the budget. Equal rows share a place and
    are taken or left together; rows with null ids or texts are rows like others, an empty table has no mixture.
    """
    scratch = Scratch(docs.sparkSession)
    base = F.xxhash64(doc, text)
    kind = F.col(source).cast("string").alias("source")
    slim = scratch.settle(docs.select(kind, base.alias("base"), words(F.col(text)).alias("tokens")), "slim")
    facts = scratch.settle(weigh(scratch.settle(slim.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources"), target), "facts")
    cuts = cut_places(slim, facts, seed, scratch)
    whole = scratch.settle(facts.join(cuts.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left").select("source", "tokens", "weight", "whole", F.coalesce("until", F.lit(0)).alias("until")), "mixture")
    scratch.clear(but=1)
    rows = joined(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), kind, base.alias("base")), whole)
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole")))).withColumn("own", place(F.col("base"), F.col("epoch"), seed))
    used = each.where((F.col("epoch") < F.col("whole")) | (F.col("own") < F.col("until")))
    far = (F.col("epoch") + F.col("own") / F.lit(float(1 << PLACES))) * F.col("tokens")
    dealt = used.withColumn("block", F.floor(far / (F.col("weight") * F.lit(float(block)))))
    return dealt.select("row", "weight", "epoch", "block", shuffled(F.col("base"), F.col("epoch"), F.col("block"), seed).alias("place"))


def mixed_rows(docs: DataFrame, target: Target = Target(), *, doc="doc_id", text="text", source="source") -> DataFrame:
    """The mixture in its order, with the columns of docs only."""
    out = mix(docs, target, doc=doc, text=text, source=source)
    return out.repartitionByRange("block", "place").sortWithinPartitions("block", "place").select("row.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: doc_id, source, n_tokens, weight, epoch, block, place. Null texts count one token; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs)
    return out.select("row.doc_id", "row.source", words(F.col("row.text")).alias("n_tokens"), F.round("weight", 9).alias("weight"), "epoch", "block", "place")
