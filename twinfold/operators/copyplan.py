"""Plans of copies as tables; no bytes move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def copy_plan(matched: DataFrame, destination: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """relative_path, size_bytes, action (copied, exists, overwrite) of matched files against the destination's listing."""
    there = destination.select("relative_path").distinct().withColumn("_there", F.lit(True))
    found = matched.join(there, "relative_path", "left")
    action = F.when(F.col("_there").isNull(), "copied").otherwise("overwrite" if overwrite else "exists")
    return found.select("relative_path", "size_bytes", action.alias("action"))


def copy_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))
