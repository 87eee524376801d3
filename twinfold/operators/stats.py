"""Statistics of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LARGE
from .filters import export_filter


def _sum(c) -> F.col:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def count_tables(files: DataFrame, groups: DataFrame, drives: DataFrame) -> DataFrame:
    """table, n."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in (("files", files), ("groups", groups), ("drives", drives))]
    return parts[0].union(parts[1]).union(parts[2])


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("review_status", F.lit("unknown")).alias("review_status")).agg(F.count(F.lit(1)).alias("n"))


def type_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def storage_stats(files: DataFrame) -> DataFrame:
    average = F.coalesce(F.floor(F.sum("size_bytes") / F.count("size_bytes")), F.lit(0)).cast("long")
    return files.agg(F.count(F.lit(1)).alias("total_files"), _sum("size_bytes").alias("total_bytes"), average.alias("avg_bytes"), F.count_if(F.col("is_large") == 1).alias("large_files")).withColumn("large_threshold_bytes", F.lit(LARGE).cast("long"))


def drive_usage(files: DataFrame, drives: DataFrame) -> DataFrame:
    """label, mount_path, file_count, total_bytes of every drive, most files first. Files are summed before the join, so it meets one row a drive."""
    used = files.groupBy("drive_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_bytes"))
    joined = drives.select("drive_id", "label", "mount_path").join(used, "drive_id", "left")
    return joined.select("drive_id", "label", "mount_path", F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"), F.coalesce("total_bytes", F.lit(0)).cast("long").alias("total_bytes")).orderBy(F.desc("file_count"), "drive_id")


def scan_summary(files: DataFrame) -> DataFrame:
    duplicates = F.count_if(F.col("duplicate_of").isNotNull())
    total = F.count(F.lit(1))
    return files.agg(total.alias("total_files"), _sum("size_bytes").alias("total_bytes"), F.count_if(F.col("is_large") == 1).alias("large_files"), F.count_if(F.col("type") == "image").alias("images"), F.count_if(F.col("type") == "video").alias("videos"), duplicates.alias("duplicates"), F.count_if(F.col("duplicate_of").isNull()).alias("originals"), F.coalesce(F.round(duplicates * 100.0 / F.nullif(total, F.lit(0)), 4), F.lit(0.0)).alias("duplicate_percent"))


def basic_stats(files: DataFrame) -> DataFrame:
    size, total = _sum("size_bytes"), F.count(F.lit(1))
    return files.agg(total.alias("total"), F.count_if(F.col("type") == "image").alias("images"), F.count_if(F.col("type") == "video").alias("videos"), size.alias("total_bytes"), F.round(size / 1024**3, 2).alias("total_gb"), F.coalesce(F.round(size / F.nullif(total, F.lit(0)) / 1024**2, 1), F.lit(0.0)).alias("average_mb"))


def group_status_map(files: DataFrame) -> DataFrame:
    """group_id, statuses (map from status to count)."""
    each = files.where("group_id is not null").groupBy("group_id", F.coalesce("review_status", F.lit("unknown")).alias("review_status")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("review_status", "n")))).alias("statuses"))


def review_progress(files: DataFrame, groups: DataFrame) -> DataFrame:
    reviewed = F.count_if(F.col("review_status").isin("keep", "not_needed"))
    total = F.count(F.lit(1))
    counted = files.agg(total.alias("total"), reviewed.alias("reviewed"), (total - reviewed).alias("remaining"), F.coalesce(F.round(reviewed * 100.0 / F.nullif(total, F.lit(0)), 1), F.lit(0.0)).alias("percent"))
    n = groups.agg(F.count(F.lit(1)).alias("n_groups"))
    return counted.withColumn("_k", F.lit(1)).join(F.broadcast(n.withColumn("_k", F.lit(1))), "_k").select("total", "reviewed", "remaining", "percent", (F.col("total") - F.col("n_groups")).alias("unique_files"))


def export_counts(files: DataFrame, groups: DataFrame, **options) -> DataFrame:
    return export_filter(files, groups, **options).agg(F.count(F.lit(1)).alias("exported"), F.count_if(F.col("is_original") == 1).alias("originals"), F.count_if(F.col("is_original") == 0).alias("regular"))


def distinct_groups(files: DataFrame, status: str = "all") -> DataFrame:
    """Number of groups that have a file of this status."""
    kept = files.where("group_id is not null")
    return (kept if status == "all" else kept.where(F.col("review_status") == status)).agg(F.countDistinct("group_id").alias("n_groups"))


def distinct_sizes(files: DataFrame) -> DataFrame:
    return files.select("size_bytes").where("size_bytes is not null").distinct()


def stage_gate(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """One row: candidates, those the catalogue has (drive_id, path_on_drive), those left; done says whether none is left."""
    there = files.select("drive_id", "path_on_drive").distinct().withColumn("_there", F.lit(1))
    joined = candidates.join(there, ["drive_id", "path_on_drive"], "left")
    out = joined.agg(F.count(F.lit(1)).alias("candidates"), F.count("_there").alias("present"))
    return out.select("candidates", "present", (F.col("candidates") - F.col("present")).alias("left_over"), (F.col("candidates") == F.col("present")).alias("done"))


def catalogue_summary(files: DataFrame, groups: DataFrame, drives: DataFrame, runs: DataFrame) -> DataFrame:
    """section, name, n."""
    tables = count_tables(files, groups, drives).select(F.lit("table").alias("section"), F.col("table_name").alias("name"), "n")
    ledger = runs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("table").alias("section"), F.lit("scan_runs").alias("name"), "n")
    status = status_counts(files).select(F.lit("status").alias("section"), F.col("review_status").alias("name"), "n")
    kinds = type_counts(files).select(F.lit("type").alias("section"), F.col("type").alias("name"), "n")
    return tables.union(ledger).union(status).union(kinds)
