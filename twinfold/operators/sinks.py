"""Manifests, reports and envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import size_mb
from .filters import export_filter

# The columns of a backup manifest.
MANIFEST = ["file_id", "path_on_drive", "central_path", "size_bytes", "type", "review_status", "is_original"]


def backup_manifest(files: DataFrame, groups: DataFrame, **options) -> DataFrame:
    """Rows of a backup, originals first, then by path."""
    return export_filter(files, groups, **options).select(*MANIFEST).orderBy(F.desc("is_original"), "path_on_drive", "file_id")


def write_backup_manifest(files: DataFrame, groups: DataFrame, path: str, **options) -> None:
    backup_manifest(files, groups, **options).write.option("header", True).csv(path)


def large_review(files: DataFrame) -> DataFrame:
    return files.where("is_large = 1").select(F.col("path_on_drive").alias("source_path"), "size_bytes", size_mb(F.col("size_bytes")).alias("size_mb"), "type")


def write_large_review(files: DataFrame, path: str) -> None:
    large_review(files).write.option("header", True).csv(path)


def to_envelope(df: DataFrame, command: str, result: str = "ok") -> DataFrame:
    """One JSON text per row: result, command, data."""
    return df.select(F.to_json(F.struct(F.lit(result).alias("result"), F.lit(command).alias("command"), F.struct(*df.columns).alias("data"))).alias("value"))


def stats_report(stats: DataFrame) -> DataFrame:
    """Lines `name: value` of one row of statistics."""
    text = stats.select(*[F.col(c).cast("string").alias(c) for c in stats.columns])
    return text.unpivot([], text.columns, "name", "value").select(F.concat_ws(": ", "name", "value").alias("value"))


def write_stats_report(stats: DataFrame, path: str) -> None:
    stats_report(stats).write.text(path)
