"""Queues, pages and lookups of the review workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import complete_path, dimensions
from ..sources.files import optional
from .filters import path_like, search_paths, status_filter, with_is_original
from .paging import page_of


def review_queue(files: DataFrame, limit: int) -> DataFrame:
    """Undecided files, newest first, ties by id."""
    rows = files.where("review_status = 'undecided'").orderBy(F.desc("created_at"), "file_id").limit(limit)
    return rows.select("file_id", "path_on_drive", "type", "size_bytes", "group_id", dimensions(F.col("width"), F.col("height")).alias("dimensions"), "created_at")


def groups_with(files: DataFrame, groups: DataFrame, status: str = "all") -> DataFrame:
    """Groups that have a file of this status."""
    return groups.join(status_filter(files, status).where("group_id is not null").select("group_id"), "group_id", "left_semi")


def groups_page(files: DataFrame, groups: DataFrame, drives: DataFrame, page: int, per_page: int, status: str = "all") -> DataFrame:
    """One page of groups by id: group_id, original_file_id, statuses, files (original first, then by id)."""
    shown = groups_with(files, groups, status).select("group_id", "original_file_id")
    shown = page_of(shown, "group_id", page, per_page)
    members = files.join(F.broadcast(shown), "group_id").join(drives.select("drive_id", "mount_path", "label"), "drive_id", "left")
    original = (F.col("file_id") == F.col("original_file_id")) & F.col("original_file_id").isNotNull()
    row = F.struct(
        F.when(original, 0).otherwise(1).alias("place"), "file_id", "path_on_drive", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "width", "height", "review_status",
        F.when(original, 1).otherwise(0).alias("is_original"), complete_path(F.col("mount_path"), F.col("path_on_drive")).alias("full_path"), "label",
    )
    held = members.groupBy("group_id", "original_file_id").agg(F.array_sort(F.collect_list(row)).alias("files"))
    names = F.array_sort(F.array_distinct(F.transform("files", lambda f: F.coalesce(f["review_status"], F.lit("unknown")))))
    count = F.transform(names, lambda s: F.struct(s.alias("status"), F.size(F.filter("files", lambda f: F.coalesce(f["review_status"], F.lit("unknown")) == s)).alias("n")))
    return held.select("group_id", "original_file_id", F.map_from_entries(count).alias("statuses"), "files").orderBy("group_id")


def singles_page(files: DataFrame, drives: DataFrame, page: int, per_page: int, status: str = "all") -> DataFrame:
    rows = page_of(status_filter(files, status).where("group_id is null"), "file_id", page, per_page)
    joined = rows.join(drives.select("drive_id", "mount_path", "label"), "drive_id", "left")
    return joined.select("file_id", "path_on_drive", complete_path(F.col("mount_path"), F.col("path_on_drive")).alias("full_path"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "type", "review_status", "label").orderBy("file_id")


def page_meta(rows: DataFrame, page: int, per_page: int, *, least: int = 0) -> DataFrame:
    """One row: total, pages (least of them 1 for groups, 0 for singles), has_prev, has_next."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    pages = F.greatest(F.lit(least), F.ceil(F.col("total") / per_page)).cast("long")
    return total.select("total", pages.alias("pages"), F.lit(page > 1).alias("has_prev"), (F.lit(page) < pages).alias("has_next"))


def list_runs(runs: DataFrame, source: str | None = None) -> DataFrame:
    kept = runs if source is None else runs.where(F.col("source_path") == source)
    return kept.orderBy(F.desc("timestamp"), "scan_id")


def bulk_preview(files: DataFrame, pattern: str, limit: int) -> DataFrame:
    return search_paths(files, pattern, limit).select("file_id", "path_on_drive", "review_status", "total")


def file_info(files: DataFrame, groups: DataFrame, drives: DataFrame, ids: DataFrame) -> DataFrame:
    """Files of ids (file_id) with drive, group and is_original; columns that the table hasn't got are NULL."""
    some = files.join(ids.select("file_id"), "file_id", "left_semi")
    rows = with_is_original(some, groups).join(drives.select("drive_id", "mount_path", "label"), "drive_id", "left")
    extra = [optional(rows, c, k) for c, k in (("phash", "string"), ("fast_fp", "string"), ("review_note", "string"), ("central_path", "string"))]
    return rows.select("file_id", "group_id", "is_original", "type", "size_bytes", dimensions(F.col("width"), F.col("height")).alias("dimensions"), "review_status", "label", complete_path(F.col("mount_path"), F.col("path_on_drive")).alias("full_path"), *extra)


def file_path(files: DataFrame, drives: DataFrame, ids: DataFrame) -> DataFrame:
    some = files.join(ids.select("file_id"), "file_id", "left_semi").join(drives.select("drive_id", "mount_path"), "drive_id", "left")
    return some.select("file_id", "path_on_drive", "mount_path")


def run_info(runs: DataFrame, scan_id: str) -> DataFrame:
    found = runs.where(F.col("scan_id") == scan_id)
    return found.select("scan_id", "source_path", "stage", "timestamp", "processed_count", F.size("discovered").alias("n_discovered"), F.from_json("config_json", "map<string,string>").alias("config"))


def matching_paths(files: DataFrame, pattern: str) -> DataFrame:
    return path_like(files, pattern).select("file_id", "path_on_drive")


