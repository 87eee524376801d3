"""Filters over listings (path, size_bytes) and catalogues."""

from __future__ import annotations

import fnmatch
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import IMAGES, PRESET_IMAGES, PRESET_VIDEOS, SMALLEST, VIDEOS, like, suffix


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored Java expression; `*` crosses `/`."""
    text = fnmatch.translate(pattern)
    for python, java in ((r"\z", r"\z"), (r"\Z", r"\z")):
        text = text.replace(python, java)
    return "^" + text


def media_only(df: DataFrame, *, path="path") -> DataFrame:
    return df.where(suffix(F.col(path)).isin(*IMAGES, *VIDEOS))


def min_size(df: DataFrame, least: int = SMALLEST, *, size="size_bytes") -> tuple[DataFrame, DataFrame]:
    """Files of this size or more, and a one-row count of the others."""
    return df.where(F.col(size) >= least), df.where(F.col(size) < least).agg(F.count(F.lit(1)).alias("dropped"))


def filter_by_size(df: DataFrame, least: int = 0, most: int | None = None, *, size="size_bytes") -> DataFrame:
    kept = df.where(F.col(size) >= least)
    return kept if most is None else kept.where(F.col(size) <= most)


def human_bytes(text: str) -> int:
    """Bytes of `10K`, `1.5M`, `2G` or a whole number; anything else is refused."""
    found = re.fullmatch(r"([0-9]*\.?[0-9]+)([kmg])|([0-9]+)", text.strip().lower())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(found[3]) if found[3] else math.floor(float(found[1]) * 1024 ** ("kmg".index(found[2]) + 1))


def size_range_human(df: DataFrame, least: str | None = None, most: str | None = None, *, size="size_bytes") -> DataFrame:
    """Files between two sizes for people, both included; an end that isn't given is open. Files without a size are in no range but the open one."""
    if least is not None:
        df = df.where(F.col(size) >= human_bytes(least))
    return df if most is None else df.where(F.col(size) <= human_bytes(most))


def filter_by_extension(df: DataFrame, suffixes, *, path="path") -> DataFrame:
    return df.where(suffix(F.col(path)).isin(*[s.lower() for s in suffixes]))


def filter_by_pattern(df: DataFrame, include=(), exclude=(), *, path="path") -> DataFrame:
    """Paths that any include pattern matches (all, without one) and no exclude pattern."""
    keep = any_of(F.col(path), [glob_regex(p) for p in include]) if include else F.lit(True)
    return df.where(keep & ~any_of(F.col(path), [glob_regex(p) for p in exclude])) if exclude else df.where(keep)


def any_of(text: Column, expressions: list[str], *, ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{e})" for e in expressions)) if expressions else F.lit(False)


def discover_with_filters(df: DataFrame, *, least: int | None = None, most: int | None = None, suffixes=None, include=(), exclude=()) -> DataFrame:
    out = media_only(df)
    if least is not None or most is not None:
        out = filter_by_size(out, least or 0, most)
    if suffixes:
        out = filter_by_extension(out, suffixes)
    return filter_by_pattern(out, include, exclude) if include or exclude else out


def match_any(df: DataFrame, patterns, *, glob: bool = False, ignore_case: bool = False, on: str = "name", path="path") -> DataFrame:
    """Files that any pattern matches: expressions anywhere, globs as a whole, on the name or the path."""
    text = F.element_at(F.split(F.col(path), "/"), -1) if on == "name" else F.col(path)
    return df.where(any_of(text, [glob_regex(p) if glob else p for p in patterns], ignore_case=ignore_case))


def preset(df: DataFrame, name: str, *, ignore_case: bool = False, path="path") -> DataFrame:
    kinds = {"images": PRESET_IMAGES, "videos": PRESET_VIDEOS, "media": PRESET_IMAGES + PRESET_VIDEOS}
    return match_any(df, [f"*.{e}" for e in kinds[name]], glob=True, ignore_case=ignore_case, path=path)


def exclude_subtree(df: DataFrame, top: str, *, path="relative_path") -> DataFrame:
    """Files that have no folder of this name above them, at any depth."""
    parts = F.split(F.col(path), "/")
    return df.where(~F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), top))


def path_like(df: DataFrame, pattern: str, *, path="path_on_drive") -> DataFrame:
    return df.where(like(F.col(path), pattern))


def status_filter(df: DataFrame, status: str = "all") -> DataFrame:
    return df if status == "all" else df.where(F.col("review_status") == status)


def originals(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("original_file_id").isNotNull()).select(F.col("original_file_id").alias("file_id")).distinct()


def with_is_original(files: DataFrame, groups: DataFrame) -> DataFrame:
    flag = originals(groups).withColumn("_original", F.lit(1))
    return files.join(flag, "file_id", "left").withColumn("is_original", F.coalesce("_original", F.lit(0))).drop("_original")


def export_filter(files: DataFrame, groups: DataFrame, *, include_undecided=False, include_originals=False, include_large=False) -> DataFrame:
    """What a backup takes, with is_original."""
    flagged = with_is_original(files, groups)
    undecided = F.col("review_status") == "undecided"
    keep = F.col("review_status") == "keep"
    if include_undecided:
        keep = keep | undecided
    if include_originals:
        keep = keep | (undecided & (F.col("is_original") == 1))
    return flagged.where(keep if include_large else keep & (F.col("is_large") == 0))


def search_paths(files: DataFrame, pattern: str, limit: int) -> DataFrame:
    """The first matches by id, each with the number of all matches."""
    found = path_like(files, pattern)
    total = found.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(1))
    return found.orderBy("file_id").limit(limit).withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")
