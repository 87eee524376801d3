"""Changes of catalogue tables as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import like
from ..session import settle
from ..sources.schemas import STAGES, STATUSES

KEY = ("drive_id", "path_on_drive")
DEFAULTS = {"copied": 0, "is_large": 0, "review_status": "undecided"}


def assign_ids(df: DataFrame, order: list[str], name: str, *, start: int = 1) -> DataFrame:
    """Consecutive ids in the order of the columns. Rows are sorted by range, numbered within their partition and shifted by the
    sizes of the partitions before it (one number for each comes to the driver), so that no task holds all rows. The order must be total."""
    placed = settle(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    at, shift = start - 1, []
    for part in sorted(sizes):
        shift += [F.lit(part), F.lit(at).cast("long")]
        at += sizes[part]
    if not shift:
        return df.withColumn(name, F.lit(None).cast("long"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn(name, number + F.create_map(*shift)[F.col("_part")]).drop("_part")


def insert_or_ignore(files: DataFrame, new: DataFrame, *, first="file_id") -> DataFrame:
    """files and those new rows whose (drive_id, path_on_drive) is free; of equal new keys the one with the smallest `first` wins, those without it last; NULL keys never conflict."""
    return files.unionByName(free_rows(files, new, first=first), allowMissingColumns=True)


def free_rows(files: DataFrame, new: DataFrame, *, first="file_id") -> DataFrame:
    """The rows that insert_or_ignore adds. Of files only the key is read."""
    for name, value in DEFAULTS.items():
        new = new.withColumn(name, F.coalesce(name, F.lit(value)) if name in new.columns else F.lit(value))
    whole = F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull()
    keyed = chosen(new.where(whole), list(KEY), F.min_by, F.col(first).isNull(), F.col(first))
    free = keyed.join(files.select(*KEY), list(KEY), "left_anti")
    return free.unionByName(new.where(~whole))


def chosen(df: DataFrame, key: list[str], which, *order: Column) -> DataFrame:
    """The row of each key that comes first (which = F.min_by) or last (F.max_by) by the order; ties go by the columns that can be compared. Aggregated, so that a frequent key needs no sort."""
    comparable = [F.col(c) for c, kind in df.dtypes if not kind.startswith("map")]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, *comparable])])
    return df.groupBy(*key).agg(which(F.struct(*df.columns), rank).alias("_row")).select("_row.*")


def insert_or_get_ids(files: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of new with the id of the row that has them, given or newly assigned after the largest: drive_id, path_on_drive, file_id, inserted. set_groups puts groups on the rows found."""
    keys = new.select(*KEY).distinct()
    known = keys.join(files.select(*KEY, "file_id"), list(KEY))
    top = files.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    fresh = assign_ids(keys.join(files.select(*KEY), list(KEY), "left_anti"), list(KEY), "file_id", start=top + 1)
    return known.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def set_groups(files: DataFrame, groups: DataFrame) -> DataFrame:
    """files with the group and original of groups (file_id, group_id, duplicate_of), new or not; of several for a file the last by group_id counts."""
    last = chosen(groups.select("file_id", F.col("group_id").alias("_group"), F.col("duplicate_of").alias("_of")), ["file_id"], F.max_by, F.col("_group"))
    joined = files.join(last, "file_id", "left")
    hit = F.col("_group").isNotNull()
    return joined.withColumns({"group_id": F.coalesce("_group", "group_id"), "duplicate_of": F.when(hit, F.col("_of")).otherwise(F.col("duplicate_of"))}).select(*files.columns)


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the largest order value; one without a value only where no other has one."""
    return chosen(df, key, F.max_by, F.col(order).isNotNull(), F.col(order))


def upsert_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """New rows take the place of those with the same scan_id. Rows without a scan_id are runs of their own: all stay."""
    named = latest(new.where("scan_id is not null"), ["scan_id"], "timestamp")
    kept = runs.join(new.select("scan_id"), "scan_id", "left_anti").unionByName(named, allowMissingColumns=True)
    return kept.unionByName(new.where("scan_id is null"), allowMissingColumns=True)


def get_or_create_drives(drives: DataFrame, seen: DataFrame) -> DataFrame:
    """drives and those seen (label, mount_path) whose mount_path is new; known ones keep their labels."""
    fresh = seen.groupBy("mount_path").agg(F.min("label").alias("label")).join(drives, "mount_path", "left_anti")
    top = drives.agg(F.coalesce(F.max("drive_id"), F.lit(0))).first()[0]
    return drives.unionByName(assign_ids(fresh, ["mount_path"], "drive_id", start=top + 1), allowMissingColumns=True)


def null_orphans(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """References to rows that aren't there become NULL."""
    there = keys.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct().withColumn("_there", F.lit(True))
    return df.join(there, column, "left").withColumn(column, F.when(F.col("_there"), F.col(column))).select(*df.columns)


def set_null_orphans(files: DataFrame, groups: DataFrame, drives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and groups with every dangling reference set to NULL."""
    clean = null_orphans(null_orphans(null_orphans(files, "group_id", groups, "group_id"), "drive_id", drives, "drive_id"), "duplicate_of", files, "file_id")
    return clean, null_orphans(groups, "original_file_id", files, "file_id")


def validate_catalogue(files: DataFrame, groups: DataFrame, drives: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """rule, violations: rows that break each rule."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rules = {
        "status": ~F.col("review_status").isin(*STATUSES),
        "type": ~F.col("type").isin("image", "video"),
        "flags": ~F.col("is_large").isin(0, 1) | ~F.col("copied").isin(0, 1),
        "missing": F.col("size_bytes").isNull() | F.col("type").isNull() | F.col("drive_id").isNull() | F.col("path_on_drive").isNull(),
    }
    one = files.agg(*[count(c).alias(r) for r, c in rules.items()]).unpivot([], list(rules), "rule", "violations")

    def of(rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    paths = files.where(F.col("drive_id").isNotNull() & F.col("path_on_drive").isNotNull()).groupBy(*KEY).count().where("count > 1")
    gone = lambda df, c, keys, key: df.where(F.col(c).isNotNull()).join(keys.select(F.col(key).alias(c)), c, "left_anti")
    parts = [of("unique_path", paths), of("orphan_group", gone(files, "group_id", groups, "group_id")), of("orphan_drive", gone(files, "drive_id", drives, "drive_id")), of("orphan_duplicate", gone(files, "duplicate_of", files, "file_id")), of("orphan_original", gone(groups, "original_file_id", files, "file_id"))]
    held = groups.where("original_file_id is not null").join(files.select(F.col("file_id").alias("original_file_id"), F.col("group_id").alias("of_group")), "original_file_id")
    parts.append(of("original_elsewhere", held.where("not (group_id <=> of_group)")))
    if runs is not None:
        parts.append(of("stage", runs.where(~F.col("stage").isin(*STAGES))))
    for part in parts:
        one = one.unionByName(part)
    return one


def check_status(status: str) -> str:
    if status not in STATUSES:
        raise ValueError(f"review status must be one of {', '.join(STATUSES)}, not {status!r}")
    return status


def mark(files: DataFrame, marks: DataFrame, at: Column) -> DataFrame:
    """files with the statuses and notes of marks (file_id, status, note) and the time; a NULL note clears.

    Marks with a bad status or an unknown file do nothing; mark_report lists them. Of several marks for a file the last
    counts: by the column `seq` where marks have one, else by status and note.
    """
    good = marks.where(F.col("status").isin(*STATUSES))
    order = [F.col("seq")] if "seq" in marks.columns else []
    good = chosen(good, ["file_id"], F.max_by, *order).select("file_id", F.col("status").alias("_status"), F.col("note").alias("_note"))
    joined = files.join(good, "file_id", "left")
    hit = F.col("_status").isNotNull()
    return joined.withColumns({"review_status": F.coalesce("_status", "review_status"), "review_note": F.when(hit, F.col("_note")).otherwise(F.col("review_note")), "reviewed_at": F.when(hit, at).otherwise(F.col("reviewed_at"))}).select(*files.columns)


def mark_report(files: DataFrame, marks: DataFrame) -> DataFrame:
    """file_id, status, old_status, changed, error of each mark; a file without a status changes with any."""
    out = marks.join(files.select("file_id", F.col("review_status").alias("old_status"), F.lit(True).alias("known")), "file_id", "left")
    error = F.when(F.col("known").isNull(), "unknown file").when(~F.col("status").isin(*STATUSES), "bad status")
    return out.select("file_id", "status", "old_status", (error.isNull() & ~F.col("status").eqNullSafe(F.col("old_status"))).alias("changed"), error.alias("error"))


def mark_groups(files: DataFrame, marks: DataFrame, at: Column) -> DataFrame:
    """As mark, for all members of the groups in marks (group_id, status, note); group_mark_report counts what it changes."""
    own = [c for c in ("seq",) if c in marks.columns]
    return mark(files, marks.join(files.select("file_id", "group_id"), "group_id").select("file_id", "status", "note", *own), at)


def group_mark_report(files: DataFrame, marks: DataFrame) -> DataFrame:
    """group_id, status, members, changed (members with another status or none), error of each mark."""
    held = files.join(marks.select("group_id").distinct(), "group_id").groupBy("group_id", "review_status").agg(F.count(F.lit(1)).alias("n"))
    out = marks.join(held, "group_id", "left").groupBy(marks["group_id"], "status").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.when(~F.col("review_status").eqNullSafe(F.col("status")), F.col("n"))), F.lit(0)).alias("changed"))
    error = F.when(F.col("members") == 0, "unknown group").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "bad status")
    return out.select("group_id", "status", "members", F.when(error.isNull(), F.col("changed")).otherwise(F.lit(0)).alias("changed"), error.alias("error"))


def bulk_mark(files: DataFrame, pattern: str, status: str, at: Column) -> DataFrame:
    """All files whose path matches get the status and the time; notes stay."""
    check_status(status)
    hit = like(F.col("path_on_drive"), pattern)
    return files.withColumns({"review_status": F.when(hit, F.lit(status)).otherwise(F.col("review_status")), "reviewed_at": F.when(hit, at).otherwise(F.col("reviewed_at"))})


def promote(files: DataFrame, groups: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and groups after each chosen file (file_id) becomes original of its group; files without a group do nothing."""
    moves = chosen.join(files, "file_id").where("group_id is not null").groupBy("group_id").agg(F.max("file_id").alias("_new"))
    changed = files.join(moves, "group_id", "left").withColumn("duplicate_of", F.when(F.col("_new").isNull(), F.col("duplicate_of")).when(F.col("_new") != F.col("file_id"), F.col("_new"))).select(*files.columns)
    return changed, groups.join(moves, "group_id", "left").withColumn("original_file_id", F.coalesce("_new", "original_file_id")).select(*groups.columns)


def make_original(files: DataFrame, groups: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and groups after each chosen file (file_id) becomes original of a new group; the old group's row stays as it is."""
    top = groups.agg(F.coalesce(F.max("group_id"), F.lit(0))).first()[0]
    named = settle(assign_ids(chosen.join(files.select("file_id"), "file_id", "left_semi").distinct(), ["file_id"], "_group", start=top + 1), "fresh")
    changed = files.join(named, "file_id", "left").withColumns({"duplicate_of": F.when(F.col("_group").isNull(), F.col("duplicate_of")), "group_id": F.coalesce("_group", "group_id")}).select(*files.columns)
    return changed, groups.unionByName(named.select(F.col("_group").alias("group_id"), F.col("file_id").alias("original_file_id")), allowMissingColumns=True)


def move_to_group(files: DataFrame, groups: DataFrame, moves: DataFrame) -> DataFrame:
    """files after moves (file_id, group_id) to existing groups; they point to its original. Of several moves of a file the one to the largest group id counts."""
    to = chosen(moves.join(groups.select("group_id"), "group_id", "left_semi").select("file_id", "group_id"), ["file_id"], F.max_by, F.col("group_id")).join(groups.select("group_id", F.col("original_file_id").alias("_original")), "group_id").select("file_id", F.col("group_id").alias("_group"), "_original")
    hit = F.col("_group").isNotNull()
    joined = files.join(to, "file_id", "left")
    return joined.withColumns({"duplicate_of": F.when(hit, F.col("_original")).otherwise(F.col("duplicate_of")), "group_id": F.coalesce("_group", "group_id")}).select(*files.columns)


def retain_runs(runs: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Runs not older than the cutoff, those without a time too, and one row of counts before and after."""
    stays = F.coalesce(F.col("timestamp") >= cutoff, F.lit(True))
    return runs.where(stays), runs.agg(F.count(F.lit(1)).alias("before"), F.count_if(stays).alias("after"))


def drop_run(runs: DataFrame, scan_id: str) -> DataFrame:
    return runs.where(F.coalesce(F.col("scan_id") != scan_id, F.lit(True)))


def with_registers(files: DataFrame) -> DataFrame:
    """files with the registers that apply_review_events keeps: the number of the event that set the status, and of that which set the note."""
    return files.withColumns({"_seq_mark": F.lit(None).cast("long"), "_seq_note": F.lit(None).cast("long")})


def group_targets(files: DataFrame, events: DataFrame) -> DataFrame:
    """file_id of the members of groups that events mark; of files only the two ids are read."""
    groups = events.where("action = 'mark_group'").select(F.col("target").alias("group_id")).distinct()
    return files.select("file_id", "group_id").join(groups, "group_id", "left_semi").select("file_id")


def apply_review_events(files: DataFrame, events: DataFrame) -> DataFrame:
    """files after events (seq, action, target, status, note, at): `mark` sets a file, `mark_group` a group, `note` a file's note alone.

    The last event of each file and column wins, whatever the order of rows; of events with one number the one with the largest values. Where files have
    registers (with_registers), a column's last writer is kept in its register, so that events may come late, again and in any
    parts: the result is that of all of them at once. Events without a number come before all others.
    """
    valid = events.where(F.col("action").isin("note") | F.col("status").isin(*STATUSES)).withColumn("seq", F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))))
    single = valid.where(F.col("action").isin("mark", "note")).withColumn("file_id", F.col("target"))
    group = valid.where("action = 'mark_group'").join(files.select("file_id", F.col("group_id").alias("target")), "target")
    each = single.unionByName(group)
    marks = F.when(F.col("action") != "note", F.struct("seq", "status", "at"))
    last = each.groupBy("file_id").agg(F.max(marks).alias("_mark"), F.max(F.struct("seq", "note")).alias("_note"))
    joined = files.join(last, "file_id", "left")
    mark, note = F.col("_mark"), F.col("_note")
    kept = "_seq_mark" in files.columns
    if kept:
        mark = F.greatest(mark, F.when(F.col("_seq_mark").isNotNull(), F.struct(F.col("_seq_mark").alias("seq"), F.col("review_status").alias("status"), F.col("reviewed_at").alias("at"))))
        note = F.greatest(note, F.when(F.col("_seq_note").isNotNull(), F.struct(F.col("_seq_note").alias("seq"), F.col("review_note").alias("note"))))
    set_to = lambda winner, field, old: F.when(winner.isNotNull(), winner[field]).otherwise(F.col(old))
    columns = {"review_status": set_to(mark, "status", "review_status"), "reviewed_at": set_to(mark, "at", "reviewed_at"), "review_note": set_to(note, "note", "review_note")}
    if kept:
        columns |= {"_seq_mark": mark["seq"], "_seq_note": note["seq"]}
    return joined.withColumns(columns).select(*files.columns)
