"""Listing of a folder tree that every executor mounts, by rounds over a frontier of folders, with unreadable entries and links."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, partitions, settle

_ENTRY = "path string, kind string, size_bytes long, modified double, place string"


def entries(folder: str, follow: bool) -> Iterator[tuple]:
    """(path, kind, size_bytes, modified, place) of a folder's entries: file, folder, or unreadable; place tells folders apart whatever path leads there.

    Regular files and folders only; with follow, those behind links too, under the link's path, else links are passed over. A link to nowhere is unreadable if links
    are followed. A folder that can't be read is one unreadable entry, as is a name that isn't UTF-8.
    """
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    e.path.encode()
                    s = os.stat(e.path) if follow else os.lstat(e.path)
                except (OSError, UnicodeEncodeError):
                    yield e.path.encode(errors="replace").decode(), "unreadable", None, None, None
                    continue
                if stat.S_ISREG(s.st_mode):
                    yield e.path, "file", s.st_size, s.st_mtime, None
                elif stat.S_ISDIR(s.st_mode):
                    yield e.path, "folder", None, None, f"{s.st_dev}:{s.st_ino}"
    except OSError:
        yield folder, "unreadable", None, None, None


def walk(spark: SparkSession, root: str, *, follow: bool = False) -> tuple[DataFrame, DataFrame]:
    """path, size_bytes, modified of the regular files below root, and one row: files, folders, unreadable.

    root is a local path, or file:// one, that all executors see; other stores are listed by list_files. Each round lists the folders
    found in the round before, dealt over the tasks; a folder is listed once, under the path that comes first in its round, so links in a circle end. Names that
    begin with a point count like others. A root that isn't there is one unreadable entry.
    """
    scratch = Scratch(spark)
    root = root.removeprefix("file://").removeprefix("file:").rstrip("/") or "/"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ENTRY.split(", ")]
        for pdf in batches:
            for folder in pdf["path"]:
                rows = []
                for row in entries(folder, follow):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names).astype({"size_bytes": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"size_bytes": "Int64"})

    frontier = spark.createDataFrame([(root,)], "path string")
    found, seen = None, None
    while True:
        here = scratch.settle(frontier.repartition(partitions(spark), "path").mapInPandas(listed, _ENTRY), "listed")
        found = here if found is None else found.unionByName(here)
        folders = here.where("kind = 'folder'").groupBy("place").agg(F.min("path").alias("path"))
        new = scratch.settle(folders if seen is None else folders.join(seen, "place", "left_anti"), "frontier")
        if new.isEmpty():
            break
        seen = new.select("place") if seen is None else seen.unionByName(new.select("place"))
        frontier = new.select("path")
    files = settle(found.where("kind = 'file'").select("path", "size_bytes", F.timestamp_seconds("modified").alias("modified")), "files")
    count = lambda k: F.count_if(F.col("kind") == k)
    counts = settle(found.agg(count("file").alias("files"), count("folder").alias("folders"), count("unreadable").alias("unreadable")), "counts")
    scratch.clear()
    return files, counts
