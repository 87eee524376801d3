"""The catalogue's tables made from the driver's documents and labels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import media_type
from ..operators.cluster import assign_groups, exact_groups
from ..operators.features import fast_fp
from ..operators.mutations import assign_ids
from ..session import settle

EXTENSIONS = (".jpg", ".PNG", ".mp4", ".txt")
LARGE = 4000
#: Bytes of text that are taken from Arrow and split into words together, and words whose bits are added up together.
TAKEN, WORDS = 1 << 20, 1 << 14


def slices(texts: pa.Array, most: int = TAKEN) -> Iterator[list[bytes | None]]:
    """The values of a binary array in order, as many at a time as have `most` bytes (one at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield texts.slice(i, j - i).to_pylist()
        i = j


def word_simhashes(texts: list[bytes | None]) -> list[str | None]:
    """64-bit word SimHashes as hex. Each distinct word is hashed once."""
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for ws in split for w in ws), np.int32, int(sizes.sum()))
    del split
    bits = np.unpackbits(np.frombuffer(b"".join(hashlib.md5(w).digest()[:8] for w in index), np.uint8).reshape(-1, 8), axis=1)
    ends, out = np.cumsum(sizes), [None] * len(texts)
    for d in np.flatnonzero(sizes):
        first, sums = ends[d] - sizes[d], np.zeros(64, np.int64)
        for i in range(first, ends[d], WORDS):  # a word takes 64 bytes
            sums += bits[codes[i : min(ends[d], i + WORDS)]].sum(0, dtype=np.int64)
        out[d] = np.packbits(2 * sums > sizes[d]).tobytes().hex()
    return out


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, phash: 64-bit word SimHash as hex, of documents with a word. No row per word is shuffled, and a task holds the words of TAKEN bytes (or of one text) at a time."""

    @F.arrow_udf("string")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([h for some in slices(texts) for h in word_simhashes(some)], pa.string())

    lowered = F.lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary")
    return docs.select("doc_id", hashed(lowered).alias("phash")).where("phash is not null")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def drives(self) -> DataFrame:
        """One row per source, numbered by name."""
        names = self.table("documents").where("source is not null").select(F.col("source").alias("label")).distinct()
        return assign_ids(names, ["label"], "drive_id").select(F.col("drive_id").cast("long").alias("drive_id"), "label", F.concat(F.lit("/mnt/"), "label").alias("mount_path"))

    @cached_property
    def base(self) -> DataFrame:
        """files without groups and perceptual hashes."""
        d, labels = self.table("documents"), self.table("labels").select("doc_id", "quality")
        ext = F.array(*[F.lit(e) for e in EXTENSIONS])[(F.col("doc_id") % 4).cast("int")]
        path = F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext)
        rows = d.join(labels, "doc_id", "left").withColumn("path_on_drive", path).withColumn("type", media_type(F.col("path_on_drive")))
        rows = rows.join(self.drives.withColumnRenamed("label", "source"), "source", "left")
        side = lambda m, step: F.when(F.col("type") == "image", (100 + F.col("doc_id") % m * step).cast("int"))
        null = lambda k: F.lit(None).cast(k)
        return rows.select(
            F.col("doc_id").alias("file_id"),
            F.sha2("text", 256).alias("hash_sha256"),
            side(7, 10).alias("width"),
            side(5, 10).alias("height"),
            F.col("n_chars").alias("size_bytes"),
            "type",
            "drive_id",
            "path_on_drive",
            (F.col("n_chars") > LARGE).cast("int").alias("is_large"),
            F.lit(0).alias("copied"),
            F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "not_needed").otherwise("undecided").alias("review_status"),
            null("timestamp").alias("reviewed_at"),
            null("string").alias("review_note"),
            null("string").alias("central_path"),
            fast_fp(F.col("text").cast("binary"), 64).alias("fast_fp"),
            F.timestamp_add("HOUR", (F.col("doc_id") % 97).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at"),
        )

    @cached_property
    def hashed(self) -> DataFrame:
        return settle(self.base.join(simhash(self.table("documents")).withColumnRenamed("doc_id", "file_id"), "file_id", "left"), "hashed")

    @cached_property
    def files(self) -> DataFrame:
        """files with the groups of equal contents."""
        placed = assign_groups(self.base, exact_groups(self.base))
        return settle(self.base.join(placed, "file_id", "left"), "files")

    @cached_property
    def groups(self) -> DataFrame:
        return self.files.where("group_id is not null and duplicate_of is null").select("group_id", F.col("file_id").alias("original_file_id"))

    @cached_property
    def listing(self) -> DataFrame:
        return self.base.select(F.col("path_on_drive").alias("path"), "size_bytes", "file_id")

    @cached_property
    def urls(self) -> DataFrame:
        return self.table("pages").select("page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("size_bytes"))
