"""Listing, manifests and images of file trees, and catalogue snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES

CANDIDATES = "path string, size_bytes long"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, modified of every file below root; contents aren't read. Names that begin with `.` or `_` aren't listed."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listed.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, content of every file below root."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listed.select("path", F.col("length").alias("size_bytes"), "content")


def write_manifest(files: DataFrame, path: str) -> None:
    files.select("path").write.json(path)


def read_manifest(spark: SparkSession, path: str, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved candidates that still exist, with fresh sizes, and a one-row count of those that don't."""
    saved = spark.read.schema("path string").json(path)
    return listing.join(saved, "path", "left_semi").select("path", "size_bytes"), saved.join(listing, "path", "left_anti").agg(F.count(F.lit(1)).alias("invalid"))


def read_images(spark: SparkSession, root: str, *, drop_unreadable: bool = False) -> DataFrame:
    """path, width, height, pixels, image; unreadable images have NULL sizes, or no row."""
    images = spark.read.format("image").option("dropInvalid", drop_unreadable).option("recursiveFileLookup", "true").load(root)
    size = lambda c: F.when(F.col(f"image.{c}") >= 0, F.col(f"image.{c}"))
    return images.select(F.col("image.origin").alias("path"), size("width").alias("width"), size("height").alias("height"), "image").withColumn("pixels", F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0)))


def read_catalogue(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of one snapshot folder."""
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in TABLES.items()}


def write_catalogue(tables: dict[str, DataFrame], root: str) -> None:
    """A snapshot in a folder of its own; a snapshot is never written over, since its readers may also be its writers."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")


def load_drive_records(files: DataFrame, drive_id: int) -> DataFrame:
    names = ["file_id", "path_on_drive", "size_bytes", "type", "hash_sha256", "phash", "width", "height", "is_large"]
    return files.where(F.col("drive_id") == drive_id).select(*[c for c in names if c in files.columns])


def read_run_config(runs: DataFrame) -> DataFrame:
    """scan_id and its settings as a map of strings."""
    return runs.select("scan_id", F.from_json("config_json", "map<string,string>").alias("config"))


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """A column, or NULL of its type where the table hasn't got it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
