"""Incremental catalogues by Structured Streaming: a batch reads and writes the buckets that it touches, and repeating it changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cluster import join_existing_groups
from ..operators.hamming import WIDE, banded, bands, in_cells, met_in_cells, nearest_of, parse_phash, wide_bands
from ..operators.mutations import KEY, apply_review_events, free_rows, group_targets
from .buckets import BucketedTable


class Snapshots:
    """Versions of one table: a folder each, named by the batch that wrote it. A batch that runs again writes over its own version and reads the one before."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v")) for p in done)

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{known[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v{version}")


def each_batch(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(act).trigger(availableNow=True).start()


def stream_ingest(stream: DataFrame, table: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Insert new files whose key is free, chunk by chunk, into a table in buckets by KEY. A batch reads the keys of its buckets and adds its rows to them; one that is in the table already does nothing."""

    def act(batch: DataFrame, b: int) -> None:
        if not table.has(checkpoint, b):
            batch.persist()  # its buckets, then its rows
            keyed = batch.where(F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull())
            table.append(with_schema(free_rows(table.read_for(keyed), batch), table.schema), stream=checkpoint, batch=b)
            batch.unpersist()

    return each_batch(stream, checkpoint, act)


def with_schema(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the columns of a schema, NULL where they have none."""
    kinds = rows.sparkSession.createDataFrame([], schema).dtypes
    return rows.select(*[F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds])


class MatchIndex:
    """What arriving files are matched with, in buckets: hashes of contents, bands of perceptual hashes, and the originals of groups with their sizes.

    A batch reads the buckets of its own hashes and bands, and adds what it brings. With `wide` bands (beyond WIDE hashes) a hash
    has fewer candidates and more bands to look up.
    """

    def __init__(self, spark: SparkSession, root: str, k: int, *, wide: bool = False, buckets: int = 64):
        self.spark, self.k = spark, k
        table = lambda name, schema, key: BucketedTable(spark, f"{root}/{name}", schema, key, buckets=buckets)
        self.shas = table("shas", "hash_sha256 string, file_id long, group_id long", ["hash_sha256"])
        self.originals = table("originals", "group_id long, file_id long, width int, height int, size_bytes long", ["group_id"])
        narrow = table("bands", "_band int, _value long, h long, file_id long, group_id long", ["_band", "_value"])
        self.bands = table("wide_bands", narrow.schema, narrow.key) if wide and not narrow.versions() else narrow
        if not wide and not narrow.versions() and (other := table("wide_bands", narrow.schema, narrow.key)).versions():
            self.bands = other
        self.wide = self.bands.root.endswith("/wide_bands")
        self.cuts = wide_bands(k) if self.wide else bands(k)

    def built(self) -> bool:
        return bool(self.originals.versions())

    def build(self, files: DataFrame, groups: DataFrame) -> None:
        """From files (file_id, group_id, hash_sha256, phash, width, height, size_bytes) and groups (group_id, original_file_id). The originals come last: with them the index is built."""
        self.shas.create(self.sha_rows(files))
        self.bands.create(self.band_rows(files))
        held = groups.where("original_file_id is not null").select("group_id", F.col("original_file_id").alias("file_id"))
        self.originals.create(held.join(files.select("file_id", "width", "height", "size_bytes"), "file_id").select("group_id", "file_id", "width", "height", "size_bytes"))

    def sha_rows(self, files: DataFrame) -> DataFrame:
        return files.where("hash_sha256 is not null and group_id is not null").select("hash_sha256", "file_id", "group_id")

    def band_rows(self, files: DataFrame) -> DataFrame:
        hashed = files.where("group_id is not null").select(parse_phash(F.col("phash")).alias("h"), "file_id", "group_id").where("h is not null")
        return banded(hashed, "h", self.cuts).select(F.col("_band").cast("int").alias("_band"), "_value", "h", "file_id", "group_id")

    def match(self, new: DataFrame) -> DataFrame:
        """As match_existing, against the index: file_id, group_id, how of new files (file_id, hash_sha256, phash, type)."""
        sha = self.shas.read_for(new.where("hash_sha256 is not null")).groupBy("hash_sha256").agg(F.min_by("group_id", "file_id").alias("sha_group"))
        exact = new.join(sha, "hash_sha256", "left").select("file_id", "phash", "type", "sha_group")
        asked = exact.where("sha_group is null and type = 'image'").select(F.col("file_id").alias("q"), parse_phash(F.col("phash")).alias("hq")).where("hq is not null")
        probes = in_cells(asked.select(F.col("hq").alias("h"), F.col("hq").alias("x")).distinct(), self.cuts, probe=self.wide)
        known = self.bands.read_for(probes).groupBy("_band", "_value", "h").agg(F.min("file_id").alias("y"), F.min_by("group_id", "file_id").alias("z"))
        met = nearest_of(met_in_cells(probes, known, self.k, self.cuts, most=int(self.wide), pick="nearest"))
        near = asked.join(met, asked["hq"] == met["x"]).select(F.col("q").alias("file_id"), F.col("group_id").alias("near_group"))
        found = exact.join(near, "file_id", "left").withColumn("group_id", F.coalesce("sha_group", "near_group"))
        return found.where("group_id is not null").select("file_id", "group_id", F.when(F.col("sha_group").isNotNull(), "exact").otherwise("near").alias("how"))

    def join(self, new: DataFrame, found: DataFrame) -> DataFrame:
        """join_existing_groups' rows of the new files found (file_id, group_id)."""
        held = self.originals.read_for(found)
        facts = new.select("file_id", "width", "height", "size_bytes").unionByName(held.select("file_id", "width", "height", "size_bytes"))
        return join_existing_groups(facts, held.select("group_id", F.col("file_id").alias("original_file_id")), found)

    def add(self, new: DataFrame, joined: DataFrame, stream: str, batch: int) -> None:
        """Extend the index by new files and the groups they joined; parts that hold the batch already stay."""
        placed = new.drop("group_id").join(joined.select("file_id", "group_id", "promoted"), "file_id")
        if not self.shas.has(stream, batch):
            self.shas.append(self.sha_rows(placed), stream=stream, batch=batch)
        if not self.bands.has(stream, batch):
            self.bands.append(self.band_rows(placed), stream=stream, batch=batch)
        if not self.originals.has(stream, batch):
            first = placed.where("promoted = 1").select("group_id", "file_id", "width", "height", "size_bytes")
            buckets = self.originals.touched(first)
            self.originals.replace(self.originals.read(buckets).join(first, "group_id", "left_anti").unionByName(first), buckets, stream=stream, batch=batch)


def stream_match(stream: DataFrame, files: DataFrame, groups: DataFrame, k: int, out: str, checkpoint: str, *, buckets: int = 64) -> StreamingQuery:
    """For arriving files the group that they join (join_existing_groups' rows), a folder for each batch.

    Files of earlier batches are known to later ones, with the groups they joined and the originals they became: a MatchIndex in `out`/_index,
    built from files and groups at the first start. `out` belongs to one checkpoint. A batch writes its rows, then extends the index from them; one that
    died between the two goes on where it stopped.
    """
    names = ["file_id", "hash_sha256", "phash", "width", "height", "size_bytes"]
    spark = stream.sparkSession
    index = MatchIndex(spark, f"{out}/_index", k, buckets=buckets)
    if not index.built():
        index = MatchIndex(spark, f"{out}/_index", k, wide=files.count() > WIDE, buckets=buckets)
        index.build(files, groups)

    def act(batch: DataFrame, b: int) -> None:
        batch = batch.select(*names, "type").persist()
        if "_SUCCESS" not in index.originals.listed(f"{out}/batch={b}"):
            found = index.match(batch).persist()
            index.join(batch, found).write.mode("overwrite").parquet(f"{out}/batch={b}")
            found.unpersist()
        index.add(batch, spark.read.parquet(f"{out}/batch={b}"), checkpoint, b)
        batch.unpersist()

    return each_batch(stream, checkpoint, act)


def stream_review_events(stream: DataFrame, table: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Apply review events to files with registers (with_registers) in buckets by file_id. A batch writes the buckets of the files that it marks; marks of groups read all files' two ids to find the members."""

    def act(batch: DataFrame, b: int) -> None:
        if table.has(checkpoint, b):
            return
        batch.persist()
        ids = batch.where("action <> 'mark_group'").select(F.col("target").cast("long").alias("file_id"))
        if not batch.where("action = 'mark_group'").isEmpty():
            ids = ids.unionByName(group_targets(table.read(), batch))
        buckets = table.touched(ids)
        table.replace(apply_review_events(table.read(buckets), batch), buckets, stream=checkpoint, batch=b)
        batch.unpersist()

    return each_batch(stream, checkpoint, act)


def stream_first_seen(stream: DataFrame, *, late: str | None = None) -> DataFrame:
    """The first sighting of each (drive_id, path_on_drive); with `late`, keys are kept for that time after `seen_at` only, else for good."""
    if late is None:
        return stream.dropDuplicates(list(KEY))
    return stream.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(list(KEY))


def file_stream(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def listing_stream(spark: SparkSession, root: str, *, files_per_batch: int = 100) -> DataFrame:
    """path, size_bytes, modified of files as they appear below root."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    return rows.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
