"""Tables of which a batch reads and writes the buckets that it touches only.

Rows lie in buckets by a hash of their key. A version of the table is a manifest: for each bucket, the data folders that hold its rows. Batches
write a folder of their own and then a manifest that names it; readers see a version once its manifest is whole. So a job that dies between
the two leaves the version before, and running the batch again writes its folder anew. The manifest also keeps, for every
stream (by its checkpoint folder), the last batch that is in the table: a batch that is there already is not applied twice.

    root/data/v7/_bucket=12/...     rows that version 7 wrote for bucket 12
    root/manifests/v7               bucket, version (where its rows are) and stream, batch (what is in)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove

#: Folders of a bucket beyond which an append writes it anew as one.
MOST_PARTS = 8
_MANIFEST = "bucket int, version long, stream string, batch long"


class BucketedTable:
    """A table at `root` with a schema, in `buckets` buckets by `key`. Opening one that is there takes its number of buckets."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], *, buckets: int = 64):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        known = self.versions()
        self.buckets = next((r["version"] for r in self.manifest(known[-1]) if r["bucket"] == -1), buckets) if known else buckets

    # What is there

    def listed(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        """Versions with a whole manifest."""
        return sorted(int(v[1:]) for v in self.listed(f"{self.root}/manifests") if v.startswith("v") and "_SUCCESS" in self.listed(f"{self.root}/manifests/{v}"))

    def manifest(self, version: int) -> list:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/v{version}").collect()

    def current(self) -> tuple[int, dict[int, list[int]], dict[str, int]]:
        """The last version, where the rows of its buckets are, and the last batch of each stream. As many entries as buckets come to the driver."""
        known = self.versions()
        if not known:
            return -1, {}, {}
        where: dict[int, list[int]] = {}
        rows = self.manifest(known[-1])
        for r in rows:
            if r["stream"] is None and r["bucket"] >= 0:
                where.setdefault(r["bucket"], []).append(r["version"])
        return known[-1], where, {r["stream"]: r["batch"] for r in rows if r["stream"] is not None}

    def has(self, stream: str, batch: int) -> bool:
        return self.current()[2].get(stream, -1) >= batch

    # Reading

    def bucket(self, *key: Column) -> Column:
        """The bucket of a key (the table's own columns if not given)."""
        return F.pmod(F.xxhash64(*(key or [F.col(c) for c in self.key])), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other folder is opened."""
        _, where, _ = self.current()
        paths = [f"{self.root}/data/v{v}/_bucket={b}" for b, held in sorted(where.items()) if buckets is None or b in set(buckets) for v in held]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame, *key: Column) -> list[int]:
        """The buckets of rows: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(*key)).distinct().collect())

    def read_for(self, rows: DataFrame, *key: Column) -> DataFrame:
        return self.read(self.touched(rows, *key))

    # Writing

    def commit(self, version: int, where: dict[int, list[int]], streams: dict[str, int]) -> None:
        rows = [(-1, self.buckets, None, None)] + [(b, v, None, None) for b, held in where.items() for v in held] + [(None, None, s, b) for s, b in streams.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/v{version}")

    def put(self, rows: DataFrame, version: int) -> list[int]:
        """Write rows by bucket and tell the buckets that got some. A large bucket is dealt to several tasks by AQE's rebalancing."""
        path = f"{self.root}/data/v{version}"
        columns = [c.split()[0].strip("`") for c in self.schema.split(", ")] if "<" not in self.schema else self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns, self.bucket().alias("_bucket")).hint("rebalance", F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(path)
        return [int(x.removeprefix("_bucket=")) for x in self.listed(path) if x.startswith("_bucket=")]

    def create(self, rows: DataFrame) -> None:
        """All rows as the next version, whatever was there."""
        version = self.current()[0] + 1
        self.commit(version, {b: [version] for b in self.put(rows, version)}, self.current()[2])

    def replace(self, rows: DataFrame, buckets: list[int], *, stream: str | None = None, batch: int = -1) -> None:
        """The next version, in which these buckets hold `rows` (which may be read from them) and others what they held."""
        version, where, streams = self.current()
        written = self.put(rows, version + 1)
        where = {b: held for b, held in where.items() if b not in set(buckets)} | {b: [version + 1] for b in written}
        self.commit(version + 1, where, streams | ({stream: batch} if stream is not None else {}))

    def append(self, rows: DataFrame, *, stream: str | None = None, batch: int = -1) -> None:
        """The next version, with rows added. Nothing that is there is read, but for buckets in more than MOST_PARTS folders, which become one."""
        version, where, streams = self.current()
        written = self.put(rows, version + 1)
        for b in written:
            where[b] = [*where.get(b, []), version + 1]
        streams = streams | ({stream: batch} if stream is not None else {})
        self.commit(version + 1, where, streams)
        if many := [b for b in written if len(where[b]) > MOST_PARTS]:
            self.replace(self.read(many), many)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what the last `keep` versions don't need; tells how many folders went. Readers of older versions fail then."""
        known = self.versions()
        needed = {(r["version"], r["bucket"]) for v in known[-keep:] for r in self.manifest(v) if r["stream"] is None}
        gone = [f"{self.root}/manifests/v{v}" for v in known[:-keep]]
        for v in self.listed(f"{self.root}/data"):
            if int(v[1:]) <= (known[-1] if known else -1):  # a later folder may belong to a batch that is being written
                own = [x for x in self.listed(f"{self.root}/data/{v}") if x.startswith("_bucket=")]
                dead = [x for x in own if (int(v[1:]), int(x.removeprefix("_bucket="))) not in needed]
                gone += [f"{self.root}/data/{v}"] if len(dead) == len(own) else [f"{self.root}/data/{v}/{x}" for x in dead]
        for path in gone:
            remove(self.spark, path)
        return len(gone)
