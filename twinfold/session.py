"""Settings that jobs read from the session, and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, a local one is made on a local master only, as in tests."""
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not here:
        here = spark.conf.get("twinfold.scratch", None)
        if not here:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
            here = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("twinfold.scratch", here)
    return here.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage with a copy that outlives any executor."""
    return Scratch(df.sparkSession).settle(df, name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The settled tables of one job, deleted together once its result is settled elsewhere or written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self, *, but: int = 0) -> None:
        """Delete all tables but the last few; what still reads the others fails."""
        gone, self.paths = (self.paths[:-but], self.paths[-but:]) if but else (self.paths, [])
        for path in gone:
            remove(self.spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
