"""Pages of ordered rows without sorting or skipping all that comes before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sorted to cut a page, and ranges that are counted at a time.
FEW, RANGES = 50_000, 1024


def page_of(rows: DataFrame, key: str, page: int, per_page: int, *, few: int = FEW) -> DataFrame:
    """Rows of one page in ascending order of a whole-number key; those without it are on no page.

    Rows are counted by ranges of the key, 1,024 at a time, until the page lies in ranges of few rows; these alone are read whole and sorted.
    The counts read the key's column only and come to the driver, a number a range. A key that many rows share can't be narrowed; they are sorted together.
    """
    if page < 1 or per_page < 1:
        raise ValueError("pages are numbered from 1 and hold a row at least")
    at, skip = F.col(key).cast("long"), (page - 1) * per_page
    low, high, n = rows.where(at.isNotNull()).agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    if not n or skip >= n:
        return rows.limit(0)
    while n > few + per_page and low < high:
        width = -(-(high - low + 1) // RANGES)
        part = F.floor((at.cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long")
        counts = sorted(map(tuple, rows.where(at.between(low, high)).groupBy(part).agg(F.count(F.lit(1))).collect()))
        before, first, last, n = 0, None, None, 0
        for i, c in counts:
            if before + c > skip and before < skip + per_page:
                first, last, n = (i if first is None else first), i, n + c
            elif first is None:
                before += c
                continue
            else:
                break
            before += c
        skip -= sum(c for i, c in counts if i < first)
        narrowed = low + first * width, min(high, low + (last + 1) * width - 1)
        if narrowed == (low, high):
            break
        low, high = narrowed
    return rows.where(at.between(low, high)).orderBy(key).offset(skip).limit(per_page)


class PageTable:
    """Rows written once in an order, in parts by range with a count of each, for pages of any number: a page opens the part or two that it lies in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, rows: DataFrame, *order) -> PageTable:
        """Sorted by range; a row's place in its part is its number there. The order must be total."""
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
        rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")).write.partitionBy("_part").parquet(f"{self.root}/rows")
        rows.limit(0).write.parquet(f"{self.root}/columns")  # an empty table has no part to tell them
        self.reader().parquet(f"{self.root}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{self.root}/counts")
        return self

    def reader(self):
        columns = self.spark.read.parquet(f"{self.root}/columns").schema
        return self.spark.read.schema(columns.add("_place", "long").add("_part", "integer")).option("basePath", f"{self.root}/rows")

    def counts(self) -> list[tuple[int, int]]:
        """(part, rows) in order, a number a part."""
        return sorted(map(tuple, self.spark.read.parquet(f"{self.root}/counts").select("_part", "n").collect()))

    def page(self, page: int, per_page: int) -> DataFrame:
        """The rows of a page with their rank, from 0."""
        if page < 1 or per_page < 1:
            raise ValueError("pages are numbered from 1 and hold a row at least")
        first, before, starts = (page - 1) * per_page, 0, []
        for part, n in self.counts():
            if before < first + per_page and before + n > first:
                starts.append((part, before))
            before += n
        rows = self.reader()
        if not starts:
            return rows.parquet(f"{self.root}/rows").limit(0).drop("_part").withColumnRenamed("_place", "rank")
        start = F.create_map(*[F.lit(x) for s in starts for x in s])[F.col("_part")]
        shown = rows.parquet(*[f"{self.root}/rows/_part={part}" for part, _ in starts]).where(F.col("_place") >= max(0, first - starts[0][1]) if len(starts) == 1 else F.lit(True))
        ranked = shown.withColumn("rank", F.col("_place") + start).where(F.col("rank").between(first, first + per_page - 1))
        return ranked.drop("_part", "_place").orderBy("rank")
