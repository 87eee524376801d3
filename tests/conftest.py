import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Whether a query gives its SQL's rows."""

    def plain(v):
        return int(v) if isinstance(v, float) and v.is_integer() else None if v != v else v

    def rows(columns, found):
        return sorted((tuple(plain(v) for v in r) for r in found), key=str), columns

    def check(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = [tuple(r[n] for n in names) for r in df.collect()]
        found = duck.sql(sql)
        assert sorted(found.columns) == names
        want = found.select(*[f'"{n}"' for n in names]).fetchall()
        assert rows(names, got) == rows(names, want)

    return check
