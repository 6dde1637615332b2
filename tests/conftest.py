"""One Spark session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def smallest():
    if not (DATA / "sf0.001").exists():
        pytest.skip("no test data here")
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(smallest):
    import duckdb

    con = duckdb.connect()
    for f in Path(smallest).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(v):
    """A value in a form that both engines share."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, (int, bool)) else repr(v)


@pytest.fixture(scope="session")
def same_rows(spark, smallest, duck):
    """Hold a query against its SQL on the smallest data."""

    def check(query, sql):
        df = query(spark, smallest)
        names = sorted(df.columns)
        left = sorted(repr([plain(x) for x in r]) for r in df.select(*names).collect())
        res = duck.execute(f"select * from ({sql}) as checked")
        have = [x[0] for x in res.description]
        assert sorted(have) == names
        right = sorted(repr([plain(r[have.index(n)]) for n in names]) for r in res.fetchall())
        assert left == right

    return check
