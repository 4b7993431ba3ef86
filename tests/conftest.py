import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def plain(v):
    """A comparable value: no numpy, floats to six decimals, missing as None."""
    if v is None or str(v) in ("<NA>", "NaT"):
        return None
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return None if v != v else round(float(v), 6)
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if type(v).__name__.startswith(("int", "uint")):
        return int(v)
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


def duck(sf_dir, tables=None):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if tables is None or t not in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, frame in (tables or {}).items():
        con.register(f"{name}_frame", frame)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_frame")
    return con


def same_as_sql(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), duck(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
