from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df) -> list[tuple]:
    """Rows of a pandas frame in a form that two engines share: columns by name, figures to nine digits, nulls alike, sorted."""
    import math

    import pandas as pd

    def shown(x) -> str:
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return "NULL"
        x = x.item() if hasattr(x, "item") else x
        if isinstance(x, bool):
            return str(int(x))
        if isinstance(x, (int, float)):
            return f"{float(x):.9g}"
        return str(x).removesuffix(" 00:00:00")

    return sorted(tuple(shown(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    return rows
