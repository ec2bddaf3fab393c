import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def rows(frame):
    """Rows of a pandas frame with columns in order of name, whole floats as ints, sorted."""
    import pandas as pd

    plain = lambda v: None if not hasattr(v, "__len__") and pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else repr(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v
    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))
