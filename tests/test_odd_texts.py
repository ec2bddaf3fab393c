"""Queries against their SQL over texts that the tables don't have: none, empty, blank, very long."""

import duckdb
import pytest
from conftest import rows

import __spark_entry__

ODD = [
    (1, ""), (2, "  \t"), (3, None), (4, "a b  c\nd e f"), (5, "{\\rtf1{\\objdata 414243}} x"), (6, "w" * 70_000 + " b"), (7, "\U0001f600" * 40_000 + "  x\ty"),
    (None, "no key"), (4, "a b  c\nd e f"), (8, "q" * 32_767), (9, "q" * 32_768), (10, "u " * 40_000), (11, " " * 40_000), (6, "w" * 70_000 + " b"), (None, "n" * 70_000),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def both(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return rows(__spark_entry__.queries()[name](spark, folder).toPandas()), rows(con.sql(__spark_entry__.oracle_sql()[name]).df())


def test_strings_of_shortcuts(spark, odd):
    got, want = both(spark, odd, "container_shortcut")
    assert got == want and len(got) == 2 * len(ODD)


def test_keyed_digits_of_whole_texts(spark, odd):
    got, want = both(spark, odd, "decode_keyed_digits")
    assert got == want and len({r for r in got}) == len(got) - 2  # the repeated rows
