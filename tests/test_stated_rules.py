"""Queries and their SQL on tables where both used to differ, or took long."""

import time

import duckdb
import pytest

import __spark_entry__ as entry_points
from palimpsest.plans import binaries


def agrees(spark, tmp_path, name, table, sql):
    duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = sorted(map(tuple, entry_points.queries()[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(entry_points.oracle_sql()[name]).fetchall())
    return got


def test_mail_of_no_size_is_unknown(spark, tmp_path):
    got = agrees(spark, tmp_path, "mail_statuses", "events", "SELECT i AS event_id, 'view' AS event_type, (i % 4 * 200)::DOUBLE AS value FROM range(1, 13) t(i)")
    assert dict(got)[4] == "unknown"


def test_a_word_in_the_noise_counts(spark, tmp_path):
    n = next(n for n in range(33, 200_000, 33) if b"the" in binaries.noise(n, 8192))
    if n > 60000:
        pytest.skip("no such length")
    texts = f"SELECT 1 AS doc_id, repeat('x', {n}) AS text UNION ALL SELECT 2, repeat('x', 66) UNION ALL SELECT 3, repeat('x', 60) || ' the x' UNION ALL SELECT 4, repeat('x', 65997 - 1) || 'the' || repeat('y', {11 * 6001 - 65999})"
    got = agrees(spark, tmp_path, "executable_rules", "documents", texts)
    assert (1, "Word_In_Managed") in got and (3, "Word_In_Managed") in got and (2, "Word_In_Managed") not in got


def test_large_bodies_are_made_once(spark, tmp_path):
    began = time.time()
    got = agrees(spark, tmp_path, "stream_rule_sets", "events", "SELECT i AS event_id FROM range(60000) t(i)")
    assert len(got) == 60000 and time.time() - began < 40
