"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, hpylm, license_scan, mixing, secrets, simhash, substring_dedup, topk, toxicity, warc

from .conftest import CLASHING


def labels(docs):
    return docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))


def benchmark(docs):
    return docs.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 200).alias("text"))


OPERATORS = {
    "simhash": (simhash.near_duplicates, 12),
    "licenses": (license_scan.scan, 12),
    "substring": (substring_dedup.dedup, 12),
    "secrets": (secrets.scan, 12),
    "mixing": (mixing.mix_report, 12),
    "toxicity": (lambda d: toxicity.classify(d, labels(d)), 12),
    "hpylm": (hpylm.score, 12),
    "decontamination": (lambda d: decontamination.contaminated(d, benchmark(d)), None),
    "one_of_each": (simhash.one_of_each, None),
    "emit": (mixing.emit, None),
    "redact": (secrets.redact, 12),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    operator, n = OPERATORS[name]
    found = operator(odd).toPandas()
    if n is not None:
        assert len(found) == n
    assert len(found)
    extra = odd.select("*", *[F.lit(c).alias(c) for c in CLASHING])
    again = operator(extra).toPandas()
    if name != "hpylm":
        shared = [c for c in found.columns if c not in CLASHING or c in ("size", "target", "score")]
        if name not in ("one_of_each", "emit", "redact"):
            assert rows(found[shared]) == rows(again[shared])
    assert len(again) == len(found)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name][0](nothing).count() == 0


def test_pages(spark):
    made = spark.createDataFrame([(1, "http://a/\r\nX: y", "<p>"), (2, None, "<p>"), (2, None, "<p>"), (None, "u", "<p>"), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n é" * 5000)], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(made).collect()}
    assert got == {(1, "response", None, 3), (2, "revisit", 1, 3), (None, "revisit", 1, 3), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, len("\r\n\r\nWARC/1.1\r\n é".encode()) * 5000)}
    assert warc.archive_pages(made.limit(0)).count() == 0


def test_vectors(spark):
    made = spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, None]), (4, None), (5, [float("nan"), 1.0]), (6, [-1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = topk.search(made, made.where("vec_id % 100 = 0"), k=3).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(100, 1, 1, 5 << 20), (100, 2, 2, 5 << 20), (100, 3, 2, 5 << 20)]
    assert topk.search(made.limit(0), made.limit(0)).count() == 0
