import zipfile

from palimpsest.functions import files
from palimpsest.sources import feeds
from pyspark.sql import functions as F


def test_feeds(spark, tmp_path):
    (tmp_path / "urls.csv").write_text('# comment\n"1","2024-01-01","http://A.example/x","online"\n2,http://b.example:80/,extra,"more, text"\nragged\n\n')
    got = {(r.norm, r.host) for r in feeds.url_feed(spark, str(tmp_path / "urls.csv")).collect()}
    assert got == {("http://a.example/x", "a.example"), ("http://b.example", "b.example")}
    (tmp_path / "ioc.csv").write_text("#h\nx, url, http://c.example/1\nx, domain, D.example\nx\n")
    found, hosts = feeds.indicator_feed(spark, str(tmp_path / "ioc.csv"), 1, 2)
    assert [r.norm for r in found.collect()] == ["http://c.example/1"]
    assert {r.host for r in hosts.collect()} == {"c.example", "d.example"}
    (tmp_path / "hash.csv").write_text(f'first,"{"AB" * 32}",{"cd" * 32}\nnone\n')
    assert [r.sha256 for r in feeds.hash_feed(spark, str(tmp_path / "hash.csv")).collect()] == ["ab" * 32]
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("a.csv", "l1\r\nl2\n")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    assert [r.value for r in feeds.zipped_lines(spark, str(tmp_path / "*.zip")).collect()] == ["l1", "l2"]
    scanned = feeds.scanned_files(spark, str(tmp_path), 4)
    assert scanned.count() == 5 and scanned.agg(F.max(F.octet_length("body"))).first()[0] == 4


def test_exit_codes(spark):
    clean, failed = (spark.createDataFrame([("p", e)], "path string, error string") for e in (None, "denied"))
    hits = spark.createDataFrame([("p",)], "path string")
    assert [feeds.exit_code(*x).first().code for x in ((clean, hits.limit(0)), (clean, hits), (failed, hits))] == [0, 1, 2]


def test_header_candidates_and_times(spark):
    row = spark.range(1).select(files.header_candidates(F.lit("YQphCiBiIAoKYw==")).alias("c"), files.header_candidates(F.lit("%")).alias("bad"), files.filetime(F.lit(116444736000000000)).cast("long").alias("t"), files.filetime(F.lit(0)).alias("none"), files.candidates_in_order(F.array(F.lit(" a")), F.array(F.lit("a"), F.lit("b"))).alias("o")).first()
    assert (row.c, row.bad, row.t, row.none, row.o) == (["a", "b", "c"], None, 0, None, ["a", "b"])
