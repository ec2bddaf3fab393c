"""Streams: files that arrive, a cache and a stepper with state, windows with a watermark, feeds that are read again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import rules
from palimpsest.sources import feeds
from palimpsest.streaming import cache, effort_steps, rates

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def columns(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def drained(spark, made, tmp_path, name, mode="append"):
    job = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    return spark.table(name).collect()


def requests(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    return [("a", at(0), 1, False), ("a", at(50), 2, False), ("a", at(120), 3, False), ("b", at(0), 4, True), ("b", at(10), 5, False), ("b", at(20), 6, False)]


HITS = {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_cache_of_a_batch(spark):
    made = spark.createDataFrame(requests(spark), "key string, ts timestamp, id long, failed boolean")
    assert {r.id: r.hit for r in cache.lookups(made, 100).collect()} == HITS


def test_cache_of_a_stream_keeps_state_between_batches(spark, columns, tmp_path):
    schema = "key string, ts timestamp, id long, failed boolean"
    for i, row in enumerate(requests(spark)):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(spark, cache.cached(stream, 100), tmp_path, "cache_hits")
    assert len(got) == 6 and sum(r.hit for r in got) >= 1 and not {r.id: r.hit for r in got}[4]


def test_stepper_of_a_stream(spark, columns, tmp_path):
    made = spark.createDataFrame([("n", t, x) for t, x in enumerate((4, 7, 7, 1))], "node string, tick long, target int")
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    got = drained(spark, effort_steps.stepped(stream), tmp_path, "effort_levels")
    assert [r.level for r in sorted(got, key=lambda r: r.tick)] == [4, 5, 6, 5]


def test_files_that_arrive_are_scanned(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"password here")
    (tmp_path / "in" / "b.txt").write_bytes(b"nothing")
    rule = rules.Rule("secret", "n", {"a": ("text", "password", frozenset())})
    stream = feeds.arriving_files(spark, str(tmp_path / "in"))
    got = drained(spark, rules.matched(stream, F.decode("body", "ISO-8859-1"), [rule], "path"), tmp_path, "scan_hits")
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.txt"]


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "k", m % 5 == 0) for m in range(0, 60, 3)]
    spark.createDataFrame(rows, "ts timestamp, key string, failed boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, key string, failed boolean").parquet(str(tmp_path / "in"))
    got = drained(spark, rates.windowed(stream, "20 minutes", "5 minutes"), tmp_path, "rates_seen", "complete")
    assert sorted(r.scans for r in got) == [6, 7, 7] and sum(r.failures for r in got) == 4


def test_lasting_alerts(spark):
    rows = [(i, i in (2, 3, 4, 7)) for i in range(10)]
    series = spark.createDataFrame(rows, "start long, over boolean")
    assert [tuple(r) for r in rates.lasting(series, F.col("over"), 2).collect()] == [(2, 3)]


def test_a_feed_that_fails_stays(spark, tmp_path):
    path = str(tmp_path / "feed")
    feed = effort_steps.Feed(lambda: spark.read.parquet(path))
    assert feed.latest() is None
    spark.range(3).write.parquet(path)
    assert feed.latest().count() == 3
    old = effort_steps.Feed(lambda: spark.read.parquet(str(tmp_path / "gone")))
    old.known = feed.latest()
    assert old.latest().count() == 3


def test_rule_sets(spark):
    made = [rules.Rule(n, ns, {"a": ("text", "x", frozenset())}, tags=t, private=p) for n, ns, t, p in (("A", "one", (), False), ("B", "two", ("marker",), False), ("C", "one", (), True))]
    names = lambda **k: [r.name for r in rules.rule_set(made, **k)]
    assert names(kind="full", deny=frozenset({"a", "c"})) == ["B", "C"] and names(kind="marker") == ["B"] and names(kind="small", small=frozenset({"one"})) == ["A", "C"]
    rows = made[:1]
    engine = rules.Engine(rows)
    bad = engine.register_rules(spark.createDataFrame([("f", "{"), ("f", '{"rule": "x"}')], "namespace string, value string"))
    assert engine.rules == rows and bad.count() == 2
    with pytest.raises(ValueError, match="hexadecimal"):
        rules.hex_pattern("G0")
