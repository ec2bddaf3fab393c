"""Bounded counters, alerts and caches: bounds and brute force, batch and stream alike."""

import datetime as dt
import random
from collections import Counter, OrderedDict

from pyspark.sql import functions as F
from test_streams import columns, drained  # noqa: F401 -- a fixture

from palimpsest.operators import frequent
from palimpsest.streaming import alerts, recency

START = dt.datetime(2024, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


def test_counters_stay_within_their_bound(spark):
    rng = random.Random(1)
    names = [f"r{int(rng.paretovariate(0.7))}" for _ in range(30_000)]
    made = spark.createDataFrame([(n,) for n in names] + [(None,)], "rule string").repartition(40)
    got = frequent.frequent(made, "rule", counters=50).collect()
    true, missed = Counter(names), got[0].missed
    assert len(got) <= 50 and missed <= len(names) / 51
    assert all(r.hits <= true[r.name] <= r.hits + missed for r in got)
    held = {r.name for r in got}
    assert all(n in held for n, c in true.items() if c > missed)
    assert [r.name for r in frequent.top(spark.createDataFrame(got), 3).collect()] == [n for n, _ in true.most_common(3)]


def test_few_names_are_counted_exactly(spark):
    made = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3, "rule string").repartition(7)
    assert {(r.name, r.hits, r.missed) for r in frequent.frequent(made, "rule").collect()} == {("a", 5, 0), ("b", 3, 0)}
    assert frequent.frequent(made.limit(0), "rule").count() == 0


SAMPLES = [("a", 0, True), ("a", 60, True), ("a", 130, True), ("a", 140, False), ("a", 150, True), ("a", 200, True), ("b", 0, True), ("b", 50, False), ("b", 60, True), ("b", 170, True), ("b", 300, True)]
ALERTS = {("a", at(0), at(130)), ("b", at(60), at(170))}


def test_alerts_of_a_batch(spark):
    rows = [(s, at(t), o) for s, t, o in SAMPLES] + [("b", at(50), False), (None, at(1), True), ("a", None, True), ("a", at(70), None)]
    made = spark.createDataFrame(rows, "series string, ts timestamp, over boolean")
    assert {tuple(r) for r in alerts.lasting_alerts(made, 100).collect()} == ALERTS
    assert alerts.lasting_alerts(made.limit(0), 100).count() == 0


def test_alerts_of_a_stream_with_late_samples(spark, columns, tmp_path):  # noqa: F811
    """Out of order within the watermark counts as in order; a sample behind it is dropped."""
    schema = "series string, ts timestamp, over boolean"
    batches = [[SAMPLES[i] for i in (1, 0, 7, 6)], [SAMPLES[i] for i in (3, 2, 8)], [SAMPLES[i] for i in (4, 5, 9)], [SAMPLES[10], ("z", 2000, False)], [("a", 10, False), ("z", 2100, False)], [("z", 4000, False)]]
    for b in batches:
        spark.createDataFrame([(s, at(t), o) for s, t, o in b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(spark, alerts.streamed_alerts(stream, 100, "200 seconds"), tmp_path, "lasting_alerts")
    assert {tuple(r) for r in got} == ALERTS


def by_hand(requests, ttl, most, second):
    keys, out = OrderedDict(), {}
    for key, t, i, failed in sorted(requests, key=lambda r: (r[1], r[2])):
        until = keys.get(key, -1)
        if until > t:
            out[i] = 1
            keys.move_to_end(key)
            continue
        out[i] = 2 if second.get(key, -1) > t else 0
        if out[i] or not failed:
            keys[key] = t + ttl
            keys.move_to_end(key)
            while len(keys) > most:
                keys.popitem(last=False)
    return out


def test_cache_of_recent_keys(spark):
    rng = random.Random(2)
    asked = [(f"k{int(rng.paretovariate(0.8)) % 40}", rng.randrange(5000), i, rng.random() < 0.1) for i in range(3000)]
    second = {"k1": 900, "k7": 4000}
    made = spark.createDataFrame([(k, at(t), i, f) for k, t, i, f in asked], "key string, ts timestamp, id long, failed boolean")
    table = spark.createDataFrame([(k, at(t)) for k, t in second.items()] + [("k7", at(10))], "key string, expires timestamp")
    got = {r.id: r.level for r in recency.recent_lookups(made, 300, 6, 1, table).collect()}
    assert got == by_hand(asked, 300, 6, second) and set(got.values()) == {0, 1, 2}
    dealt = recency.recent_lookups(made, 300, 6, 4, table).collect()
    assert len(dealt) == 3000 and any(r.evicted for r in dealt)


def test_cache_of_recent_keys_in_a_stream(spark, columns, tmp_path):  # noqa: F811
    """Eviction of the least recently used, expiry, refresh by a put, and the second level, over several batches."""
    asked = [("a", 0, 1), ("b", 1, 2), ("a", 2, 3), ("c", 3, 4), ("b", 4, 5), ("a", 5, 6), ("a", 200, 7), ("a", 250, 8), ("d", 260, 9)]
    schema = "key string, ts timestamp, id long, failed boolean"
    for k, t, i in asked:
        spark.createDataFrame([(k, at(t), i, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([("d", at(1000))], "key string, expires timestamp")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 20).parquet(str(tmp_path / "in"))
    got = drained(spark, recency.streamed_lookups(stream, 100, 2, 1, table, forgetting=False), tmp_path, "recent_levels")
    assert {r.id: r.level for r in got} == by_hand([(k, t, i, False) for k, t, i in asked], 100, 2, {"d": 1000})
