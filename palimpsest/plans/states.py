"""Queries with bounded state: frequent rules, alerts that last, a cache of recently used keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import frequent
from palimpsest.plans.catalogue import MATCHES, events_as_matches, query
from palimpsest.streaming import alerts, recency


@query(f"SELECT rule AS name, count(*) AS hits, 0::BIGINT AS missed FROM {MATCHES} GROUP BY rule")
def frequent_rules(read):
    """There are fewer rules than counters, so that nothing is missed."""
    return frequent.frequent(events_as_matches(read), "rule")


@query(
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS series, ts, bool_or(value > 20) AS over FROM events GROUP BY user_id, ts),
r AS (SELECT *, sum(CASE WHEN over THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts) AS run FROM s),
o AS (SELECT series, run, ts, min(ts) OVER (PARTITION BY series, run) AS since FROM r WHERE over)
SELECT series, epoch_us(since) AS since_us, epoch_us(min(ts)) AS fired_us FROM o WHERE epoch_us(ts) - epoch_us(since) >= 3600 * 1000000::BIGINT GROUP BY series, run, since"""
)
def alerts_that_last(read):
    samples = read("events").select(F.col("user_id").alias("series"), "ts", (F.col("value") > 20).alias("over"))
    return alerts.lasting_alerts(samples, 3600).select("series", F.unix_micros("since").alias("since_us"), F.unix_micros("fired").alias("fired_us"))


@query(
    """WITH e AS (SELECT event_id AS id, user_id, event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
l AS (SELECT *, lag(n) OVER (PARTITION BY user_id, key ORDER BY n) AS before FROM e)
SELECT l.id, l.key, CAST(CASE WHEN before IS NOT NULL AND (SELECT count(DISTINCT o.key) FROM e o WHERE o.user_id = l.user_id AND o.n > l.before AND o.n < l.n) < 2 THEN 1 ELSE 0 END AS INTEGER) AS level FROM l"""
)
def recent_keys(read):
    """Two keys for each user; their time is never up."""
    asked = read("events").select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("id"), F.col("user_id").alias("part"))
    return recency.recent_lookups(asked, 1 << 33, 2, 1).select("id", "key", "level")
