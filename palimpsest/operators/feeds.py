"""Reputation joins. Feeds are distinct keys; Spark broadcasts them while they are small and shuffles them beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def url_then_host(hits: DataFrame, feed_url: DataFrame, feed_host: DataFrame, base: str, suffix: str = "_HOST") -> DataFrame:
    """``hits(doc, pos, norm, host, deobf)``: the exact URL, else the host; the first occurrence of a URL counts. Feeds of
    indicators call a hit of the host ``_DOMAIN``."""
    once = hits.where("norm <> ''").groupBy("doc", "norm").agg(F.min_by(F.struct("host", "deobf"), "pos").alias("x")).select("doc", "norm", "x.*")
    by_url = once.join(feed_url.select("norm").distinct().withColumn("url_hit", F.lit(True)), "norm", "left")
    by_host = by_url.join(feed_host.select("host").distinct().withColumn("host_hit", F.lit(True)), "host", "left").where("url_hit OR host_hit")
    rule = F.concat(F.lit(base), F.when(F.col("url_hit").isNull(), suffix).otherwise(""), F.when(F.col("deobf"), "_DEOBF").otherwise(""))
    return by_host.select("doc", "norm", rule.alias("rule"))


def in_feed(rows: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    return rows.join(feed.select(key).distinct(), key, "left_semi")
