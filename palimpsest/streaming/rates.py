"""Counters over time; the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ratio(part, whole):
    return part / F.greatest(whole, F.lit(0.001))


def windowed(log: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """``log(ts, key, failed)``: scans, failures and their ratio in each window; a watermark bounds a stream's state."""
    log = log.withWatermark("ts", late) if late else log
    found = log.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("scans"), F.count_if("failed").alias("failures"))
    return found.select(F.col("w.start").alias("start"), "scans", "failures", ratio(F.col("failures"), F.col("scans")).alias("failure_ratio"))


def lasting(series: DataFrame, over, least: int) -> DataFrame:
    """Starts of runs of at least ``least`` consecutive windows for which ``over`` holds (one row a window, few)."""
    ordered = Window.orderBy("start")
    marked = series.withColumn("bad", over).withColumn("run", F.row_number().over(ordered) - F.row_number().over(Window.partitionBy("bad").orderBy("start")))
    return marked.where("bad").groupBy("run").agg(F.min("start").alias("since"), F.count("*").alias("windows")).where(F.col("windows") >= least).select("since", "windows")


def coalesced(requests: DataFrame) -> DataFrame:
    """Equal keys of a micro-batch share one result: key, leader (the first id), followers."""
    return requests.groupBy("key").agg(F.min("id").alias("leader"), (F.count("*") - 1).alias("followers"))
