"""Parts of messages: which of them are scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: parts of a message that are scanned.
FAN_OUT = 32


def chosen(parts: DataFrame, least: float, most: float, fan_out: int = FAN_OUT) -> DataFrame:
    """``parts(message, part, digest, size)``: those of a size within bounds, the first of each digest, at most so many of
    a message. Digests are aggregated before the shuffle by message."""
    once = parts.where(F.col("size").between(least, most)).groupBy("message", "digest").agg(F.min("part").alias("part"))
    nth = F.row_number().over(Window.partitionBy("message").orderBy("part"))
    return once.withColumn("nth", nth).where(F.col("nth") <= fan_out).drop("nth")
