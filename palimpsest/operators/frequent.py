"""A bounded counter of rule hits: a summary of frequent items that merges.

A summary has at most ``counters`` names. One that grows beyond loses the count of its largest surplus name from every
name (those that reach zero go); what was taken is summed as ``missed``. So every count is too low by at most ``missed``,
names without a counter have occurred at most so often, and ``missed`` is at most all hits / (counters + 1), whatever
the order of merges. Tasks summarise what they read, and summaries are merged in a tree of fixed width, so
no task ever holds more than a few summaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.tables import kept

#: Fixed value: names that are counted at once.
COUNTERS = 1024
#: Summaries that a task merges; names that a task may hold before it shortens its counts.
WIDTH, SLACK = 32, 4
SUMMARY = "part long, name string, hits long, missed long"


def shortened(counts: Counter, counters: int) -> int:
    """Take the largest surplus count from all; returns it."""
    if len(counts) <= counters:
        return 0
    cut = sorted(counts.values(), reverse=True)[counters]
    for name in list(counts):
        counts[name] -= cut
        if counts[name] <= 0:
            del counts[name]
    return cut


def batch(part: int, counts: Counter, missed: int) -> pa.RecordBatch:
    """A summary's rows; one without a name carries what it missed."""
    names = [None, *counts]
    return pa.record_batch([pa.array([part] * len(names), pa.int64()), pa.array(names, pa.string()), pa.array([0, *counts.values()], pa.int64()), pa.array([missed, *[0] * len(counts)], pa.int64())], ["part", "name", "hits", "missed"])


def summarised(rows: DataFrame, counters: int) -> DataFrame:
    """``rows(name, hits, missed)``, a summary for each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, missed = Counter(), 0
        for b in batches:
            for name, hits, lost in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                missed += lost
                if name is not None:
                    counts[name] += hits
                if len(counts) > SLACK * counters:
                    missed += shortened(counts, counters)
        missed += shortened(counts, counters)
        yield batch(TaskContext.get().partitionId(), counts, missed)

    return rows.mapInArrow(work, SUMMARY)


def frequent(hits: DataFrame, name: str, counters: int = COUNTERS) -> DataFrame:
    """name, hits (at least so many, and at most missed more), missed. Null names aren't counted."""
    rows = hits.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.lit(1).cast("long").alias("hits"), F.lit(0).cast("long").alias("missed"))
    found = kept(summarised(rows, counters), "summary")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // WIDTH)
        found = kept(summarised(found.repartition(parts, F.floor(F.col("part") / WIDTH)).select("name", "hits", "missed"), counters), "summary")
    missed = found.agg(F.sum("missed").alias("missed"))
    return found.where("name IS NOT NULL").groupBy("name").agg(F.sum("hits").alias("hits")).crossJoin(F.broadcast(missed))


def top(found: DataFrame, n: int) -> DataFrame:
    """The n most frequent names, equal counts by name: a report, so n rows are all that is wanted."""
    return found.orderBy(F.desc("hits"), "name").limit(n)
