"""Effort that follows the load, one level at a time, as state; and feeds that are read again while a stream runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from palimpsest.operators.tables import kept

OUT = "node string, tick long, level int"


def step(level: int, target: int) -> int:
    """One level towards the target; no level yet adopts it."""
    return target if level < 1 else level + (target > level) - (target < level)


def carried(ticks: DataFrame, most: int) -> DataFrame:
    """Sorted ticks with columns block (where a task's rows stand among all), last (of its node in the block), and after:
    the level behind the tick for each level, from none to ``most``, that the block may begin with. Only the first node
    of a block has one from before; those of the others have a single entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, state, node, waiting = TaskContext.get().partitionId(), True, list(range(most + 1)), None, None

        def finished(rows: pa.RecordBatch, after: list, last: list) -> pa.RecordBatch:
            return pa.record_batch([*rows.columns, pa.array([block] * len(last), pa.int32()), pa.array(last, pa.bool_()), pa.array(after, pa.list_(pa.int32()))], [*rows.schema.names, "block", "last", "after"])

        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, after, last = batch.column("node").to_pylist(), [], []
            if waiting:  # the last row of the batch before ends its node or not
                waiting[2][-1] = nodes[0] != node
                yield finished(*waiting)
            elif first:
                node = nodes[0]
            for i, (its, target) in enumerate(zip(nodes, batch.column("target").to_pylist(), strict=True)):
                if its != node:
                    node, state = its, [0]
                if target is not None:
                    state = [step(level, min(max(target, 1), most)) for level in state]
                after.append(state)
                last.append(i + 1 < len(nodes) and nodes[i + 1] != its)
            first, waiting = False, (batch, after, last)
        if waiting:
            waiting[2][-1] = True
            yield finished(*waiting)

    kinds = ", ".join(f"{c} {ticks.schema[c].dataType.simpleString()}" for c in ("node", "tick", "target"))
    return ticks.mapInArrow(work, f"{kinds}, block int, last boolean, after array<int>")


def steps(ticks: DataFrame, most: int = 10) -> DataFrame:
    """``ticks(node, tick, target)``: node, tick, level after each tick, in order; equal ticks by target.

    A tick maps levels to levels, and such maps compose, so that a node's history may be of any length and lie in many
    tasks: rows are sorted over all nodes, each task composes the maps of its rows, what a block's first node begins
    with follows from the maps of the blocks before it, of which there is one a block, and each row looks its level up.
    Targets are held within 1 and ``most``; a null target moves nothing (level 0: none yet); a null node is a node."""
    ordered = ticks.select("node", "tick", "target").repartitionByRange("node", "tick", "target").sortWithinPartitions("node", "tick", "target")
    found = kept(carried(ordered, most), "steps")
    ends = found.where("last").select("node", "block", "after")
    many = ends.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node").alias("its"))

    def begun(rows: pd.DataFrame) -> pd.DataFrame:
        level, out = 0, []
        for block, after in sorted(zip(rows["block"], rows["after"], strict=True), key=lambda r: r[0]):
            out.append((block, level))
            level = int(after[level if len(after) > 1 else 0])
        return pd.DataFrame(out, columns=["at", "begin"])

    # a block's first node is the only one that can have begun before it
    spread = ends.join(many, F.col("node").eqNullSafe(F.col("its")), "left_semi").select(F.coalesce(F.col("node").cast("string"), F.lit("")).alias("node"), F.col("node").isNull().alias("none"), "block", "after")
    begins = spread.groupBy("node", "none").applyInPandas(begun, "at int, begin int").where("begin > 0")
    level = F.when(F.size("after") > 1, F.get("after", F.coalesce("begin", F.lit(0)))).otherwise(F.get("after", F.lit(0)))
    return found.join(F.broadcast(begins), F.col("block") == F.col("at"), "left").select("node", "tick", level.alias("level"))


class Stepper(StatefulProcessor):
    def init(self, handle) -> None:
        self.level = handle.getValueState("level", "level int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        level = self.level.get()[0] if self.level.exists() else 0
        got = pd.concat(list(rows)).sort_values("tick")
        levels = []
        for target in got["target"]:
            level = step(level, int(target))
            levels.append(level)
        self.level.update((level,))
        yield pd.DataFrame({"node": key[0], "tick": got["tick"].to_numpy(), "level": levels})

    def close(self) -> None:
        pass


def stepped(ticks: DataFrame) -> DataFrame:
    """The same for a stream of ``ticks(node string, tick, target)``."""
    return ticks.groupBy("node").transformWithStateInPandas(Stepper(), OUT, "Append", "None")


class Feed:
    """A table that is read again for each micro-batch; while that fails, or finds nothing, the last good one stays."""

    def __init__(self, read: Callable[[], DataFrame]):
        self.read, self.known = read, None

    def latest(self) -> DataFrame | None:
        try:
            found = self.read()
            if found.limit(1).count():
                self.known = found
        except PySparkException:
            pass
        return self.known


def series(log: DataFrame, width: str, flags: tuple[str, ...], slide: str | None = None) -> DataFrame:
    """``log(ts, *flags)``: for each window its scans, and how many of them have each flag, also as a rate per second."""
    found = log.groupBy(F.window("ts", width, slide or width).alias("w")).agg(F.count("*").alias("scans"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return found.select(F.col("w.start").alias("start"), "scans", *flags, *[(F.col(f) / seconds).alias(f"{f}_rate") for f in flags])

