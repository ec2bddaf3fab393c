"""Alerts that fire when a condition has held for a while, a state machine for each series: quiet, pending since the
first sample over the limit, firing once it has held for the wanted time, quiet again with the first sample below.

Batches and streams give the same rows. A stream keeps samples until its watermark has passed them and takes them in order
of their time, so that late ones (within the watermark) count where they belong; those that come later still are
dropped. A batch deals rows by series and reads each in order, holding one series' state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "series string, since timestamp, fired timestamp"
#: No time: the machine is quiet.
QUIET = -1


def step(since: int, fired: int, at: int, over: bool, wanted: int) -> tuple[int, int, bool]:
    """The state after a sample, and whether the alert fires with it. Times are microseconds."""
    if not over:
        return QUIET, QUIET, False
    since = at if since == QUIET else since
    fires = fired == QUIET and at - since >= wanted
    return since, at if fires else fired, fires


def lasting_alerts(samples: DataFrame, wanted_s: int) -> DataFrame:
    """``samples(series, ts, over)``: series, since, fired: an alert for each stretch over the limit that lasts. Of samples
    of one series and time, one over the limit counts. Null series, times or values don't count."""
    rows = samples.where("series IS NOT NULL AND ts IS NOT NULL AND over IS NOT NULL").select(F.col("series").cast("string").alias("series"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "over")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, since, fired = None, None, QUIET, QUIET
        for batch in batches:
            out = []
            for series, t, over in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if series != now:
                    now, last, since, fired = series, None, QUIET, QUIET
                if t == last:
                    continue
                last = t
                since, fired, fires = step(since, fired, t, over, wanted_s * 1_000_000)
                if fires:
                    out.append((series, since, fired))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array(c, pa.timestamp("us", "UTC")) for c in columns[1:])], ["series", "since", "fired"])

    return rows.repartition("series").sortWithinPartitions("series", "t", F.desc("over")).mapInArrow(work, OUT)


class Machine(StatefulProcessor):
    """Samples that the watermark hasn't passed, by their time, and the machine's two times."""

    def __init__(self, wanted_s: int):
        self.wanted = wanted_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t long", "over boolean")
        self.times = handle.getValueState("times", "since long, fired long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for t, over in zip(batch["ts"].astype("datetime64[us]").astype("int64"), batch["over"], strict=True):
                t, over = int(t), bool(over)
                if t // 1000 <= passed:
                    continue
                known = self.waiting.getValue((t,))[0] if self.waiting.containsKey((t,)) else False
                self.waiting.updateValue((t,), (over or known,))
                self.handle.registerTimer(t // 1000 + 1)
        return iter(())  # alerts come with the timers

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((t[0], o[0]) for t, o in self.waiting.iterator() if t[0] < upto)
        since, fired = self.times.get() if self.times.exists() else (QUIET, QUIET)
        out = []
        for t, over in due:
            self.waiting.removeKey((t,))
            since, fired, fires = step(since, fired, t, over, self.wanted)
            if fires:
                out.append((key[0], pd.Timestamp(since, unit="us"), pd.Timestamp(fired, unit="us")))
        if due:
            self.times.update((since, fired))
        if out:
            yield pd.DataFrame(out, columns=["series", "since", "fired"])

    def close(self) -> None:
        pass


def streamed_alerts(samples: DataFrame, wanted_s: int, late: str) -> DataFrame:
    """The same for a stream of ``samples(series string, ts timestamp, over boolean)``."""
    rows = samples.where("series IS NOT NULL AND ts IS NOT NULL AND over IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("series").transformWithStateInPandas(Machine(wanted_s), OUT, "Append", "EventTime")
