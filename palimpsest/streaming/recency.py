"""A verdict cache of bounded size: keys are dealt to parts, each of which keeps its most recently used keys, and
behind all parts stands a table, the second level.

A look-up hits the first level if the key is there and its time isn't up (which doesn't renew it, but makes the key the
most recently used); else the second level, if it knows the key until a later time, and the key is taken up into the
first with a new time. A miss puts the key in both, unless its scan failed. The part's least recently used keys go
when it is full. A part's memory is bounded by ``most`` keys, whatever the data."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "key string, id long, level int, evicted int"
MISS, FIRST, SECOND = 0, 1, 2


class Recent:
    """One part: key to the time when it expires, in order of use."""

    def __init__(self, most: int, ttl: int, known: list[tuple[str, int]] = ()):
        self.most, self.ttl, self.keys = most, ttl, OrderedDict(known)

    def put(self, key: str, now: int) -> int:
        """Returns how many keys had to go."""
        self.keys[key] = now + self.ttl
        self.keys.move_to_end(key)
        gone = max(0, len(self.keys) - self.most)
        for _ in range(gone):
            self.keys.popitem(last=False)
        return gone

    def asked(self, key: str, now: int, second: int | None, failed: bool) -> tuple[int, int]:
        """The level that knows the key, and how many keys had to go. ``second``: when the second level's entry expires."""
        until = self.keys.get(key)
        if until is not None and now < until:
            self.keys.move_to_end(key)
            return FIRST, 0
        self.keys.pop(key, None)
        if second is not None and now < second:
            return SECOND, self.put(key, now)
        return MISS, 0 if failed else self.put(key, now)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def joined(requests: DataFrame, second: DataFrame | None) -> DataFrame:
    """part-less requests (key, t, id, failed, second) in microseconds. Of a table's entries for a key the last to
    expire counts, so that the join is one to one."""
    failed = F.col("failed") if "failed" in requests.columns else F.lit(False)
    rows = requests.select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("id").cast("long").alias("id"), F.coalesce(failed, F.lit(False)).alias("failed"), *[c for c in requests.columns if c == "part"])
    if second is None:
        return rows.withColumn("second", F.lit(None).cast("long"))
    known = second.groupBy(F.col("key").cast("string").alias("key")).agg(F.max(F.unix_micros(F.col("expires").cast("timestamp"))).alias("second"))
    return rows.join(known, "key", "left")


def recent_lookups(requests: DataFrame, ttl_s: int, most: int, parts: int, second: DataFrame | None = None) -> DataFrame:
    """``requests(key, ts, id)``, also with failed and part (else keys are dealt to ``parts``), and ``second(key, expires)``: key, id, level (0: miss), evicted. Null
    keys aren't cached and miss. Requests of a part are read in order of (ts, id)."""
    rows = joined(requests, second)
    if "part" not in rows.columns:
        rows = rows.withColumn("part", part_of(F.col("key"), parts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = None, None
        for batch in batches:
            out = []
            for part, key, t, _, bad, other in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "t", "id", "failed", "second")), strict=True):
                if part != now:
                    now, recent = part, Recent(most, ttl_s * 1_000_000)
                out.append((MISS, 0) if key is None else recent.asked(key, t, other, bad))
            levels, evicted = zip(*out, strict=True) if out else ((), ())
            yield pa.record_batch([batch.column("key"), batch.column("id"), pa.array(levels, pa.int32()), pa.array(evicted, pa.int32())], ["key", "id", "level", "evicted"])

    ordered = rows.select("part", "key", "t", "id", "failed", "second").repartition("part").sortWithinPartitions("part", "t", "id")
    return ordered.mapInArrow(work, OUT)


class RecentState(StatefulProcessor):
    """The same as state of a part: its keys with their times, numbered in order of use. A timer forgets what has
    expired while nobody asked."""

    def __init__(self, ttl_s: int, most: int, forgetting: bool):
        self.ttl_s, self.most, self.forgetting = ttl_s, most, forgetting

    def init(self, handle) -> None:
        self.handle = handle
        self.keys = handle.getListState("keys", "key string, until long")

    def stored(self) -> Recent:
        return Recent(self.most, self.ttl_s * 1_000_000, [(k, u) for k, u in self.keys.get()] if self.keys.exists() else [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = self.stored()
        got = pd.concat(list(rows)).sort_values(["t", "id"])
        out = [(k, i, *recent.asked(k, int(t), None if pd.isna(s) else int(s), bool(bad))) for k, t, i, bad, s in zip(got["key"], got["t"], got["id"], got["failed"], got["second"], strict=True)]
        self.keys.put([(k, u) for k, u in recent.keys.items()]) if recent.keys else self.keys.clear()
        if self.forgetting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_s * 1000)
        yield pd.DataFrame(out, columns=["key", "id", "level", "evicted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        left = [(k, u) for k, u in self.stored().keys.items() if u > now]
        self.keys.put(left) if left else self.keys.clear()
        return iter(())

    def close(self) -> None:
        pass


def streamed_lookups(requests: DataFrame, ttl_s: int, most: int, parts: int, second: DataFrame | None = None, forgetting: bool = True) -> DataFrame:
    """The same for a stream of requests; a micro-batch's requests are taken in order of (ts, id). Times are those of the
    requests; only ``forgetting`` what has expired, by a timer, goes by the clock. Without it, keys go when others
    need their room."""
    rows = joined(requests, second).where("key IS NOT NULL").withColumn("part", part_of(F.col("key"), parts))
    return rows.groupBy("part").transformWithStateInPandas(RecentState(ttl_s, most, forgetting), OUT, "Append", "ProcessingTime" if forgetting else "None")
