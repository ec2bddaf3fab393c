"""A verdict cache with a time to live from the last put, as state of a key.

A hit doesn't renew the time to live. A request whose scan failed is answered, but its verdict isn't kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "key string, id long, hit boolean"


def lookups(requests: DataFrame, ttl_s: int) -> DataFrame:
    """``requests(key, ts, id)``, also with failed: each with hit, whether an earlier put is at most ``ttl_s`` old.

    Requests are dealt by key and read in order of (key, ts, id); a task keeps the last put of one key, so a hot key
    takes time but no memory."""
    kind = requests.select("key").schema[0].dataType.simpleString()
    failed = F.col("failed") if "failed" in requests.columns else F.lit(False)
    rows = requests.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "id", failed.alias("failed"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, put = object(), None
        for batch in batches:
            hits = np.zeros(batch.num_rows, bool)
            for i, (key, t, _, bad) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if key != now:
                    now, put = key, None
                hits[i] = put is not None and t - put <= ttl_s * 1_000_000
                if not hits[i] and not bad:
                    put = t
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(hits)], ["key", "id", "hit"])

    return rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInArrow(work, f"key {kind}, id long, hit boolean")


class Cache(StatefulProcessor):
    """The last put of a key, in microseconds; it goes by itself some time after it is of no use."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle) -> None:
        self.put = handle.getValueState("put", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        put = self.put.get()[0] if self.put.exists() else None
        got = pd.concat(list(rows)).sort_values(["ts", "id"])
        hits = []
        for t, bad in zip(got["ts"].astype("datetime64[us]").astype("int64"), got["failed"], strict=True):
            hits.append(put is not None and t - put <= self.ttl_s * 1_000_000)
            if not hits[-1] and not bad:
                put = int(t)
        if put is not None:
            self.put.update((put,))
        yield pd.DataFrame({"key": key[0], "id": got["id"].to_numpy(), "hit": hits})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl_s: int) -> DataFrame:
    """The same for a stream of ``requests(key string, ts, id, failed)``; needs a state store that knows columns."""
    return requests.groupBy("key").transformWithStateInPandas(Cache(ttl_s), OUT, "Append", "None")
