"""Results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_responses(docs: DataFrame, matches: DataFrame, key: str = "doc", full: bool = False) -> DataFrame:
    """key, response: a JSON array of a document's matches in order of pos, [] for none; with tags and meta if full."""
    fields = ["rule", "namespace", *(["tags", "meta"] if full else [])]
    by_place = lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    rows = matches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("match"))), by_place).alias("found"))
    bare = F.to_json(F.transform("found", lambda m: m["match"]))
    return docs.select(key).distinct().join(rows, key, "left").select(key, F.coalesce(bare, F.lit("[]")).alias("response"))


def metrics(counters: DataFrame) -> DataFrame:
    """One row of counters to rows metric, value."""
    return counters.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in counters.columns])))


def listing(members: DataFrame) -> DataFrame:
    """What a container holds, without bodies: key, pos, path, kind, layer, size, sha256."""
    return members.select("key", "pos", "path", "kind", "layer", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha256"))


def exposition(counters: DataFrame, gauges: tuple[str, ...] = ()) -> DataFrame:
    """One row of counters as the text that monitoring reads: a type and a value for each."""
    lines = [F.concat(F.lit(f"# TYPE {c} {'gauge' if c in gauges else 'counter'}\n{c} "), F.col(c).cast("string"), F.lit("\n")) for c in counters.columns]
    return counters.select(F.concat(*lines).alias("text"))
