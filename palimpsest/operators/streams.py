"""What happens to streams(doc, pos, body) of documents before rules see them: duplicates, channels, combined markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import markers
from palimpsest.operators.matches import WEAK_CLASSES, WEAK_MIN

#: Markers of macro sheets that count together.
SHEET_MARKERS = ("XLM-AUTO-OPEN", "XLM-AUTO-CLOSE", "XLM-HIDDEN-MACROSHEET ", "XLM-DANGEROUS-FUNC ", "XLM-EMUL-DEPTH ")
STACK, STACK_MIN = "XLM-STACK\n", 2
#: Bytes beyond which a body meets the small rule set only.
BIG_FILE = 6 << 20


def stream_key(body: Column) -> Column:
    """Equal for equal bytes alone."""
    return F.sha2(body, 256)


def distinct_streams(streams: DataFrame) -> DataFrame:
    """The first of equal streams of a document (the raw body, at the smallest pos, among them). Keys are aggregated
    before the shuffle; bodies are not shuffled by content but joined back by (doc, pos)."""
    first = streams.groupBy("doc", stream_key(F.col("body")).alias("key")).agg(F.min("pos").alias("pos")).drop("key")
    return streams.join(first, ["doc", "pos"], "left_semi")


def channelled(streams: DataFrame) -> DataFrame:
    """With column channel: the engine's own markers apart from content."""
    return streams.withColumn("channel", markers.channel(F.decode("body", "ISO-8859-1")))


def sheet_stack(found: DataFrame) -> DataFrame:
    """``markers(doc, pos, marker)``: for documents with two or more sheet markers, one stream of them all, in order."""
    one = reduce(lambda a, b: a | b, [F.startswith("marker", F.lit(p)) for p in SHEET_MARKERS])
    stacked = found.where(one).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "marker"))).alias("xs")).where(F.size("xs") >= STACK_MIN)
    return stacked.select("doc", F.concat(F.lit(STACK), F.array_join(F.transform("xs", lambda x: x["marker"]), "\n"), F.lit("\n")).alias("stream"))


def marker_with_payload(carved: DataFrame, marker: str) -> DataFrame:
    """``carved(doc, pos, text)``: one stream for each document, the marker and what was carved, line by line."""
    lines = carved.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("xs"))
    return lines.select("doc", F.concat(F.lit(marker + "\n"), F.array_join(F.transform("xs", lambda x: x["text"]), "\n")).alias("stream"))


def behaviour_scores(found: DataFrame) -> DataFrame:
    """``markers(doc, marker)``: for documents with enough different classes of weak evidence, a stream with their number
    and names in the fixed order."""
    at = F.coalesce(*[F.when(F.startswith("marker", F.lit(c)), F.lit(i)) for i, c in enumerate(WEAK_CLASSES)])
    sets = found.withColumn("at", at).where("at IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("ats")).where(F.size("ats") >= WEAK_MIN)
    names = F.array(*map(F.lit, WEAK_CLASSES))
    listed = F.array_join(F.transform("ats", lambda i: F.element_at(names, i + 1)), "\n")
    return sets.select("doc", F.concat(F.lit("MALDOC-BEHAVIOR-SCORE n="), F.size("ats").cast("string"), F.lit("\n"), listed, F.lit("\n")).alias("stream"))


def macro_streams(streams: DataFrame, macros: DataFrame) -> DataFrame:
    """With column is_vba: whether a stream's bytes are among the document's macro sources (doc, body)."""
    keys = macros.select("doc", stream_key(F.col("body")).alias("key")).distinct().withColumn("is_vba", F.lit(True))
    keyed = streams.withColumn("key", stream_key(F.col("body"))).join(keys, ["doc", "key"], "left").drop("key")
    return keyed.withColumn("is_vba", F.coalesce("is_vba", F.lit(False)))


def rule_set(body: Column, channel: Column) -> Column:
    """Which rules a stream meets: those for markers, the small set for big bodies, or all."""
    return F.when(channel == "marker", "marker").when(F.octet_length(body) > BIG_FILE, "small").otherwise("full")


def first_hits(hits: DataFrame) -> DataFrame:
    """``hits(doc, pos, idx, norm, deobf)`` of all buffers of a document: one row for each address, the first buffer's
    first, which says whether it was written out."""
    first = hits.groupBy("doc", "norm").agg(F.min_by(F.struct("pos", "idx", "deobf"), F.struct("pos", "idx")).alias("x"))
    return first.select("doc", "norm", "x.pos", "x.idx", "x.deobf")
