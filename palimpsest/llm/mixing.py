"""Mixing sources to target weights, with DataFrame functions only.

Words are summed by source; targets share all words by weight, but stop at ``most`` times what a source has, the
excess going to the others by weight (a water level, found by one pass over the sources in order of the level at
which they are full). The repetition rate of a source is its target over its words. A document is emitted
floor(rate) times, plus once more if a number drawn from the SHA-256 of its doc_id lies below the fraction.

Null texts have no words, a null source is a source of its own and comes last, a null doc_id draws like any
other value. Repeated rows draw alike. A source without words has target 0. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, fresh, keep

WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix"
#: Sources up to which their table (a few dozen bytes each) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of a SHA-256."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From ``sized(source, size)``: its_source, source_size, target. The windows run over sources, not documents."""
    sources = sized.groupBy(F.col("source").alias("its_source")).agg(F.sum("size").alias("source_size"))
    by_name, by_level = Window.orderBy(F.asc_nulls_last("its_source")), Window.orderBy("full_at", F.asc_nulls_last("its_source"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    known = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumns(
        {
            "place": F.row_number().over(by_level),
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = F.col("left").cast("double") / F.col("open")
    first_open = F.min(F.when(F.col("full_at") >= level, F.struct("place", level.alias("level")))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(first_open * F.col("weight"), F.col("cap").cast("double")))
    return known.select("its_source", "source_size", target.alias("target"))


def taken(docs: DataFrame, copies: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents' columns and a struct ``copies``: n (how often the mix takes each row), source_size, target."""
    sized = docs.select(F.col("source"), words_in(F.col("text")).alias("size"))
    known = keep(targets(sized, weights, most), "targets")
    its_source, its_size, its_target = (fresh(docs, n) for n in ("its_source", "its_size", "its_target"))
    side = known.toDF(its_source, its_size, its_target)
    if known.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    joined = docs.join(side, F.col("source").eqNullSafe(F.col(its_source)), "left")
    rate = F.when(F.col(its_size) > 0, F.least(F.col(its_target) / F.col(its_size), F.lit(float(most)))).otherwise(F.lit(0.0))
    n = F.floor(rate) + F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(*[F.col(c) for c in docs.columns], F.struct(n.cast("long").alias("n"), F.col(its_size).alias("source_size"), F.col(its_target).alias("target")).alias(copies))


def mix_report(docs: DataFrame) -> DataFrame:
    found = taken(docs.select("doc_id", "text", "source"), "copies").withColumn("size", words_in(F.col("text")))
    return found.select("doc_id", "size", "copies.source_size", "copies.target", (F.col("copies.n") * F.col("size")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, numbered from 1 in column copy. All columns stay as they
    are, but for one named copy, which the numbers replace."""
    docs = docs.drop("copy")
    copies = fresh(docs, "copies")
    found = taken(docs, copies).where(F.col(copies)["n"] > 0)
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)["n"])).alias("copy"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight FROM sums),
caps AS (SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / weight AS full_at FROM ranked),
steps AS (
  SELECT *, row_number() OVER w AS place,
    (SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    (SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM caps WINDOW w AS (ORDER BY full_at, source NULLS LAST)),
level AS (SELECT min_by(remaining::DOUBLE / weights::DOUBLE, place) AS level FROM steps WHERE full_at >= remaining::DOUBLE / weights::DOUBLE),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM level) * weight, cap::DOUBLE)) AS target FROM caps),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(sha256('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
