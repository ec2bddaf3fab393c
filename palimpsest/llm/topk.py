"""Exact top-k search by distributed histogram selection.

Every query is scored against every row. Global histograms of the scores are summed and refined around each
query's kth value until a bin holds a single score; then rows below it are filtered out, each task keeps its k
best in the order (score, then smaller vec_id), and a ranking of those is the answer. Queries come in blocks of a
fixed size, so what is broadcast and what the driver sees never grows with the data.

Rows without a vec_id, without a vector, or with a null or non-finite component take no part. Of rows that share a
query's vec_id the smallest vector asks, and none is a candidate of it; other repeated rows each take a place.
Vectors of unequal length are compared over the components both have. Components count as at most 1e300 in size
after scaling, and scores are held within plus and minus ``MOST``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import keep, shared_path

#: Queries of a scan, and of one product within it.
SCALE, BLOCK, PORTION, BINS, ROWS = 1024, 4096, 1024, 1024, 2048
#: Scores are longs; this much room lets offsets between any two of them be counted in 64 bits.
MOST = (1 << 63) - 2 * BINS


def usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Components times SCALE, rounded down; short rows are filled with zeros."""
    offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0))
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(SCALE * values[offsets[0] : offsets[-1]]), -1e300, 1e300)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products; through floats only where these are exact."""
    width = min(rows.shape[1], queries.shape[1])
    rows, queries = rows[:, :width], queries[:, :width]
    with np.errstate(over="ignore"):
        small = width * np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) < 1 << 53
    if small:
        return (rows @ queries.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(exact(rows) @ exact(queries).T, -MOST, MOST).astype(np.int64)


def scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each portion of queries: the index of its first, vec_ids, scores[row, query] and which of these count."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            vec_ids, rows = part.column(0).to_numpy(), matrix(part.column(1))
            for first in range(0, len(ids), PORTION):
                yield first, vec_ids, products(rows, queries[first : first + PORTION]), vec_ids[:, None] != ids[first : first + PORTION]


def kth_values(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, reach: float) -> np.ndarray:
    """The kth largest score of each query; the least possible one where there are fewer candidates.

    It lies from ``low`` to ``low + width``; offsets are unsigned, so that any range of longs has one."""
    with np.errstate(over="ignore"):
        norms = np.sqrt((queries * queries).sum(axis=1)) * reach + 2
    bound = np.array([int(min(x, MOST)) for x in norms], np.int64)
    low, width, above = -bound, 2 * bound.astype(np.uint64), np.zeros(len(ids), np.int64)
    open_ = np.ones(len(ids), bool)
    while (wide := open_ & (width > 0)).any():
        at = np.flatnonzero(wide)
        lo, span, some = low[at], width[at], queries[at]
        step = span // np.uint64(BINS) + np.uint64(1)
        sent = vectors.sparkSession.sparkContext.broadcast((ids[at], some, lo, step, span))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, some, lo, step, span = sent.value
            sums = np.zeros((len(ids), BINS), np.int64)
            for first, _, scores, counts in scored(batches, ids, some):
                own = slice(first, first + scores.shape[1])
                over = scores.view(np.uint64) - lo[own].view(np.uint64)
                inside = counts & (scores >= lo[own]) & (over <= span[own])
                bins = (over // step[own]).astype(np.int64) + np.arange(scores.shape[1]) * BINS
                sums[own] += np.bincount(bins[inside], minlength=scores.shape[1] * BINS).reshape(-1, BINS)
            sums = sums.ravel()
            full = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(full), pa.array(sums[full])], ["bin", "n"])

        got = vectors.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros(len(at) * BINS, np.int64)
        sums[got["bin"].to_numpy()] = got["n"].to_numpy()
        downward = above[at][:, None] + np.cumsum(sums.reshape(-1, BINS)[:, ::-1], axis=1)
        enough = downward >= k
        found = enough.any(axis=1)
        place = np.argmax(enough, axis=1)
        before = np.where(place > 0, downward[np.arange(len(at)), place - 1], above[at])
        over = (BINS - 1 - place).astype(np.uint64) * step
        open_[at[~found]] = False  # fewer than k candidates: all of them
        low[at] = np.where(found, (lo.view(np.uint64) + over).view(np.int64), lo)
        width[at] = np.where(found, np.minimum(step - np.uint64(1), span - over), span)
        above[at] = np.where(found, before, above[at])
        sent.unpersist()
    return low


def block_answers(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, reach: float) -> DataFrame:
    least = kth_values(vectors, ids, queries, k, reach)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, queries, least))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, least = sent.value
        held = np.zeros((0, 3), np.int64)
        for start, vec_ids, scores, counts in scored(batches, ids, queries):
            row, query = np.nonzero(counts & (scores >= least[start : start + scores.shape[1]]))
            held = np.concatenate([held, np.stack([start + query, scores[row, query], vec_ids[row]], axis=1)])
            held = held[np.lexsort((held[:, 2], -held[:, 1], held[:, 0]))]
            first = np.searchsorted(held[:, 0], held[:, 0])
            held = held[np.arange(len(held)) - first < k]
        yield pa.record_batch([pa.array(ids[held[:, 0]]), pa.array(held[:, 2]), pa.array(held[:, 1])], ["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = vectors.mapInArrow(best, "query_id long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, asking: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the largest products with each row of ``asking``."""
    spark = vectors.sparkSession
    vectors = usable(vectors)
    asking = keep(usable(asking).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-asking.count() // BLOCK))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * SCALE + 1, F.lit(2.0))))
    reach = float(vectors.agg(F.max(norm)).first()[0] or 0.0) * (1 + 1e-9)
    path = shared_path(spark, "topk")
    for block in range(blocks):
        got = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow()
        queries = matrix(got["embedding"].combine_chunks()) if len(got) else np.zeros((0, 1))
        found = block_answers(vectors, got["vec_id"].to_numpy(), queries, k, reach)
        found.write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
