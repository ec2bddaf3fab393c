"""Ranked lexical search over a tiered index.

Terms are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. A posting is a term's frequency
in a document; what it adds to a score, once for each time an item has the term, is its impact

    w * ((1000000000 * tf) div (1000 * tf + 12 * m)),  w = floor(1000 * ln((2N + 2) / (2df + 1))),
    m = 100 - 25 + ((25 * n * N) div L)

with N documents that have terms, L terms in all, n in the document, df documents with the term.

Documents are read once. Each task writes shards of a few thousand documents with the postings of the terms that the
items have; counts are summed over all documents. Impacts are then known, and a histogram of them gives the
limits of the tiers: postings of the highest impacts make the first, the rest the last. The index is one table,
partitioned by tier, and knows for each term and tier the largest impact below it: the residual bound.

Search goes down the tiers. On each, shards score their documents by what the tiers so far hold and give their best k
for each item; the kth best of all is a score that the answer reaches at least. An item is proven if its terms'
residual bounds add up to less: a document that isn't in the tiers read can't be among its best. Only documents
whose score plus the bounds of the terms they haven't shown reaches the kth best are then scored whole, in their
shards. Items without proof fall through to the next tier; on the last nothing is left out and scores are exact.

Items come in blocks of a fixed size, so what a task holds of them does not grow. Equal scores rank by doc_id; rows
that share a doc_id are documents of their own. Null texts have no terms, null doc_ids come last among equals, items
without terms have no answers, items that share an item_id are one item whose terms add up. Very long texts
are one document each. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import UPPER, keep

K = 20
#: Shares of postings that the tiers down to each, but the last, hold at least.
TIERS = (0.1, 0.4)
#: Items of a block; documents and bytes of text of a shard; cells of the matrix of terms and documents scored at once.
ITEMS, SHARD_DOCS, SHARD_BYTES, CELLS = 512, 4096, 1 << 24, 1 << 21
#: Bytes that separate terms become blanks, A-Z become a-z.
TO_TERMS = bytes(b + 32 if chr(b) in UPPER else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_TERMS).split() if text else []


def packed(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join([len(c).to_bytes(8, "little") + np.ascontiguousarray(c, c.dtype.newbyteorder("<")).tobytes() for c in columns]), 1)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(data), 0, []
    for kind in kinds:
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


#: A shard, before impacts are known: its documents (doc_id, whether it has one, n) and its postings by term (term, document, tf), and the counts it adds.
RAW = "shard long, docs binary, postings binary, dfs binary, n_docs long, n_terms long"


def shards(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of the documents. ``vocabulary`` is that of a block of items."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def shard(ids: list[int | None], sizes: list[int], found: list[dict[int, int]], n_docs: int) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(found), dtype="<i4"), [len(f) for f in found])
        term = np.fromiter((t for f in found for t in f), "<i4", len(at))
        tf = np.fromiter((c for f in found for c in f.values()), "<i8", len(at))
        order = np.lexsort((at, term))
        term, at, tf = term[order], at[order], tf[order]
        having = packed(*np.unique(term, return_counts=True))
        documents = packed(np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], "<u1"), np.array(sizes, "<i8"))
        return pa.record_batch([pa.array([documents]), pa.array([packed(term, at, tf)]), pa.array([having]), pa.array([n_docs]), pa.array([sum(sizes)])], ["docs", "postings", "dfs", "n_docs", "n_terms"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        ids: list[int | None] = []
        sizes: list[int] = []
        found: list[dict[int, int]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                split = terms(text.as_py())
                if not split:
                    continue
                size += text.as_buffer().size
                ids.append(doc_id)
                sizes.append(len(split))
                found.append(Counter([known[t] for t in split if t in known]))
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard(ids, sizes, found, len(ids))
                    ids, sizes, found, size = [], [], [], 0
        if ids:
            yield shard(ids, sizes, found, len(ids))

    return texts.mapInArrow(work, RAW.removeprefix("shard long, ")).withColumn("shard", F.monotonically_increasing_id())


def impacts(weights: np.ndarray, sizes: np.ndarray, term: np.ndarray, at: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 75 + 25 * sizes * n_docs // max(1, n_terms)
    return weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[at]))


class Index:
    """The tiered index of the documents for one block of items: a table of packed postings (tier, shard, docs,
    postings), the terms' weights, and bounds[tier][term], the largest impact in the tiers below."""

    def __init__(self, table: DataFrame, weights: np.ndarray, bounds: np.ndarray):
        self.table, self.weights, self.bounds = table, weights, bounds


def build(docs: DataFrame, vocabulary: dict[bytes, int], tiers: tuple[float, ...] = TIERS) -> Index:
    raw = keep(shards(docs, vocabulary), "shards")
    n_docs, n_terms = (int(x or 0) for x in raw.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    def dfs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for data in batch.column(0):
                term, n = unpacked(data.as_py(), "<i4", "<i8")
                total[term] += n
        term = np.flatnonzero(total)
        yield pa.record_batch([pa.array(term), pa.array(total[term])], ["term", "n"])

    summed = raw.select("dfs").mapInArrow(dfs, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[summed["term"].to_numpy()] = summed["n"].to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def with_impacts(docs: bytes, postings: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        term, at, tf = unpacked(postings, "<i4", "<i4", "<i8")
        return term, at, impacts(weights, unpacked(docs, "<i8", "<u1", "<i8")[2], term, at, tf, n_docs, n_terms)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings by the bits of their impact and three more: bins an eighth wide."""
        total: Counter = Counter()
        for batch in batches:
            for data, postings in zip(*batch.columns, strict=True):
                found = with_impacts(data.as_py(), postings.as_py())[2]
                shift = np.maximum(0, np.frexp(found.astype(np.float64))[1] - 4)
                total.update(dict(zip(*(x.tolist() for x in np.unique((found >> shift) << shift, return_counts=True)), strict=True)))
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["impact", "n"])

    counted = sorted(map(tuple, raw.select("docs", "postings").mapInArrow(histogram, "impact long, n long").groupBy("impact").agg(F.sum("n")).collect()), reverse=True)
    all_, cuts = sum(n for _, n in counted), []
    for share in tiers:
        seen = 0
        for impact, n in counted:
            seen += n
            if seen >= share * all_:
                break
        cuts.append(impact if counted else 0)
    limits = np.array(cuts[::-1], np.int64)

    def tiered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data, postings in zip(*batch.columns, strict=True):
                term, at, found = with_impacts(data.as_py(), postings.as_py())
                tier = len(limits) - np.searchsorted(limits, found, side="right")
                for k in range(len(limits) + 1):
                    own = tier == k
                    kept = packed(term[own], at[own], found[own])
                    most = np.zeros(len(vocabulary), np.int64)
                    np.maximum.at(most, term[own], found[own])
                    has = np.flatnonzero(most)
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([shard.as_py()]), pa.array([data.as_py()]), pa.array([kept]), pa.array([packed(has, most[has])])], ["tier", "shard", "docs", "postings", "most"])

    kept = keep(raw.select("shard", "docs", "postings").mapInArrow(tiered, "tier int, shard long, docs binary, postings binary, most binary"), "index", by="tier")

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(limits) + 1, len(vocabulary)), np.int64)
        for batch in batches:
            for tier, data in zip(*batch.columns, strict=True):
                term, impact = unpacked(data.as_py(), "<i8", "<i8")
                total[tier.as_py()][term] = np.maximum(total[tier.as_py()][term], impact)
        tier, term = np.nonzero(total)
        yield pa.record_batch([pa.array(tier), pa.array(term), pa.array(total[tier, term])], ["tier", "term", "impact"])

    largest = kept.select("tier", "most").mapInArrow(most, "tier long, term long, impact long").groupBy("tier", "term").agg(F.max("impact").alias("impact")).toArrow()
    bounds = np.zeros((len(limits) + 2, len(vocabulary)), np.int64)
    bounds[largest["tier"].to_numpy(), largest["term"].to_numpy()] = largest["impact"].to_numpy()
    bounds = np.maximum.accumulate(bounds[::-1], axis=0)[::-1][1:]
    return Index(kept.drop("most"), weights, bounds)


def scored(blobs: dict[int, tuple[bytes, bytes]], asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, which of them are there, scores[item, document] and shown[term, document] of one shard, in
    portions of documents. ``asked[item, term]`` counts terms; sums stay below 2^53, where floats are exact, or are made of
    integers."""
    docs = next(iter(blobs.values()))[0]
    ids, there, _ = unpacked(docs, "<i8", "<u1", "<i8")
    held = [unpacked(p, "<i4", "<i4", "<i8") for _, p in blobs.values()]
    term, at, impact = (np.concatenate(c) for c in zip(*held, strict=True))
    exact = int(asked.sum(axis=1).max(initial=0)) * int(impact.max(initial=0)) < 1 << 53
    counts = asked.astype(np.float64 if exact else np.int64)
    order = np.argsort(at, kind="stable")
    term, at, impact = term[order], at[order], impact[order]
    portion = max(16, CELLS // max(1, asked.shape[1]))
    for first in range(0, len(ids), portion):
        a, b = np.searchsorted(at, (first, first + portion))
        some = slice(first, min(first + portion, len(ids)))
        full = np.zeros((asked.shape[1], some.stop - first), counts.dtype)
        full[term[a:b], at[a:b] - first] = impact[a:b]
        shown = np.zeros(full.shape, bool)
        shown[term[a:b], at[a:b] - first] = True
        yield ids[some], there[some] == 1, (counts @ full).astype(np.int64), shown


def by_shard(rows: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[bytes, bytes]]]:
    """The tiers of each shard; rows come sorted by shard."""
    now, held = None, {}
    for batch in rows:
        for tier, shard, docs, postings in zip(*(batch.column(c) for c in ("tier", "shard", "docs", "postings")), strict=True):
            if shard.as_py() != now and held:
                yield held
                held = {}
            now = shard.as_py()
            held[tier.as_py()] = (docs.as_py(), postings.as_py())
    if held:
        yield held


ANSWERS = "item long, doc_id long, score long"


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def best_of(item: np.ndarray, ids: np.ndarray, there: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each item, in the order of the answer."""
    order = np.lexsort((ids, ~there, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def answers(tables: DataFrame, asked: np.ndarray, k: int, least: np.ndarray | None = None, bounds: np.ndarray | None = None) -> DataFrame:
    """item (row of ``asked``), doc_id, score: the best k of each item among a task's shards by the tiers of
    ``tables``. With ``least`` and ``bounds``, tiers down to ``bounds``'s come first and only documents that may
    reach ``least`` are scored by all."""
    last = bounds[0] if bounds is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def shrunk() -> list[tuple[np.ndarray, ...]]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            best = best_of(*columns, k)
            return [tuple(c[best] for c in columns)]

        for blobs in by_shard(batches):
            whole = scored(blobs, asked)
            upper = scored({t: b for t, b in blobs.items() if t <= last}, asked) if last is not None else None
            for ids, there, scores, _ in whole:
                good = scores > 0
                if upper is not None:
                    _, _, partial, shown = next(upper)
                    rest = asked.astype(np.float64) @ (bounds[1][:, None] * ~shown).astype(np.float64)
                    good &= partial + rest * (1 + 1e-9) + 1 >= least[:, None]
                if len(ids) > k:
                    edge = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                    good &= scores >= edge[:, None]
                item, at = np.nonzero(good)
                held.append((item, ids[at], there[at], scores[item, at]))
                size += len(item)
            if size > 1 << 18:
                held = shrunk()
                size = len(held[0][0])
        if held:
            item, ids, there, score = shrunk()[0]
            yield pa.record_batch([pa.array(item), pa.array(ids, mask=~there), pa.array(score)], ["item", "doc_id", "score"])

    return tables.repartition("shard").sortWithinPartitions("shard", "tier").mapInArrow(work, ANSWERS)


def search_block(index: Index, asked: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score, rank for the rows of ``asked``."""
    spark, tiers = index.table.sparkSession, len(index.bounds)
    open_ = np.arange(len(asked))
    done: list[DataFrame] = []

    def numbered(found: DataFrame, items: np.ndarray) -> DataFrame:
        names = F.array(*[F.lit(int(i)) for i in items])
        return found.withColumn("item", F.element_at(names, (F.col("item") + 1).cast("int")).cast("long"))

    for tier in range(tiers):
        if not len(open_):
            break
        some = asked[open_]
        found = ranked(answers(index.table.where(F.col("tier") <= tier), some, k), k)
        if tier == tiers - 1:
            done.append(keep(numbered(found, open_), "answers"))
            break
        reached = found.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).toArrow()
        least = np.zeros(len(some), np.int64)
        full = reached["n"].to_numpy() >= k
        least[reached["item"].to_numpy()[full]] = reached["score"].to_numpy()[full]
        unseen = [sum(int(c) * int(b) for c, b in zip(row[np.flatnonzero(row)], index.bounds[tier][np.flatnonzero(row)], strict=True)) for row in some]
        proven = np.array([u < s for u, s in zip(unseen, least.tolist(), strict=True)], bool)
        if proven.any():
            exact = ranked(answers(index.table, some[proven], k, least[proven], (tier, index.bounds[tier])), k)
            done.append(keep(numbered(exact, open_[proven]), "answers"))
        open_ = open_[~proven]
    out = done[0] if done else spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, tiers: tuple[float, ...] = TIERS, block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, with scores above 0."""
    spark = docs.sparkSession
    asking = keep(items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.concat_ws(" ", F.collect_list(F.col("text").cast("string"))).alias("text")), "items")
    blocks = max(1, -(-asking.count() // block))
    out: list[DataFrame] = []
    for at in range(blocks):
        got = asking.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == at).toArrow()
        wanted = [Counter(terms(t)) for t in got["text"].to_pylist()]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
        asked = np.zeros((len(wanted), len(vocabulary)), np.int64)
        for row, counts in zip(asked, wanted, strict=True):
            row[[vocabulary[t] for t in counts]] = list(counts.values())
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(wanted)), pa.int64()), "item_id": got["item_id"].combine_chunks()}))
        found = search_block(build(docs, vocabulary, tiers), asked, k)
        out.append(keep(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "found"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
totals AS (SELECT count(*) AS all_docs, CAST(sum(len(ws)) AS BIGINT) AS all_terms FROM words WHERE len(ws) > 0),
asked AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
postings AS (SELECT row, doc_id, len(ws) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, ws, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, all_docs),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(qtf * w * ((1000000000::BIGINT * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
