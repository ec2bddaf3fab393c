"""Benchmark decontamination by template windows.

Numbers, units after numbers and names (capitalised words inside a sentence) become typed placeholders, so that a
question whose figures or people were changed keeps its template. Windows of ``WORDS`` template tokens are hashed;
windows less than half of which are literal say too little as templates and are hashed with their values, so that only
a verbatim copy has them. A Bloom filter, sized by the benchmark's windows, lets through the document windows that can
match, and a hash join finds those that do. Of the matches on one diagonal (document position minus item position) those count
that are consistent: each value of the item stands where the document has the value that it has in most of that
value's places on the diagonal; windows with another value, or with one that has no such majority, are left out.
Windows whose slots are the same as the item's, or that have none, are verbatim and count whatever the others say.
A document is contaminated by an item if consistent or verbatim windows, each kind for itself, cover ``ENOUGH``
windows (as many as a run of 13 tokens has) or ``SHARE`` of the item. Items of five to seven tokens are one window. Shorter ones, which would stand in any text,
match lines of a document that are the item, with its values, and nothing else; items without a token match nothing.

Null texts are empty. Rows without doc_id or item_id take no part (and are kept when documents are filtered).
Repeated rows count once. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import fresh, keep
from palimpsest.llm.substring_dedup import MULTIPLIERS, window_hashes
from palimpsest.llm.toxicity import SEPARATORS

WORDS, SHORTEST, ENOUGH, SHARE = 8, 5, 6, 0.6
#: Bits of the Bloom filter for each window of the benchmark; its least and most bits (32 MB), beyond which windows are
#: dealt by hash to several filters, and the documents read once for each; rows of a table that is broadcast; beyond
#: it, tasks that a frequent template's rows are dealt to.
BITS, LEAST_BITS, MOST_BITS, BROADCAST_ROWS, SALTS = 16, 1 << 23, 1 << 28, 200_000, 16
UNITS = "percent|%|kg|g|mg|km|m|cm|mm|miles?|feet|foot|ft|inch(?:es)?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|cents?|euros?|pounds?|usd|eur|lit(?:er|re)s?|l|ml|mph|degrees?|meters?|metres?"
SLOT = re.compile(
    rf"(?P<num>[$€£]?\d(?:[\d.,:/]*\d)?)(?:\s?(?P<unit>(?:{UNITS})\b|%))?"
    r"|(?<=[^\W\d_A-Z]\x20)(?P<name>[A-ZÀ-ÖØ-Þ][\w'’-]*(?:\x20[A-ZÀ-ÖØ-Þ][\w'’-]*)*)"
    r"|(?<=[,;:]\x20)(?P<name2>[A-ZÀ-ÖØ-Þ][\w'’-]*(?:\x20[A-ZÀ-ÖØ-Þ][\w'’-]*)*)"
)


def template(text: str) -> tuple[list[bytes], dict[int, str]]:
    """Template tokens, and the values of those that are placeholders."""
    values: list[str] = []

    def replace(m: re.Match) -> str:
        if m["num"]:
            values.append(m["num"].strip("$€£"))
            if m["unit"]:
                values.append(m["unit"].lower())
                return " \1n \1u "
            return " \1n "
        values.append((m["name"] or m["name2"]).lower())
        return " \1p "

    tokens = SLOT.sub(replace, text.replace("\1", " ")).lower().encode().translate(SEPARATORS).split()
    places = [i for i, t in enumerate(tokens) if t[:1] == b"\1"] if values else []
    return tokens, dict(zip(places, values, strict=True))


def hashed(tokens: list[bytes], words: int) -> np.ndarray:
    return window_hashes(np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)), words, MULTIPLIERS[0])


def stated(tokens: list[bytes], slots: dict[int, str]) -> list[bytes]:
    """Tokens with their values, which no template's tokens equal."""
    return [b"\1" + slots[i].encode() if i in slots else token for i, token in enumerate(tokens)]


def windows(tokens: list[bytes], slots: dict[int, str], words: int) -> np.ndarray:
    """The hash of each window, with its values where less than half of it is literal."""
    hashes = hashed(tokens, words)
    if slots and len(hashes):
        open_ = np.zeros(len(tokens) + 1, np.int64)
        open_[np.array(list(slots)) + 1] = 1
        sums = np.cumsum(open_)
        mostly = (sums[words:] - sums[:-words]) * 2 > words
        if mostly.any():
            hashes[mostly] = hashed(stated(tokens, slots), words)[mostly]
    return hashes


def whole(tokens: list[bytes], slots: dict[int, str]) -> int:
    """The hash of a short item, or of a line that may be one."""
    return int(hashed([*stated(tokens, slots), b"\1"], len(tokens) + 1)[0])


def slots_in(slots: dict[int, str], at: int, words: int) -> list[str]:
    return [slots[i] for i in range(at, at + words) if i in slots] if slots else []


def settled(found: list[tuple[int, list[int], list[str], list[str]]]) -> tuple[list[int], list[int], bool]:
    """Of a diagonal's windows (item position, places of the slots, the item's values, the document's): the positions
    of consistent ones, of verbatim ones, and whether all are verbatim."""
    pairs = {place: (was, now) for _, places, item, doc in found for place, was, now in zip(places, item, doc, strict=True)}
    votes: dict[str, Counter] = {}
    for was, now in pairs.values():
        votes.setdefault(was, Counter())[now] += 1
    value = {}
    for was, counts in votes.items():
        (now, n), *rest = counts.most_common(2)
        value[was] = now if not rest or n > rest[0][1] else None
    consistent = [at for at, _, item, doc in found if all(value[was] == now for was, now in zip(item, doc, strict=True))]
    verbatim = [at for at, _, item, doc in found if item == doc]
    return consistent, verbatim, len(verbatim) == len(found)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, pos, words, total (windows of the item), h, slots, their places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(*batch.columns, strict=True):
                tokens, slots = template(text.as_py() or "")
                words = min(WORDS, len(tokens))
                if not words:
                    continue
                hashes = (windows(tokens, slots, words) if words >= SHORTEST else np.array([whole(tokens, slots)], np.uint64)).view(np.int64).tolist()
                rows += [(item_id.as_py(), at, words, len(hashes), h, slots_in(slots, at, words), [i for i in range(at, at + words) if i in slots]) for at, h in enumerate(hashes) if h]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item_id", "item_pos", "words", "total", "h", "item_slots", "slot_places"])

    known = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL").distinct()
    return known.mapInArrow(work, "item_id long, item_pos long, words long, total long, h long, item_slots array<string>, slot_places array<long>")


def bits_at(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a filter of so many bits."""
    return tuple(((hashes >> np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in (0, 32))


def bloom_of(items: DataFrame, bits: int) -> np.ndarray:
    """Each task sets bits in a filter of its own; the driver joins at most eight of them, of ``MOST_BITS`` at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in bits_at(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.record_batch([pa.array([packed.tobytes()])], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for row in items.select("h").coalesce(8).mapInArrow(work, "bits binary").toLocalIterator():
        total |= np.frombuffer(row[0], np.uint8)
    return total


def document_windows(docs: DataFrame, bloom: np.ndarray, sizes: list[int], shard: int = 0, shards: int = 1) -> DataFrame:
    """doc_id, doc_pos, doc_words, doc_h, doc_slots of the windows of one shard that the filter lets through; for sizes
    under ``SHORTEST`` lines of so many tokens, doc_pos then being the line's."""
    sent = docs.sparkSession.sparkContext.broadcast((bloom, sizes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, sizes = sent.value
        bits, short = len(packed) * 8, {s for s in sizes if s < SHORTEST}

        def likely(hashes: np.ndarray) -> np.ndarray:
            some = np.flatnonzero((hashes != 0) if shards == 1 else (hashes != 0) & (hashes % np.uint64(shards) == np.uint64(shard)))
            for k in range(2):
                at = bits_at(hashes[some], bits)[k]
                some = some[(packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            return some

        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns, strict=True):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                tokens, slots = template(text)
                for words in sizes:
                    if words in short:
                        continue
                    hashes = windows(tokens, slots, words)
                    some = likely(hashes)
                    rows += [(doc_id, at, words, h, slots_in(slots, at, words)) for at, h in zip(some.tolist(), hashes[some].view(np.int64).tolist(), strict=True)]
                if short:
                    lines = [(at, *template(line)) for at, line in enumerate(text.split("\n"))]
                    lines = [line for line in lines if len(line[1]) in short]
                    hashes = np.array([whole(t, s) for _, t, s in lines], np.uint64)
                    some = likely(hashes).tolist()
                    rows += [(doc_id, lines[k][0], len(lines[k][1]), h, slots_in(lines[k][2], 0, len(lines[k][1]))) for k, h in zip(some, hashes[some].view(np.int64).tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "doc_pos", "doc_words", "doc_h", "doc_slots"])

    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    return known.mapInArrow(work, "doc_id long, doc_pos long, doc_words long, doc_h long, doc_slots array<string>")


def candidates(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Document windows that some of the ``n`` windows of items may equal, by as many filters as these need."""
    sizes = sorted(r[0] for r in items.select("words").distinct().collect())  # at most eight
    shards = -(-n * BITS // MOST_BITS) or 1
    bits = min(max(LEAST_BITS, 1 << (-(-n * BITS // shards) - 1).bit_length()), MOST_BITS) if n else LEAST_BITS
    # the remainder of the hash as an unsigned number
    own = F.pmod(F.pmod(F.col("h"), F.lit(shards)) + F.when(F.col("h") < 0, (1 << 64) % shards).otherwise(0), F.lit(shards))
    parts = [document_windows(docs, bloom_of(items.where(own == s) if shards > 1 else items, bits), sizes, s, shards) for s in range(shards)]
    return reduce(DataFrame.unionByName, parts)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched (windows of the item that consistent or verbatim matches cover), total, exact."""
    items = keep(item_windows(benchmark), "items")
    n = items.count()
    found = candidates(docs, items, n)
    same = (F.col("doc_h") == F.col("h")) & (F.col("doc_words") == F.col("words"))
    if n <= BROADCAST_ROWS:
        joined = found.join(F.broadcast(items), same)
    else:
        salted = found.withColumn("doc_salt", F.pmod(F.xxhash64("doc_id", "doc_pos"), F.lit(SALTS)))
        joined = salted.join(items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("doc_salt") == F.col("salt")))
    diagonals = joined.groupBy("doc_id", "item_id", "total", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.collect_set(F.struct("item_pos", "slot_places", "item_slots", "doc_slots")).alias("found")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [settled([tuple(w.values()) for w in found]) for found in batch.column(3).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = [pa.list_(pa.int64())] * 2 + [pa.bool_()]
            yield pa.record_batch([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "item_id", "total", "consistent", "verbatim", "exact"])

    counted = diagonals.select("doc_id", "item_id", "total", "found").mapInArrow(work, "doc_id long, item_id long, total long, consistent array<long>, verbatim array<long>, exact boolean")
    places = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    some = counted.where((F.size("consistent") > 0) | (F.size("verbatim") > 0))
    covered = some.groupBy("doc_id", "item_id", "total").agg(F.greatest(places("consistent"), places("verbatim")).alias("matched"), F.min("exact").alias("exact"))
    return covered.where((F.col("matched") >= ENOUGH) | (F.col("matched") >= SHARE * F.col("total")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document: doc_id, n_items, items, coverage (of the item covered best), exact."""
    return matches(docs, benchmark).groupBy("doc_id").agg(
        F.count("*").alias("n_items"),
        F.array_sort(F.collect_list("item_id")).alias("items"),
        F.max(F.col("matched") / F.col("total")).alias("coverage"),
        F.max("exact").alias("exact"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns. Of rows that share a doc_id all go, if one is
    contaminated; rows without a doc_id stay."""
    its_id = fresh(docs, "bad_id")
    bad = keep(contaminated(docs, benchmark).select(F.col("doc_id").alias(its_id)), "contaminated")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(side, F.col("doc_id").cast("long") == F.col(its_id), "left_anti")
