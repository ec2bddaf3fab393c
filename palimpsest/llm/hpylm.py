"""Hierarchical Pitman-Yor language model, trained by Gibbs sampling over shards of the vocabulary.

Every word seen in training is a context with a restaurant of its own for the words after it. Contexts whose words
end alike (``CLASSES`` classes of last letters) share a parent restaurant, and all parents share the root, whose base
is uniform. A dish has the same shard at all three levels, so a table opened or closed sends its customer up, or takes
it away, within the shard. A sweep removes and reseats every customer of every dish, one by one (of ``EXACT`` customers
and more, one in ``BLOCKS`` at once): whether the one removed sat alone has the odds of the generalised Stirling numbers,
and it then sits at a new table with weight (strength + discount * tables) * parent's probability. A lone customer of a
dish is left out, as it can only come back to a table of its own. What shards need of one another are the
tables of whole restaurants: those of contexts are summed by owners (ranges of context names) between sweeps, those of
classes and root by aggregation, so dishes of a sweep see the other dishes' tables of the sweep before. Strengths are
drawn anew after each sweep by auxiliary variables; discounts are estimated from counts of counts. Predictive
probabilities are averaged over the states after ``BURN_IN``.

Texts are cut into words once. A portion of documents sends each shard the portion's different pairs in order, and
notes, for every token in the same order, which document it is from. Pairs of held-out documents go along with no
customers: they sit nowhere, but have a context and a parent. A shard keeps the places of each portion's pairs among its
own; in the end it answers with a logarithm for each place, which are summed by document after the portion's notes. So
what is sent for a token doesn't depend on the size of the corpus or of the model.

A context is named by 30 bits of its hash and its class: of 10^5 contexts of a class about one in 20,000 shares its
restaurant with another. Null texts are empty and have one token, the end. A null doc_id counts as training. Repeated
rows repeat. Without any training token every token has the base probability. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ASCII_LOWER, discard, keep, released, shared_path, trimmed
from palimpsest.llm.substring_dedup import columns_packed, columns_unpacked, mixed

FOLDS, HELD_OUT = 10, 0
CLASSES, SWEEPS, BURN_IN, SEED = 1024, 3, 1, 7
#: Bytes that are cut into words at once, tokens of a portion, tokens of the corpus for each shard.
PART, PORTION, PER_SHARD = 2_000_000, 800_000, 1 << 21
#: Bytes of places and notes in a row, and of answers in a batch.
CHUNK, BATCH = 32 << 20, 4 << 20
#: The end of a text as a word and as a context.
END, END_NAME = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0xE0D0E0D0E0D0E0D1 >> 34 << 10)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
VALUES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NAME_BITS = 40
NAMES = np.uint64((1 << NAME_BITS) - 1)
#: Customers up to which Stirling numbers are tabulated; beyond, a saddle point stands for them. Blocks in which as many
#: customers and more are reseated.
EXACT, BLOCKS = 128, 64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# ---------------------------------------------------------------- tokens


@dataclass
class Portion:
    """Documents in a row: their uids, doc_ids and whether they are held out, and of each token its hash, its context's
    name and its document. The last token is an end."""

    uids: list[int]
    doc_ids: list[int | None]
    held_out: list[bool]
    token: np.ndarray
    context: np.ndarray
    row: np.ndarray


def class_of(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The class of a word by its last two bytes (0 before the only one)."""
    return mixed((before.astype(np.uint64) << np.uint64(8) | last.astype(np.uint64)) + GOLDEN) & np.uint64(CLASSES - 1)


def powers(of: np.uint64, n: int) -> np.ndarray:
    """The first to the nth, in the one array that they take."""
    out = np.full(n, of)
    return np.cumprod(out, out=out)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and classes of the words in a run of bytes.

    A hash is a polynomial of random values of the bytes, by differences of prefix sums times an inverse power."""
    word = np.concatenate(([False], ~BLANK[data], [False]))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    sums = powers(MULTIPLIER, len(data))
    sums *= VALUES[data]
    np.cumsum(sums, out=sums)
    hashes = sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    del sums
    if len(starts):
        hashes = mixed(hashes * powers(INVERSE, len(data))[starts])
    before = np.where(ends - starts > 1, data[ends - 2], 0) if len(starts) else data[:0]
    return starts, hashes, class_of(before, data[ends - 1])


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[Portion]:
    """From batches (uid, text, doc_id, held_out). Documents begin after an end."""
    held: tuple[list, ...] = ([], [], [], [])
    size = 0

    def made() -> Portion:
        uids, doc_ids, out, texts = held
        data = np.frombuffer(b"\n".join(texts).translate(ASCII_LOWER), np.uint8)
        starts, hashes, classes = words_of(data)
        row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        lengths = np.bincount(row, minlength=len(texts)) + 1
        token, name = np.full(len(starts) + len(texts), END), np.full(len(starts) + len(texts), END_NAME)
        at = np.arange(len(starts)) + row
        token[at] = hashes
        name[at] = hashes >> np.uint64(34) << np.uint64(10) | classes
        return Portion(uids, doc_ids, out, token, np.concatenate(([END_NAME], name[:-1])), np.repeat(np.arange(len(texts)), lengths))

    for batch in batches:
        for uid, text, doc_id, out in zip(*batch.columns, strict=True):
            held[0].append(uid.as_py())
            held[1].append(doc_id.as_py())
            held[2].append(out.as_py())
            held[3].append((text.as_py() or "").encode())
            size += len(held[3][-1]) + 1
            if size >= PART:
                yield made()
                held, size = ([], [], [], []), 0
    if held[0]:
        yield made()


def joined_portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Portion]:
    """Portions put together until they hold ``most`` tokens, so that shards get few and long pieces."""
    held: list[Portion] = []

    def made() -> Portion:
        firsts = np.cumsum([0, *(len(p.uids) for p in held[:-1])])
        rows = np.concatenate([p.row + a for p, a in zip(held, firsts, strict=True)])
        uids, doc_ids, out = [u for p in held for u in p.uids], [d for p in held for d in p.doc_ids], [h for p in held for h in p.held_out]
        return Portion(uids, doc_ids, out, np.concatenate([p.token for p in held]), np.concatenate([p.context for p in held]), rows)

    for p in portions(batches):
        held.append(p)
        if sum(len(x.token) for x in held) >= most:
            whole = made()
            held = []  # before the yield, so that the pieces are gone while the whole is scored
            yield whole
            del whole
    if held:
        yield made()


def pair_hash(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mixed(word ^ ((context + np.uint64(2)) * GOLDEN))


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards share out the hashes in order; their number is a power of two, two at least."""
    return (words >> np.uint64(65 - shards.bit_length())).astype(np.int64)


def owner_of(names: np.ndarray, shards: int) -> np.ndarray:
    return (names >> np.uint64(NAME_BITS + 1 - shards.bit_length())).astype(np.int64)


def pieces(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The values of a sorted array that occur, and where they stand."""
    cuts = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
        if a < b:
            yield int(of[a]), slice(a, b)


def gaps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=np.uint64(0))


def sums_of(gaps_: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps_, dtype=np.uint64)


def name_gaps(names: np.ndarray) -> np.ndarray:
    """Gaps of names that rise within each word and fall between words, modulo 2^40."""
    return gaps(names) & NAMES


def names_of(gaps_: np.ndarray) -> np.ndarray:
    return sums_of(gaps_) & NAMES


# ---------------------------------------------------------------- counts


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and where in it each key begins."""
    order = np.argsort(key)
    ordered = key[order]
    return order, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, bool))


class Counts:
    """Sums of (word, context)."""

    def __init__(self):
        self.held = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, word: np.ndarray, context: np.ndarray, n: np.ndarray | None = None) -> None:
        self.waiting.append(summed_pairs(word, context, np.ones(len(word), np.int32) if n is None else n))
        self.size += len(self.waiting[-1][0])
        if self.size > max(250_000, len(self.held[0]) // 2):
            self.settle()

    def settle(self) -> None:
        parts = [self.held, *self.waiting]
        self.held, self.waiting, self.size = None, [], 0
        whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
        parts.clear()  # what has been put together is not held twice
        self.held = summed_pairs(*whole)
        del whole
        trimmed()

    def by_word(self) -> Iterator[np.ndarray]:
        """Words, contexts and sums, one after the other; each is gone from here once it is given."""
        self.settle()
        columns = list(self.held)
        self.__init__()
        order = np.argsort(columns[0])
        while columns:
            yield columns.pop(0)[order]


def summed_pairs(word: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, first = grouped(pair_hash(word, context))
    at = order[first]
    return word[at], context[at], np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else n.astype(np.int64)


#: What is sent to a shard and kept there: a portion's pairs or their places, or the portion's notes.
PIECE = "shard long, part long, kind int, rows binary"
NOTES, PAIRS = 0, 1


def ordered_pairs(p: Portion) -> tuple[np.ndarray, ...]:
    """Words and contexts of the different pairs, by word and then by context, how often each is in training and in all,
    and the documents of all tokens in the same order."""
    order = np.argsort(p.token)
    token = p.token[order]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    names, name = np.unique(np.append(p.context[1:], END_NAME)[order[new]], return_inverse=True)
    context = name[np.roll(at, 1)]  # the last token is an end, as is what stands before the first
    key = at * len(names) + context
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    rows = p.row[order]
    learnt = ~np.array(p.held_out)
    one = order[first]
    return token[new][at[one]], names[context[one]], np.add.reduceat(learnt[rows], first, dtype=np.int64), np.diff(first, append=len(order)), rows


def counted(docs: DataFrame, shards: int) -> DataFrame:
    """Of each portion, its pairs by shard of the word, and its notes for one of these shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in joined_portions(batches, PORTION):
            word, context, n, every, rows = ordered_pairs(p)
            part = p.uids[0]
            documents = columns_packed(np.array([x or 0 for x in p.doc_ids], np.int64), np.array([x is None for x in p.doc_ids], np.uint8))
            out = [(k, part, PAIRS, columns_packed(gaps(word[at]), name_gaps(context[at]), n[at].astype("<u4"))) for k, at in pieces(shard_of(word, shards))]
            home = out[int(mixed(np.array([part], np.uint64))[0]) % len(out)][0]
            out.append((home, part, NOTES, joined_blobs(documents, columns_packed(every.astype("<u4")), columns_packed(rows.astype("<u4")))))
            del p, word, context, n, every, rows
            yield piece_rows(out)

    return docs.mapInArrow(released(work), PIECE)


def piece_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "part", "kind", "rows"])


ASK = pa.list_(pa.struct([("owner", pa.int64()), ("names", pa.binary()), ("customers", pa.binary())]))
HELD_HERE = pa.list_(pa.struct([("part", pa.int64()), ("kind", pa.int32()), ("rows", pa.binary())]))
STATIC = "shard long, chunk long, words binary, contexts binary, pairs binary, asks array<struct<owner:long,names:binary,customers:binary>>, figures array<long>, pieces array<struct<part:long,kind:int,rows:binary>>"


def whole_shards(packed: DataFrame, shards: int) -> DataFrame:
    """One row for each shard (chunk 0): words with counts, names of contexts, pairs (places of both, customers), the
    contexts and customers by owner, and tokens, words, and how many dishes of each level have one or two customers.
    Further rows (chunks from 1) have the places of each portion's pairs, and notes of portions."""
    columns = ["shard", "chunk", "words", "contexts", "pairs", "asks", "figures", "pieces"]

    def made(*row: object) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 3, ASK, pa.list_(pa.int64()), HELD_HERE)
        return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], columns)

    def rows(shard: int, sums: Counts, held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        each, context, c = sums.by_word()
        new = np.concatenate(([True], each[1:] != each[:-1])) if len(each) else np.zeros(0, bool)
        word, at = each[new], np.cumsum(new) - 1  # they stand in order
        del each, new
        names, cx = np.unique(context, return_inverse=True)
        del context
        keys = at * max(1, len(names)) + cx
        order = np.argsort(keys)
        keys, cx, c = keys[order], cx[order].astype("<u4"), c[order]
        del order
        at = at.astype("<u4")
        n = np.bincount(at, c, len(word)).astype(np.int64)
        customers = np.bincount(cx, c, len(names)).astype(np.int64)
        asks = [{"owner": k, "names": columns_packed(gaps(names[s])), "customers": columns_packed(customers[s])} for k, s in pieces(owner_of(names, shards))]
        blobs = columns_packed(gaps(word), n), columns_packed(gaps(names)), columns_packed(at, cx, c)
        del at, cx
        whole = Shard(*blobs)
        types = np.bincount(whole.entry, c > 0, len(whole.entry_word))
        dishes = (c, types, np.bincount(whole.entry_word, types > 0, len(word)))
        figures = [int(n.sum()), int(np.count_nonzero(n)), *(int(np.count_nonzero(d == k)) for d in dishes for k in (1, 2))]
        del whole, dishes, types, c
        yield made(shard, 0, *blobs, asks, figures, None)
        del blobs, asks
        chunk, out, size = 1, [], 0
        while held:
            part, kind, blob = held.pop()
            if kind == PAIRS:
                steps, context, _ = columns_unpacked(blob, "<u8", "<u8", "<u4")
                mine = np.searchsorted(word, sums_of(steps)) * len(names) + np.searchsorted(names, names_of(context))
                blob = columns_packed(gaps(np.searchsorted(keys, mine).astype(np.uint64)).astype("<u4"))
            out.append({"part": part, "kind": kind, "rows": blob})
            size += len(blob)
            if size > CHUNK or not held:
                yield made(shard, chunk, None, None, None, None, None, out)
                chunk, out, size = chunk + 1, [], 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, held = None, Counts(), []
        for batch in batches:
            for shard, part, kind, blob in zip(*batch.columns, strict=True):
                if shard.as_py() != now and now is not None:
                    yield from rows(now, sums, held)
                    sums, held = Counts(), []
                now = shard.as_py()
                held.append((part.as_py(), kind.as_py(), blob.as_py()))
                if kind.as_py() == PAIRS:
                    steps, context, n = columns_unpacked(held[-1][2], "<u8", "<u8", "<u4")
                    sums.add(sums_of(steps), names_of(context), n)
        if now is not None:
            yield from rows(now, sums, held)

    return packed.repartition(tasks(shards), "shard").sortWithinPartitions("shard").mapInArrow(released(work), STATIC)


def tasks(shards: int) -> int:
    """Partitions of tables of shards and owners: one for each, as long as there are not too many for buckets."""
    return min(shards, 4096)


def bucketed(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Keep ``df``, which is partitioned by ``key``, as a table with as many buckets, so that joins don't shuffle it."""
    spark = df.sparkSession
    name, n = f"hpylm_{uuid.uuid4().hex}", tasks(shards)
    df.write.format("parquet").bucketBy(n, key).option("path", shared_path(spark, name)).saveAsTable(name)
    return spark.table(name)


# ---------------------------------------------------------------- seating


def seated(customers: np.ndarray, strength: np.ndarray, discount: float, base: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers: a new one has weight (strength + discount * own tables) * base."""
    order = np.argsort(-customers, kind="stable")
    n, a, p = customers[order], strength[order], base[order]
    tables = (n > 0).astype(np.int64)
    sitting, active = 1, int(np.count_nonzero(n > 1))
    while active:
        step = max(1, sitting // 16)
        t = tables[:active]
        new = (a[:active] + discount * t) * p[:active]
        tables[:active] += draw.binomial(np.minimum(step, n[:active] - sitting), new / (new + np.maximum(sitting - discount * t, 1e-9)))
        sitting += step
        active = int(np.searchsorted(-n, -sitting, "left"))
    out = np.empty_like(tables)
    out[order] = tables
    return out


def alone_table(discount: float) -> np.ndarray:
    """[c, t]: the probability that one of c customers at t tables sits alone, S(c-1, t-1) / S(c, t)."""
    logs = np.full((EXACT + 1, EXACT + 1), -np.inf)
    logs[1, 1] = 0.0
    out = np.zeros((EXACT + 1, EXACT + 1))
    out[1, 1] = 1.0
    for c in range(2, EXACT + 1):
        t = np.arange(1, c + 1)
        stay = np.where(t < c, logs[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - discount * t, 1e-300)), -np.inf)
        logs[c, 1 : c + 1] = np.logaddexp(logs[c - 1, 0:c], stay)
        out[c, 1 : c + 1] = np.exp(logs[c - 1, 0:c] - logs[c, 1 : c + 1])
    return out


@lru_cache(16)
def singles(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of mean table sizes, and the share of tables of size 1 times that mean: table sizes are taken as
    independent with weights gamma(n - d) z^n / n!, by minus the logarithm of 1 - z."""
    x = np.logspace(-9, 2.8, 4000)
    z, rest = -np.expm1(-x), -np.expm1(-discount * x)
    return np.log(z * discount / rest) + x * (1 - discount), z * discount / rest


def alone_beyond(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same for many customers: table sizes are close to independent, where z gives them the right mean. One table
    and one customer are counted out, so that a single table has no lone customer and the odds are right for few."""
    means, shares = singles(discount)
    return np.minimum(1.0, (t - 1) / (c - 1) * np.interp(np.log((c - 1) / np.maximum(t - 1, 0.5)), means, shares))


class Seats:
    """Dishes of one level whose customers come and go: customers, tables, and the weight of a new table by the
    others' tables and the parent's probability."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, discount: float, draw: np.random.Generator):
        self.c, self.t, self.d, self.draw = customers.copy(), tables.copy(), discount, draw
        self.known = alone_table(discount)

    def remove(self, at: np.ndarray, step: np.ndarray) -> None:
        c, t = self.c[at], self.t[at]
        alone = self.known[np.minimum(c, EXACT), np.minimum(t, EXACT)]
        if (big := c > EXACT).any():
            alone[big] = alone_beyond(c[big], t[big], self.d)
        self.c[at] = c - step
        self.t[at] = np.where(c == step, 0, np.clip(t - self.draw.binomial(step, np.clip(alone, 0, 1)), 1, np.maximum(c - step, 1)))

    def add(self, at: np.ndarray, step: np.ndarray, others: np.ndarray, p: np.ndarray) -> None:
        c, t = self.c[at], self.t[at]
        new = (others[at] + self.d * t) * p[at]
        opened = self.draw.binomial(step, new / (new + np.maximum(c - self.d * t, 0)))
        self.c[at] = c + step
        self.t[at] = t + np.where(c == 0, np.maximum(opened, 1), opened)

    def move(self, customers: np.ndarray, others: np.ndarray, p: np.ndarray) -> None:
        """Take away or seat customers until there are as many as stated, in small blocks where many sit."""
        while (at := np.flatnonzero(self.c > customers)).size:
            self.remove(at, np.minimum(self.c[at] - customers[at], np.maximum(1, self.c[at] // 64)))
        while (at := np.flatnonzero(self.c < customers)).size:
            self.add(at, np.minimum(customers[at] - self.c[at], np.maximum(1, self.c[at] // 64)), others, p)

    def reseat(self, others: np.ndarray, p: np.ndarray) -> None:
        """Take away and seat again every customer of the dishes that have two and more."""
        self.reseat_one_by_one(np.flatnonzero((self.c > 1) & (self.c < EXACT)), others, p)
        at = np.flatnonzero(self.c >= EXACT)
        left, step = self.c[at], self.c[at] // BLOCKS
        while len(at):
            some = np.minimum(step, left)
            self.remove(at, some)
            self.add(at, some, others, p)
            left -= some
            at, left, step = at[left > 0], left[left > 0], step[left > 0]

    def reseat_one_by_one(self, at: np.ndarray, others: np.ndarray, p: np.ndarray) -> None:
        """In each round one customer of each dish that has as many; dishes stand in order, so that these come first."""
        at = at[np.argsort(-self.c[at], kind="stable")]
        c, tables, others, p = self.c[at], self.t[at], others[at], p[at]
        active = np.cumsum(np.bincount(c, minlength=1)[::-1])[::-1]  # dishes with at least so many customers
        for k in active[1:].tolist():
            t = tables[:k]
            t -= self.draw.random(k) < self.known[c[:k], t]
            new = (others[:k] + self.d * t) * p[:k]
            t += self.draw.random(k) * (new + (c[:k] - 1 - self.d * t)) < new
        self.t[at] = tables


class Shard:
    """Words, contexts and pairs of a shard; entries are the pairs of a class and a word."""

    def __init__(self, words: bytes, contexts: bytes, pairs: bytes):
        steps, self.n = columns_unpacked(words, "<u8", "<i8")
        self.word, self.name = sums_of(steps), sums_of(columns_unpacked(contexts, "<u8")[0])
        at, context, self.c = columns_unpacked(pairs, "<u4", "<u4", "<i8")
        self.at, self.context = at.astype(np.int32), context.astype(np.int32)  # fewer than 2^31, as a shard holds all
        keys = (self.name % np.uint64(CLASSES)).astype(np.int64)[self.context]
        keys += self.at * np.int64(CLASSES)
        keys, entry = np.unique(keys, return_inverse=True)
        self.entry = entry.astype(np.int32)
        self.entry_word, self.entry_class = keys // CLASSES, keys % CLASSES
        del steps, at, context, keys, entry
        trimmed()

    def entry_customers(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.entry, tables, len(self.entry_word)).astype(np.int64)

    def root_customers(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.entry_word, tables, len(self.word)).astype(np.int64)


@dataclass
class State:
    """Of one state of the sampler, what all shards share: by level (contexts, classes, root) discounts and strengths;
    tables and customers of classes; those of the root; the uniform base."""

    discounts: list[float]
    strengths: list[float]
    class_tables: np.ndarray
    class_customers: np.ndarray
    root_tables: float
    root_customers: float
    uniform: float

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        d, s = self.discounts[2], self.strengths[2]
        return (customers - d * tables + (s + d * self.root_tables) * self.uniform) / (s + self.root_customers)

    def class_backoff(self) -> np.ndarray:
        return (self.strengths[1] + self.discounts[1] * self.class_tables) / (self.strengths[1] + self.class_customers)

    def entries(self, klass: np.ndarray, customers: np.ndarray, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        return (customers - self.discounts[1] * tables) / (self.strengths[1] + self.class_customers[klass]) + self.class_backoff()[klass] * root

    def backoff(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (self.strengths[0] + self.discounts[0] * tables) / (self.strengths[0] + customers)


class Sample:
    """A shard's seats in one state, and the probabilities they predict."""

    def __init__(self, shard: Shard, seats: bytes, answers: list[tuple[int, bytes]], state: State, pairs: bool = True):
        self.t, self.entry_t, self.root_t = (columns_unpacked(b, "<i8")[0] for b in unjoined(seats))
        parts = [columns_unpacked(blob, "<i8", "<i8") for _, blob in sorted(answers)]
        self.customers, self.tables = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        self.entry_c = shard.entry_customers(self.t)
        self.root_c = shard.root_customers(self.entry_t)
        self.root = state.root(self.root_c, self.root_t)
        self.entries = state.entries(shard.entry_class, self.entry_c, self.entry_t, self.root[shard.entry_word])
        del parts
        trimmed()
        if not pairs:
            return
        self.backoff = state.backoff(self.customers, self.tables)
        self.pairs = (shard.c - state.discounts[0] * self.t) / (state.strengths[0] + self.customers[shard.context])
        self.pairs += self.backoff[shard.context] * self.entries[shard.entry]


def joined_blobs(*blobs: bytes) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def unjoined(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        yield data[at + 8 : at + 8 + n]
        at += 8 + n


SEATS = "shard long, seats binary, partials array<struct<owner:long,tables:binary>>, classes array<long>, root array<long>"
PARTIAL = pa.list_(pa.struct([("owner", pa.int64()), ("tables", pa.binary())]))


def seats_row(number: int, shard: Shard, t: np.ndarray, entry_t: np.ndarray, root_t: np.ndarray, shards: int) -> pa.RecordBatch:
    tables = np.bincount(shard.context, t, len(shard.name)).astype(np.int64)
    partials = [{"owner": k, "tables": columns_packed(tables[s])} for k, s in pieces(owner_of(shard.name, shards))]
    of = lambda x: np.bincount(shard.entry_class, x, CLASSES).astype(np.int64).tolist()
    classes = of(entry_t) + of(shard.entry_customers(t))
    root = [int(root_t.sum()), int(shard.root_customers(entry_t).sum())]
    blob = joined_blobs(*map(columns_packed, (t, entry_t, root_t)))
    return pa.record_batch([pa.array([number]), pa.array([blob], pa.binary()), pa.array([partials], PARTIAL), pa.array([classes]), pa.array([root])], ["shard", "seats", "partials", "classes", "root"])


def first_seats(static: DataFrame, shards: int) -> DataFrame:
    """One table for each dish that has customers, everywhere."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *blobs in zip(*batch.columns, strict=True):
                shard = Shard(*(b.as_py() for b in blobs))
                t = np.minimum(shard.c, 1)
                entry_t = np.minimum(shard.entry_customers(t), 1)
                yield seats_row(number.as_py(), shard, t, entry_t, np.minimum(shard.root_customers(entry_t), 1), shards)

    return bucketed(static.select("shard", "words", "contexts", "pairs").mapInArrow(released(work), SEATS), "shard", shards)


def with_answers(static: DataFrame, shards: int, *states: tuple[DataFrame, DataFrame]) -> DataFrame:
    """shard, words, contexts, pairs, and of each state seats and answers."""
    out = static.select("shard", "words", "contexts", "pairs")
    for i, (seats, answers) in enumerate(states):
        mine = answers.where("shard IS NOT NULL").repartition(tasks(shards), "shard").groupBy("shard").agg(F.collect_list(F.struct("owner", "answer")).alias(f"answers{i}"))
        out = out.join(seats.select("shard", F.col("seats").alias(f"seats{i}")), "shard").join(mine, "shard")
    return out


def answers_of(value: pa.Scalar) -> list[tuple[int, bytes]]:
    return [(x["owner"], x["answer"]) for x in value.as_py()]


def sweep(static: DataFrame, seats: DataFrame, answers: DataFrame, state: State, number: int, shards: int) -> DataFrame:
    """All seats drawn anew: by seating everyone in the first sweep, by removing and reseating in later ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, words, contexts, pairs, old, told in zip(*batch.columns, strict=True):
                shard = Shard(words.as_py(), contexts.as_py(), pairs.as_py())
                draw = np.random.default_rng((SEED, number, of.as_py()))
                now = Sample(shard, old.as_py(), answers_of(told), state, pairs=False)
                (d, d1, d2), (s, s1, s2) = state.discounts, state.strengths
                # others' tables are those of the sweep before
                others = s + d * np.maximum(now.tables[shard.context] - now.t, 0)
                others1 = s1 + d1 * np.maximum(state.class_tables[shard.entry_class] - now.entry_t, 0)
                others2 = s2 + d2 * np.maximum(state.root_tables - now.root_t, 0)
                p, p1, p2 = now.entries[shard.entry], now.root[shard.entry_word], np.full(len(shard.word), state.uniform)
                if number == 0:
                    t = seated(shard.c, others, d, p, draw)
                    entry_t = seated(shard.entry_customers(t), others1, d1, p1, draw)
                    root_t = seated(shard.root_customers(entry_t), others2, d2, p2, draw)
                else:
                    leaves = Seats(shard.c, now.t, d, draw)
                    leaves.reseat(others, p)
                    del others, p
                    trimmed()
                    entries = Seats(now.entry_c, now.entry_t, d1, draw)
                    entries.move(shard.entry_customers(leaves.t), others1, p1)
                    entries.reseat(others1, p1)
                    root = Seats(now.root_c, now.root_t, d2, draw)
                    root.move(shard.root_customers(entries.t), others2, p2)
                    root.reseat(others2, p2)
                    t, entry_t, root_t = leaves.t, entries.t, root.t
                yield seats_row(of.as_py(), shard, t, entry_t, root_t, shards)

    return bucketed(with_answers(static, shards, (seats, answers)).mapInArrow(released(work), SEATS), "shard", shards)


# ---------------------------------------------------------------- restaurants across shards

OWNED = pa.list_(pa.struct([("shard", pa.int64()), ("places", pa.binary())]))


def owners_of(static: DataFrame, shards: int) -> DataFrame:
    """owner, customers of its contexts, and for each shard the places of those that it has."""

    def row(owner: int, asks: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        names = [sums_of(columns_unpacked(x, "<u8")[0]) for _, x, _ in asks]
        every, at = np.unique(np.concatenate(names), return_inverse=True)
        customers = np.bincount(at, np.concatenate([columns_unpacked(c, "<i8")[0] for _, _, c in asks]), len(every)).astype(np.int64)
        cuts = np.cumsum([len(x) for x in names])[:-1]
        places = [{"shard": s, "places": columns_packed(x.astype("<u4"))} for (s, _, _), x in zip(asks, np.split(at, cuts), strict=True)]
        return pa.record_batch([pa.array([owner]), pa.array([columns_packed(customers)], pa.binary()), pa.array([places], OWNED)], ["owner", "customers", "places"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks = None, []
        for batch in batches:
            for owner, *ask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if owner != now and asks:
                    yield row(now, asks)
                    asks = []
                now = owner
                asks.append(tuple(ask))
        if asks:
            yield row(now, asks)

    asked = static.select("shard", F.explode("asks").alias("a")).select("a.owner", "shard", "a.names", "a.customers")
    rows = asked.repartition(tasks(shards), "owner").sortWithinPartitions("owner").mapInArrow(released(work), "owner long, customers binary, places array<struct<shard:long,places:binary>>")
    return bucketed(rows, "owner", shards)


def exchange(owners: DataFrame, seats: DataFrame, discount: float, strength: float, number: int, shards: int) -> DataFrame:
    """shard, owner, answer: customers and tables of the contexts that the shard has; for no shard, the sums of auxiliary
    variables from which a strength is drawn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, customers, places, partials in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = columns_unpacked(customers, "<i8")[0]
                at = {p["shard"]: columns_unpacked(p["places"], "<u4")[0] for p in places}
                t = np.zeros(len(c), np.int64)
                for p in partials:
                    t += np.bincount(at[p["shard"]], columns_unpacked(p["tables"], "<i8")[0], len(c)).astype(np.int64)
                ones, logs = auxiliary(c, t, discount, strength, np.random.default_rng((SEED, number, owner, 1)))
                out = [(k, owner, columns_packed(c[x], t[x]), 0.0, 0.0) for k, x in at.items()] + [(None, owner, None, ones, logs)]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64()), strict=True)], ["shard", "owner", "answer", "ones", "logs"])

    told = seats.select("shard", F.explode("partials").alias("p")).select("shard", "p.*").repartition(tasks(shards), "owner").groupBy("owner").agg(F.collect_list(F.struct("shard", "tables")).alias("partials"))
    return keep(owners.join(told, "owner").mapInArrow(released(work), "shard long, owner long, answer binary, ones double, logs double"), "answers")


def auxiliary(customers: np.ndarray, tables: np.ndarray, discount: float, strength: float, draw: np.random.Generator) -> tuple[float, float]:
    """For restaurants of two and more: sums of Bernoulli draws over tables and of minus logs of beta draws."""
    some = customers > 1
    c, t = customers[some], tables[some]
    if not len(c):
        return 0.0, 0.0
    logs = -np.log(np.maximum(draw.beta(strength + 1, c - 1), 1e-300)).sum()
    more = np.cumsum(np.bincount(t)[::-1])[::-1]  # restaurants with at least so many tables
    i = np.arange(1, len(more) - 1)
    return float(draw.binomial(more[2:], strength / (strength + discount * i)).sum()), float(logs)


def next_strength(ones: float, logs: float, draw: np.random.Generator) -> float:
    """From a gamma prior of mean 1."""
    return float(np.clip(draw.gamma(1 + ones, 1 / (1 + logs)), 1e-3, 1e6))


def trained(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, DataFrame, State]], int, int]:
    """Static tables of shards and of their portions, the states to average over (seats, answers, shared figures), tokens, words."""
    table = bucketed(whole_shards(counted(docs, shards), shards), "shard", shards)
    static, held = table.where("chunk = 0"), table.where("chunk > 0").select("shard", "pieces")
    figures = [r[0] for r in static.select(F.posexplode("figures")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").select("n").collect()]
    tokens, distinct, *dishes = figures or [0] * 8
    share = lambda a, b: min(0.95, max(0.1, a / (a + 2 * b) if a else 0.5))
    discounts, strengths = [share(*dishes[k : k + 2]) for k in (0, 2, 4)], [1.0] * 3
    owners, seats, draw = owners_of(static, shards), first_seats(static, shards), np.random.default_rng(SEED)
    samples = []
    for number in range(SWEEPS + 1):
        answers = exchange(owners, seats, discounts[0], strengths[0], number, shards)
        sums = {r.pos: r.n for r in seats.select(F.posexplode(F.concat("classes", "root"))).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
        every = np.array([sums.get(i, 0) for i in range(2 * CLASSES + 2)], np.int64)
        tables, customers, (root_tables, root_customers) = every[:CLASSES], every[CLASSES : 2 * CLASSES], every[2 * CLASSES :]
        ones, logs = answers.where("shard IS NULL").agg(F.sum("ones"), F.sum("logs")).first()
        strengths = [
            next_strength(ones or 0.0, logs or 0.0, draw),
            next_strength(*auxiliary(customers, tables, discounts[1], strengths[1], draw), draw),
            next_strength(*auxiliary(every[2 * CLASSES + 1 :], every[2 * CLASSES : -1], discounts[2], strengths[2], draw), draw),
        ]
        state = State(discounts, strengths, tables.astype(float), customers.astype(float), float(root_tables), float(root_customers), 1 / (distinct + 1))
        if number > BURN_IN:
            samples.append((seats, answers, state))
        if number < SWEEPS:
            moved = sweep(static, seats, answers, state, number, shards)
            if number <= BURN_IN:
                discard(answers)
                discard(seats)
            seats = moved
    return static, held, samples, int(tokens), int(distinct)


# ---------------------------------------------------------------- scoring


def answered(static: DataFrame, held: DataFrame, samples: list[tuple[DataFrame, DataFrame, State]], shards: int) -> DataFrame:
    """To each portion, for each of its pairs in a shard: the logarithm of its probability and, where a word begins, the
    word's count and one, else 0. Its notes have shard -1."""
    states = [s for _, _, s in samples]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0
        for batch in batches:
            for number, words, contexts, pairs, *more in zip(*batch.columns, strict=True):
                *drawn, asks = more
                if number.as_py() != now:
                    now, logs = number.as_py(), None
                    shard = Shard(*(b.as_py() for b in (words, contexts, pairs)))
                    for s, a, state in zip(drawn[::2], drawn[1::2], states, strict=True):
                        p = Sample(shard, s.as_py(), answers_of(a), state).pairs
                        logs = p if logs is None else logs + p
                    logs = np.log10(logs / len(states)).astype("<f4")
                    at, n = shard.at, shard.n + 1
                    del shard, p
                for ask in asks.values:
                    part, kind, blob = (ask[c].as_py() for c in ("part", "kind", "rows"))
                    if kind == PAIRS:
                        place = np.cumsum(columns_unpacked(blob, "<u4")[0], dtype=np.int64)
                        word = at[place]
                        blob = columns_packed(logs[place], np.where(np.diff(word, prepend=-1), n[word], 0))
                    out.append((now if kind == PAIRS else -1, part, kind, blob))
                    size += len(blob)
                    if size > BATCH:
                        yield piece_rows(out)
                        out, size = [], 0
        if out:
            yield piece_rows(out)

    model = with_answers(static, shards, *((s, a) for s, a, _ in samples))
    return model.join(held, "shard").mapInArrow(released(work), PIECE)


def summed(answers: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """The documents of each portion: doc_id, n_tokens, n_known, base, score."""
    base_total = tokens + 0.1 * (distinct + 1)

    def row(notes: bytes, told: list[bytes]) -> pa.RecordBatch:
        documents, every, rows = unjoined(notes)
        doc_id, null = columns_unpacked(documents, "<i8", "<u1")
        every, rows, k = columns_unpacked(every, "<u4")[0], columns_unpacked(rows, "<u4")[0].astype(np.int64), len(doc_id)
        score, n = (np.concatenate(c) for c in zip(*(columns_unpacked(b, "<f4", "<i8") for b in told), strict=True))
        if len(score) != len(every):
            raise RuntimeError(f"answers to {len(score)} of the {len(every)} pairs of a portion: its documents came in another order when a lost task ran again")
        n = n[np.maximum.accumulate(np.where(n > 0, np.arange(len(n)), 0))] - 1
        base = np.log10((n + 0.1) / base_total)
        known, base, score = (np.bincount(rows, np.repeat(x, every), k) for x in (n > 0, base, score))
        columns = [np.bincount(rows, minlength=k), known.astype(np.int64), base, score]
        return pa.record_batch([pa.array(doc_id, mask=null > 0), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes, told = None, []
        for batch in batches:
            for kind, blob in zip(*batch.columns[2:], strict=True):
                if kind.as_py() == NOTES:
                    if notes is not None:
                        yield row(notes, told)
                    notes, told = blob.as_py(), []
                else:
                    told.append(blob.as_py())
        if notes is not None:
            yield row(notes, told)

    dealt = answers.repartition("part").sortWithinPartitions("part", "shard")
    return dealt.mapInArrow(released(work), "doc_id long, n_tokens long, n_known long, base double, score double")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the job that they were for: here, all that later jobs read is in tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(3, int(size // 6 // PER_SHARD).bit_length())
    with shuffles_dropped(docs.sparkSession):
        static, held, samples, tokens, distinct = trained(texts, shards)
    sums = summed(answered(static, held, samples, shards), tokens, distinct)
    return sums.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
