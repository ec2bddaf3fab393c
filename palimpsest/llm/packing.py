"""Bulk-synchronous best-fit packing of tokenised documents into sequences of bounded length.

Documents become pieces of at most ``capacity`` tokens. Pieces over half of it open a sequence each. Then rounds follow:
the open gaps and the waiting pieces are range-sorted by falling size, gaps first among equals, so that each block of
the sort holds a stretch of sizes. Every block sweeps its stretch and gives each piece its successor, the smallest gap
that holds it; what remains of a gap goes on standing in the sweep. Pieces that find none in their block look to the
blocks of larger sizes: the driver sees five numbers a block and pairs ranks of waiting pieces with ranks of
open gaps, nearest block first, so that no two pieces claim the same room. Gaps are updated, and new
sequences open for as many tokens as the gaps can't take, whichever way they are filled. Rounds end when none waits.

Ids are those of ``tokenizers`` with the file named by ``tokenizer``; strings of special tokens are ordinary text.
tiktoken runs that vocabulary, four times as fast; texts on which its pattern gives up go to ``tokenizers``. Each
document is closed by ``end``.

Null and empty texts are documents of the one token ``end``. Null and repeated doc_ids and repeated rows are documents
like any other. Documents longer than a sequence are cut so that all pieces but the first are full. Very long texts are
encoded in one task each, whole. An empty table gives no rows. Other columns are not read. Reruns cut
alike, but may number the sequences otherwise.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, keep

CAPACITY, END, VOCABULARY = 1024, 2, "byte_bpe_50k.json"
#: Gaps and pieces that a block of the sort holds, about.
BLOCK = 100_000
#: Blanks in a row beyond which tiktoken's pattern may give up.
LONG_BLANKS = 10_000


@functools.cache
def encoder(path: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids, by a tokenizer file of the byte-level BPE kind."""
    import public_tokenizers
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path(VOCABULARY)
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
    special = {t.content for t in exact.get_added_tokens_decoder().values()}
    ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in special}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    blanks = regex.compile(r"\s{%d}" % LONG_BLANKS)

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG_BLANKS and blanks.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.append(encode(text.as_py()), np.uint32(end)).astype("<u4", copy=False)
                first = (len(found) - 1) % capacity + 1
                cuts = [0, *range(first, len(found) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = found[a:b].tobytes()
                    out.append((doc_id, k, a, b - a, zlib.crc32(part), part))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True))[: len(names)], kinds, strict=False)], names) if out else pa.record_batch([pa.array([], t) for t in kinds[: len(names)]], names)

    return texts.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


#: What a block's sweep says, by kind: a placed piece (id, seq), an open gap (seq, its size, rank from the smallest, or
#: no rank if it is too small for the blocks that follow), a waiting piece (id, its size, rank from the largest).
PLACED, OPEN, WAITING = 0, 1, 2
SWEPT = "kind int, block int, id long, size long, seq long, rank long"


def sweep(sizes: list[int], kinds: list[int], ids: list[int], block: int) -> list[tuple[int, int, int, int, int | None, int | None]]:
    """Best fit over one block of gaps (kind 0) and pieces (kind 1) in falling order of size."""
    fits: list[tuple[int, int]] = []
    small: list[tuple[int, int]] = []
    out: list[tuple[int, int, int, int, int | None, int | None]] = []
    waiting = 0
    for size, kind, at in zip(sizes, kinds, ids, strict=True):
        while small and -small[0][0] >= size:
            gap, seq = heapq.heappop(small)
            heapq.heappush(fits, (-gap, seq))
        if kind == 0:
            heapq.heappush(fits, (size, at))
        elif fits:
            gap, seq = heapq.heappop(fits)
            out.append((PLACED, block, at, size, seq, None))
            if gap > size:
                heapq.heappush(small, (size - gap, seq))
        else:
            out.append((WAITING, block, at, size, None, waiting))
            waiting += 1
    least = sizes[-1]
    left = sorted([*fits, *((-g, s) for g, s in small)])
    below = sum(g < least for g, _ in left)
    out += [(OPEN, block, seq, gap, seq, k - below if k >= below else None) for k, (gap, seq) in enumerate(left)]
    return out


def swept(entries: DataFrame, blocks: int) -> DataFrame:
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            sizes, kinds, ids = (np.concatenate([b.column(c).to_numpy() for b in held]).tolist() for c in range(3))
            columns = zip(*sweep(sizes, kinds, ids, TaskContext.get().partitionId()), strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["kind", "block", "id", "size", "seq", "rank"])

    return entries.select("size", "kind", "id").repartitionByRange(blocks, *order).sortWithinPartitions(*order).mapInArrow(work, SWEPT)


def pairings(blocks: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """From (block, open gaps, the smallest of them, waiting pieces, the largest of them) in order of falling sizes:
    (block of pieces, first rank, rank after the last, block of gaps, first rank there, pieces for each gap)."""
    found: list[tuple[int, int, int, int, int, int]] = []
    stack: list[list[int]] = []
    for block, n_open, least, n_waiting, most in blocks:
        at = 0
        while at < n_waiting and stack:
            of, used, n, gap = stack[-1]
            each = max(1, gap // most)
            take = min(n - used, -(-(n_waiting - at) // each))
            upto = min(n_waiting, at + take * each)
            found.append((block, at, upto, of, used, each))
            at, stack[-1][1] = upto, used + take
            if stack[-1][1] == n:
                stack.pop()
        if n_open:
            stack.append([block, 0, n_open, least])
    return found


def across(waiting: DataFrame, found: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """id, size, of and rank (block and rank of the gap) of the pieces that a pairing covers. ``found`` has a few rows
    a block of the sort."""
    table = np.array(sorted(found), np.int64).reshape(-1, 6)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] * (1 << 40) + table[:, 1]
        for batch in batches:
            block, ids, sizes, rank = (batch.column(c).to_numpy() for c in range(4))
            row = np.searchsorted(key, block.astype(np.int64) * (1 << 40) + rank, side="right") - 1
            good = (row >= 0) & (table[row, 0] == block) & (rank < table[row, 2]) if len(table) else np.zeros(len(block), bool)
            row = row[good]
            yield pa.record_batch([pa.array(ids[good]), pa.array(sizes[good]), pa.array(table[row, 3]), pa.array(table[row, 4] + (rank[good] - table[row, 1]) // table[row, 5])], ["id", "size", "of", "rank"])

    return waiting.select("block", "id", "size", "rank").mapInArrow(work, "id long, size long, of long, rank long")


def best_fit(sizes: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """id and seq of every row of ``sizes(id, size)``, 0 <= id, 1 <= size <= capacity: which sequence it goes to."""
    spark = sizes.sparkSession
    large = F.col("size") * 2 > capacity
    placed = [sizes.where(large).select("id", F.col("id").alias("seq"))]
    room = sizes.where(large & (F.col("size") < capacity)).select((capacity - F.col("size")).alias("size"), F.lit(0).alias("kind"), "id")
    state = keep(room.unionByName(sizes.where(~large).select("size", F.lit(1).alias("kind"), "id")), "state")
    opened, stalled = 0, False
    while True:
        known = {r["kind"]: r for r in state.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("sum"), F.min("size").alias("least"), F.max("size").alias("most")).collect()}
        if 1 not in known:
            break
        wait, (n_gaps, free, most) = known[1], (known[0]["n"], known[0]["sum"], known[0]["most"]) if 0 in known else (0, 0, 0)
        over = state.where((F.col("kind") == 1) & (F.col("size") > most)).agg(F.sum("size")).first()[0] if wait["most"] > most else 0
        new = math.ceil(max(wait["sum"] - free, over, wait["sum"] if stalled else 0) / capacity)
        entries = state.where((F.col("kind") == 1) | (F.col("size") >= wait["least"]))
        if new:
            entries = entries.unionByName(spark.range(new).select(F.lit(capacity).cast("long").alias("size"), F.lit(0).alias("kind"), (-1 - opened - F.col("id")).alias("id")))
        opened += new
        said = keep(swept(entries, max(1, round((wait["n"] + n_gaps + new) / block))), "swept")
        blocks = said.where("rank IS NOT NULL").groupBy("block").agg(
            F.count_if(F.col("kind") == OPEN).alias("n_open"),
            F.min(F.when(F.col("kind") == OPEN, F.col("size"))).alias("least"),
            F.count_if(F.col("kind") == WAITING).alias("n_waiting"),
            F.max(F.when(F.col("kind") == WAITING, F.col("size"))).alias("most"),
        )
        found = pairings(sorted(tuple(r) for r in blocks.collect()))
        placed.append(said.where(F.col("kind") == PLACED).select("id", "seq"))
        waiting, gaps = (said.where(F.col("kind") == k).select("size", F.lit(int(k == WAITING)).alias("kind"), "id", "block", "rank") for k in (WAITING, OPEN))
        if found:
            moved = keep(across(waiting, found).join(gaps.select(F.col("block").cast("long").alias("of"), "rank", F.col("id").alias("seq")), ["of", "rank"]).select("id", "size", "seq"), "moved")
            placed.append(moved.select("id", "seq"))
            waiting = waiting.join(moved.select("id"), "id", "left_anti")
            used = moved.groupBy(F.col("seq").alias("id")).agg(F.sum("size").alias("used"))
            gaps = gaps.join(used, "id", "left").withColumn("size", F.col("size") - F.coalesce("used", F.lit(0))).where("size > 0")
        stalled = not found and not said.where(F.col("kind") == PLACED).limit(1).count()
        before, state = state, keep(waiting.select("size", "kind", "id").unionByName(gaps.select("size", "kind", "id")), "state")
        discard(before)
    return functools.reduce(DataFrame.unionByName, placed)


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, ids: bool = False, block: int = BLOCK) -> DataFrame:
    """The columns of :func:`pieces`, sequence_id and offset (the piece's place in its sequence)."""
    cut = keep(pieces(docs, capacity, end, tokenizer, ids).withColumn("id", F.monotonically_increasing_id()), "pieces")
    seqs = best_fit(cut.select("id", F.col("length").alias("size")), capacity, block)
    joined = cut.join(seqs, "id")
    before = Window.partitionBy("seq").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*[c for c in cut.columns if c != "id"], F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def sequences(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """The training sequences themselves: sequence_id, ids (little-endian unsigned 32-bit), length, and parts
    (doc_id, piece, offset) in order. A sequence has at most ``capacity`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id", "piece")))
    held = pack(docs, capacity, end, tokenizer, ids=True).groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return held.select("sequence_id", joined.alias("ids"), F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("parts"))
