"""Substring dedup with a count-min prefilter.

A window is ``words`` consecutive words of a document. Each word is removed that is covered by a window which also
starts in a document with a smaller doc_id. First every task sketches its windows: for each of two hash rows the
sorted cells it touched, as compressed gaps. Tasks that own a range of cells merge these, and keep one bit a cell:
touched more than once. Counts are only ever too high, so the second pass may skip windows whose cells were touched
once. It sends the others to an exact grouping by a 96-bit hash of their words. Before that, each task settles the
windows that it has itself seen in a smaller document, so a passage that is everywhere is sent once by each task.

The sketch has three cells a window, rounded up, and at most ``MOST_CELLS`` a row; beyond that it lets more windows
through to the exact grouping, which loses none.

Null texts have no words. Rows without a doc_id lose nothing and cause no removal. Repeated rows repeat. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, SKETCH_ROWS, MOST_CELLS, SHARD = 13, 2, 1 << 29, 1 << 22
#: Words that a task hashes at once; windows of the corpus for each shard of the exact grouping.
PART, PER_SHARD = 500_000, 1 << 21
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, words: int, multiplier: np.uint64) -> np.ndarray:
    """A polynomial of each run of ``words`` word hashes, mixed."""
    n = len(hashes) - words + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j in range(words if n > 0 else 0):
        total = total * multiplier + hashes[j : j + n]
    return mixed(total)


class Part:
    """Windows of some documents: h1, row (index into ids), pos; windows across documents are left out."""

    def __init__(self, ids: list[int], texts: list[bytes], marks: list[int], words: int):
        split = [t.split() for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        self.ids, self.marks = np.array(ids, np.int64), np.array(marks, np.int64)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for s in split for w in s), np.uint64, int(lengths.sum()))
        h1 = window_hashes(self.hashes, words, MULTIPLIERS[0])
        row = np.repeat(np.arange(len(ids)), lengths)
        ends, starts = np.cumsum(lengths), np.cumsum(lengths) - lengths
        at = np.arange(len(h1))
        whole = at + words <= ends[row[: len(h1)]]
        self.at, self.h1 = at[whole], h1[whole]
        self.row = row[: len(h1)][whole]
        self.pos = self.at - starts[self.row]
        self.words = words

    def h2(self, some: np.ndarray) -> np.ndarray:
        """32 more bits for chosen windows."""
        at, total = self.at[some], np.zeros(len(some), np.uint64)
        for j in range(self.words):
            total = total * MULTIPLIERS[1] + self.hashes[at + j]
        return (mixed(total) >> np.uint64(32)).astype(np.int64)


def parts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Part]:
    """Batches of doc_id, mark, text, in portions of about ``PART`` words."""
    ids: list[int] = []
    texts: list[bytes] = []
    marks: list[int] = []
    size = 0
    for batch in batches:
        for doc_id, mark, text in zip(*batch.columns, strict=True):
            data = text.as_py().encode()
            ids.append(doc_id.as_py())
            marks.append(mark.as_py())
            texts.append(data)
            size += len(data)
            if size > 6 * PART:
                yield Part(ids, texts, marks, words)
                ids, texts, marks, size = [], [], [], 0
    if ids:
        yield Part(ids, texts, marks, words)


def cells(h1: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((h1 >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.int64)


def packed(sorted_cells: np.ndarray) -> bytes:
    """Gaps of two bytes where all fit, else four, compressed."""
    gaps = np.diff(sorted_cells, prepend=0)
    kind = "<u2" if len(gaps) and gaps.max() < 1 << 16 else "<u4"
    return kind[-1].encode() + zstandard.compress(gaps.astype(kind).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[:1].decode()}").astype(np.int64))


def addressable(docs: DataFrame) -> DataFrame:
    """doc_id, mark (tells apart texts under one doc_id) and text."""
    mark = F.hash("text").cast("long").alias("mark")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", mark, "text")


def repeated_cells(docs: DataFrame, width: int, words: int) -> Broadcast:
    """For each sketch row and shard, the compressed bitmap of cells that more than one window touched."""
    shard = min(SHARD, width)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, words):
            for row in range(SKETCH_ROWS):
                found, counts = np.unique(cells(part.h1, row, width), return_counts=True)
                cuts = np.searchsorted(found, np.arange(0, width + 1, shard))
                pieces = [(k, found[a:b] - k * shard, counts[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                yield pa.record_batch(
                    [pa.array([row] * len(pieces)), pa.array([k for k, _, _ in pieces]), pa.array([packed(f) for _, f, _ in pieces], pa.binary()), pa.array([packed(f[c > 1]) for _, f, c in pieces], pa.binary())],
                    ["row", "shard", "once", "more"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(shard, np.uint8)

        def bitmap() -> pa.RecordBatch:
            bits = zstandard.compress(np.packbits(counts > 1, bitorder="little").tobytes(), 3)
            return pa.record_batch([pa.array([now[0]]), pa.array([now[1]]), pa.array([bits])], ["row", "shard", "bits"])

        for batch in batches:
            for row, k, once, more in zip(*batch.columns, strict=True):
                if (key := (row.as_py(), k.as_py())) != now:
                    if now is not None:
                        yield bitmap()
                    now, counts = key, np.zeros(shard, np.uint8)
                for piece in (unpacked(once.as_py()), unpacked(more.as_py())):
                    counts[piece] = np.minimum(counts[piece] + 1, 2)
        if now is not None:
            yield bitmap()

    pieces = docs.mapInArrow(sketch, "row long, shard long, once binary, more binary")
    merged = pieces.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(merge, "row long, shard long, bits binary").toArrow()
    table = {(r, k): b for r, k, b in zip(*(merged[c].to_pylist() for c in ("row", "shard", "bits")), strict=True)}
    return docs.sparkSession.sparkContext.broadcast((width, shard, table))


class Sketch:
    def __init__(self, sent: tuple[int, int, dict[tuple[int, int], bytes]]):
        self.width, shard, table = sent
        self.rows = [np.zeros(self.width // 8, np.uint8) for _ in range(SKETCH_ROWS)]
        for (row, k), bits in table.items():
            self.rows[row][k * shard // 8 : (k + 1) * shard // 8] = np.frombuffer(zstandard.decompress(bits), np.uint8)

    def repeated(self, h1: np.ndarray) -> np.ndarray:
        """Indices of windows all of whose cells were touched more than once."""
        some = np.arange(len(h1))
        for row, bits in enumerate(self.rows):
            at = cells(h1[some], row, self.width)
            some = some[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1]
        return some


def columns_packed(*columns: np.ndarray) -> bytes:
    """Arrays of equal length as compressed byte planes."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.compress(len(columns[0]).to_bytes(8, "little") + b"".join(planes), 1)


def columns_unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def runs(pos: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive positions with equal keys: index of the first, start, length."""
    cut = np.flatnonzero(np.logical_or.reduce([pos[1:] != pos[:-1] + 1, *(k[1:] != k[:-1] for k in keys)])) + 1
    first = np.concatenate(([0], cut)) if len(pos) else np.zeros(0, np.int64)
    return first, pos[first], np.diff(np.append(first, len(pos)))


def candidates(docs: DataFrame, sent: Broadcast, words: int, shards: int) -> DataFrame:
    """shard (by the window's hash), documents of the part, windows estimated repeated, and runs of windows that
    the part itself has in a smaller document, all packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(sent.value)
        for part in parts(batches, words):
            some = sketch.repeated(part.h1)
            h1, h2, row, pos = part.h1[some], part.h2(some), part.row[some], part.pos[some]
            order = np.lexsort((pos, row, part.ids[row], h2, h1))
            h1, h2, row, pos = h1[order], h2[order], row[order], pos[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            first = part.ids[row][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h1) else part.ids[row]
            own = part.ids[row] == first
            lost, at = row[~own], pos[~own]
            order = np.lexsort((at, lost))
            known, start, n = runs(at[order], lost[order])
            lost = lost[order][known]
            h1, h2, row, pos = h1[own], h2[own], row[own], pos[own]
            of = (h1 >> np.uint64(65 - shards.bit_length())).astype(np.int64)
            by = np.argsort(lost % shards, kind="stable")  # any shard will do
            lost, start, n = lost[by], start[by], n[by]
            owner = lost % shards
            blobs, where = [], np.union1d(of, owner).tolist()
            for k in where:
                a, b = np.searchsorted(of, (k, k + 1))
                mine = slice(*np.searchsorted(owner, (k, k + 1)))
                docs_here = np.unique(np.concatenate([row[a:b], lost[mine]]))
                blobs.append(
                    (
                        columns_packed(part.ids[docs_here], part.marks[docs_here]),
                        columns_packed(np.diff(h1[a:b], prepend=np.uint64(0)), h2[a:b].astype("<u4"), np.searchsorted(docs_here, row[a:b]).astype("<u4"), pos[a:b].astype("<u4")),
                        columns_packed(np.searchsorted(docs_here, lost[mine]).astype("<u4"), start[mine].astype("<u4"), n[mine].astype("<u4")),
                    )
                )
            yield pa.record_batch([pa.array(where, pa.int64()), *(pa.array(c, pa.binary()) for c in (zip(*blobs, strict=True) if blobs else ([], [], [])))], ["shard", "docs", "windows", "known"])

    return docs.mapInArrow(work, "shard long, docs binary, windows binary, known binary")


def removed_runs(found: DataFrame) -> DataFrame:
    """doc_id, mark, start, n: runs of windows to remove. A shard is grouped in one piece."""

    def settle(blobs: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        lost: list[list[np.ndarray]] = [[] for _ in range(4)]
        for docs, windows, known in blobs:
            ids, marks = columns_unpacked(docs, "<i8", "<i8")
            gaps, h2, row, pos = columns_unpacked(windows, "<u8", "<u4", "<u4", "<u4")
            for held, column in zip(columns, (np.cumsum(gaps, dtype=np.uint64), h2, ids[row], marks[row], pos.astype(np.int64)), strict=True):
                held.append(column)
            row, start, n = columns_unpacked(known, "<u4", "<u4", "<u4")
            for held, column in zip(lost, (ids[row], marks[row], start.astype(np.int64), n.astype(np.int64)), strict=True):
                held.append(column)
        h1, h2, doc_id, mark, pos = (np.concatenate(c) for c in columns)
        order = np.lexsort((doc_id, h2, h1))
        h1, h2, doc_id = h1[order], h2[order], doc_id[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        gone = doc_id > doc_id[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h1) else new
        doc_id, mark, pos = doc_id[gone], mark[order][gone], pos[order][gone]
        order = np.lexsort((pos, mark, doc_id))
        doc_id, mark, pos = doc_id[order], mark[order], pos[order]
        first, start, n = runs(pos, doc_id, mark)
        out = [doc_id[first], mark[first], start, n]
        return pa.record_batch([pa.array(np.concatenate([a, *b])) for a, b in zip(out, lost, strict=True)], ["doc_id", "mark", "start", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, *blobs in zip(*batch.columns, strict=True):
                if shard.as_py() != now and held:
                    yield settle(held)
                    held = []
                now = shard.as_py()
                held.append(tuple(b.as_py() for b in blobs))
        if held:
            yield settle(held)

    return found.repartition("shard").sortWithinPartitions("shard").mapInArrow(work, "doc_id long, mark long, start long, n long")


def compressed(texts: DataFrame) -> DataFrame:
    """The text column as bytes, compressed for the one shuffle that carries it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False).compress
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([squeeze(t.as_py().encode()) for t in batch.column(2)], pa.binary())], ["doc_id", "mark", "text"])

    return texts.mapInArrow(work, "doc_id long, mark long, text binary")


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words, joined by single spaces)."""
    texts = addressable(docs)
    known = texts.where("doc_id IS NOT NULL")
    windows = (known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    width = min(MOST_CELLS, 1 << max(16, int(3 * windows).bit_length()))
    sent = repeated_cells(known, width, words)
    gone = removed_runs(candidates(known, sent, words, 1 << max(4, int(windows // PER_SHARD).bit_length())))
    lists = gone.groupBy(F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark")).agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    joined = compressed(texts).join(lists, (F.col("doc_id") == F.col("its_id")) & (F.col("mark") == F.col("its_mark")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ns in zip(*batch.columns[1:], strict=True):
                found = zstandard.decompress(text.as_py()).split()
                cover = np.zeros(len(found) + 1, np.int64)
                if starts.is_valid:
                    start, n = (np.array(x.as_py(), np.int64) for x in (starts, ns))
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + n - 1 + words, -1)
                stays = np.cumsum(cover)[: len(found)] == 0
                kept = b" ".join(found if stays.all() else [found[i] for i in np.flatnonzero(stays).tolist()])
                out.append((len(found), int(len(found) - stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.select("doc_id", "text", "starts", "ns").mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


ORACLE = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS pos FROM split WHERE len(ws) >= 13),
wins AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 12], ' ') AS s FROM placed),
firsts AS (SELECT s, min(doc_id) AS first FROM wins GROUP BY s),
starts AS (SELECT doc_id, pos FROM wins JOIN firsts USING (s) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, pos + k AS p FROM starts, (SELECT unnest(range(13)) AS k)),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM split),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
