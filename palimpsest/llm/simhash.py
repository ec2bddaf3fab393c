"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint is 64 majority votes over the XXH64 of a document's word shingles. Fingerprints within ``radius``
bits link. Two fingerprints that differ in at most r bits agree on one of r + 1 blocks of bits, so only those
that share a block are compared; inside such a bucket the fingerprints are stored as bit planes (one machine
word holds one bit of 64 fingerprints), and the distances to 64 of them are counted at once by carry-save
counters. Counters start at ``2**m - 1 - radius``: a carry out of the top bit means the radius is exceeded, and
words whose 64 lanes have all exceeded it are abandoned. A bucket yields a spanning forest of its links, never
its pairs. Buckets too large for one task are cut into chunks and every pair of chunks gets a task.

Null texts are empty; empty texts have fingerprint zero and link like any other. Rows without a doc_id are not
compared: they get the component of their own fingerprint, null if it has none. Repeated rows repeat in the result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ASCII_LOWER, connected_components, fresh, keep

BITS = 64
FULL, GOLDEN = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)
#: Distinct fingerprints above which blocks are cut once more, so that buckets stay small.
REFINE_ABOVE = 1 << 25
#: Fingerprints in a bucket that one task compares, all at once and at most.
ALL_PAIRS, TASK = 4096, 32768
#: Pairs of a fingerprint and a word of 64 fingerprints that are counted together.
CHUNK = 1 << 18
#: Shingles and sets in a piece of a group of candidates; members that are broadcast.
PIECE_SHINGLES, PIECE_SETS, BROADCAST_ROWS = 1 << 20, 8192, 200_000


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``words`` words of a lower-cased text; the whole of a shorter one."""
    found = text.translate(ASCII_LOWER).split()
    if not found:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, words: int = 4, lanes: int = 1) -> np.ndarray:
    """64 bits a lane: a bit is set if it is set in over half of the hashes. Lanes beyond the first mix the hash."""
    return majority(np.array(shingle_hashes(text, words), np.uint64), lanes)


def majority(hashes: np.ndarray, lanes: int) -> np.ndarray:
    votes = np.zeros(BITS * lanes, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        mixed = np.stack([part, *(mix(part + np.uint64(k) * GOLDEN) for k in range(1, lanes))], axis=1)
        votes += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8 * lanes), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lane_names(lanes: int) -> list[str]:
    return [f"fp{k}" for k in range(lanes)]


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1) -> DataFrame:
    """doc_id and the fingerprint, a signed long for each lane."""
    names = lane_names(lanes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.zeros((batch.num_rows, lanes), np.uint64)
            for i, text in enumerate(batch.column(1)):
                prints[i] = fingerprint((text.as_py() or "").encode(), words, lanes)
            yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in prints.T)], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def block_masks(free: int, blocks: int) -> list[int]:
    """``blocks`` masks that share out the bits of ``free``."""
    bits = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks]) for k in range(blocks)]


def exact_tables(count: int, radius: int) -> list[list[int]]:
    """Masks of which any two 64-bit fingerprints within the radius agree on one."""
    masks = block_masks((1 << BITS) - 1, radius + 1)
    if count > REFINE_ABOVE:
        masks = [m | s for m in masks for s in block_masks(((1 << BITS) - 1) & ~m, radius + 1)]
    return [[m] for m in masks]


def sampled_tables(count: int, lanes: int, share: float) -> list[list[int]]:
    """Masks of k random bits; pairs that differ in ``share`` of their bits agree on one in 99.7 cases of 100."""
    k = max(8, math.ceil(math.log2(max(count, 2))) - 7)
    draw = np.random.default_rng(5)
    tables = []
    for _ in range(math.ceil(6 / (1 - share) ** k)):
        bits = draw.choice(BITS * lanes, k, replace=False).tolist()
        tables.append([sum(1 << b % BITS for b in bits if b // BITS == lane) for lane in range(lanes)])
    return tables


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes of ``prints[n, lanes]``: ``[bit, word]`` holds that bit of 64 fingerprints; 64 divides n."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T).reshape(bits.shape[1], -1, 64), axis=2, bitorder="little").view("<u8").reshape(bits.shape[1], -1)


def within(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query value, word of planes): indices of pairs with a lane within the radius, and those lanes."""
    m = (radius + 1).bit_length()
    start = (1 << m) - 1 - radius
    counters = [np.full(len(words), FULL if start >> i & 1 else 0, np.uint64) for i in range(m)]
    over, alive = np.zeros(len(words), np.uint64), np.arange(len(words))
    for bit in range(len(planes)):
        carry = planes[bit, words] ^ (np.uint64(0) - (queries[:, bit // BITS] >> np.uint64(bit % BITS) & np.uint64(1)))
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if bit >= radius and bit % 4 == 3:
            live = over != FULL
            if np.count_nonzero(live) < 0.8 * len(live):
                over, alive, words, queries = over[live], alive[live], words[live], queries[live]
                counters = [c[live] for c in counters]
                if not len(alive):
                    break
    live = over != FULL
    return alive[live], ~over[live]


def lanes(word: int, bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield word * 64 + low.bit_length() - 1
        bits ^= low


def forest(prints: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges (position, position of its root) of a spanning forest of one bucket's links."""
    n = len(prints)
    padded = np.zeros((-(-n // 64) * 64, prints.shape[1]), np.uint64)
    padded[:n] = prints
    planes, size = planes_of(padded), len(padded) // 64
    open_ = np.full(size, FULL)
    if n % 64:
        open_[-1] = np.uint64((1 << n % 64) - 1)
    def near(batch: list[int]) -> Iterator[tuple[int, int, int]]:
        left = np.flatnonzero(open_)
        words, each = np.tile(left, len(batch)), np.repeat(np.arange(len(batch)), len(left))
        hits, found = within(planes, prints[batch][each], words, radius)
        yield from zip(each[hits].tolist(), words[hits].tolist(), found.tolist(), strict=True)

    def close(lane: int) -> None:
        open_[lane // 64] &= ~np.uint64(1 << lane % 64)

    while (some := np.flatnonzero(open_)).size:
        seeds = [lane for word in some[:64].tolist() for lane in lanes(word, int(open_[word]))][:64]
        linked: dict[int, list[tuple[int, int]]] = {}
        for k, word, bits in near(seeds):
            if bits := bits & int(open_[word]) & ~(1 << seeds[k] % 64 if seeds[k] // 64 == word else 0):
                linked.setdefault(seeds[k], []).append((word, bits))
        for seed in seeds:
            if seed not in linked:
                close(seed)
        for seed, reached in linked.items():
            if not int(open_[seed // 64]) >> seed % 64 & 1:
                continue
            close(seed)
            queue = []
            while True:
                for word, bits in reached:
                    for lane in lanes(word, bits & int(open_[word])):
                        close(lane)
                        queue.append(lane)
                        yield lane, seed
                if not queue or not open_.any():
                    break
                batch, queue = queue[:64], queue[64:]
                reached = [(word, bits) for _, word, bits in near(batch)]


def forests(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """As :func:`forest`, for many small buckets at once: all pairs of each are counted in chunks."""
    sizes = ends - starts
    words_of = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(words_of)))
    lane_of = np.repeat(first[:-1] * 64 - starts, sizes) + np.arange(starts[0], ends[-1])
    padded, valid = np.zeros((first[-1] * 64, prints.shape[1]), np.uint64), np.zeros(first[-1] * 64, np.uint8)
    padded[lane_of], valid[lane_of] = prints[starts[0] : ends[-1]], 1
    planes = planes_of(padded)
    valid = np.packbits(valid.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    each = words_of[bucket]
    links: dict[int, list[tuple[int, int]]] = {}
    upto = np.concatenate(([0], np.cumsum(each)))
    at = 0
    while at < len(lane_of):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK, "right")) - 1)
        count = each[at:to]
        lane = np.repeat(lane_of[at:to], count)
        words = np.repeat(first[bucket[at:to]], count) + np.arange(count.sum()) - np.repeat(upto[at:to] - upto[at], count)
        hits, found = within(planes, padded[lane], words, radius)
        lane, words = lane[hits], words[hits]
        own = np.where(lane // 64 == words, np.uint64(1) << (lane % 64).astype(np.uint64), np.uint64(0))
        found &= valid[words] & ~own
        some = found != 0
        for a, w, bits in zip(lane[some].tolist(), words[some].tolist(), found[some].tolist(), strict=True):
            links.setdefault(a, []).append((w, bits))
        at = to
    back = {int(a): i + int(starts[0]) for i, a in enumerate(lane_of)} if links else {}
    open_: dict[int, int] = {}
    seen: set[int] = set()
    for root in links:
        if root in seen:
            continue
        seen.add(root)
        queue = [root]
        while queue:
            for word, bits in links[queue.pop()]:
                done = open_.get(word, 0)
                for lane in lanes(word, bits & ~done):
                    if lane not in seen:
                        seen.add(lane)
                        queue.append(lane)
                        yield back[lane], back[root]
                open_[word] = done | bits


def bucket_edges(buckets: DataFrame, keys: list[str], lanes: int, radius: int) -> DataFrame:
    """``buckets(*keys, id, fp0, ...)`` to edges (u, v) between ids. A task gets whole buckets, in order of id, so
    that v is the smallest id of its tree and tables that find the same group find the same edges."""
    width = len(keys)

    def settle(rows: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((rows[1:, :width] != rows[:-1, :width]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
        prints = np.ascontiguousarray(rows[:, width + 1 :]).view(np.uint64)
        edges: list[tuple[int, int]] = []
        at = 0
        while at < len(starts):
            base, n = int(starts[at]), int(ends[at] - starts[at])
            if n > ALL_PAIRS:
                edges.extend((base + a, base + b) for a, b in forest(prints[base : base + n], radius))
                at += 1
                continue
            to = at + 1
            while to < len(starts) and ends[to] - starts[to] <= ALL_PAIRS and ends[to] - base <= 1 << 15:
                to += 1
            edges.extend(forests(prints, starts[at:to], ends[at:to], radius))
            at = to
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(rows[pairs[:, 0], width]), pa.array(rows[pairs[:, 1], width])], ["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
                count += batch.num_rows
            if count >= 1 << 16:
                rows = np.concatenate(held)
                same = (rows[:, :width] == rows[-1, :width]).all(axis=1)
                cut = 0 if same.all() else len(rows) - int(np.argmin(same[::-1]))
                if cut:
                    yield settle(rows[:cut])
                held, count = [rows[cut:]], len(rows) - cut
        if count:
            yield settle(np.concatenate(held))

    rows = buckets.select(*keys, "id", *lane_names(lanes))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(work, "u long, v long").distinct()


def links(prints: DataFrame, tables: list[list[int]], radius: int) -> DataFrame:
    """Edges (u, v) between ids of ``prints(id, fp0, ...)`` that connect all whose fingerprints share a table's
    bits and lie within ``radius`` bits of one another."""
    lanes = len(tables[0])
    signed = [[m - (1 << BITS) if m >> 63 else m for m in masks] for masks in tables]
    keys = [F.xxhash64(*[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(lane_names(lanes), masks, strict=True)]) for masks in signed]
    rows = prints.select(F.posexplode(F.array(*keys)).alias("block", "key"), "id", *lane_names(lanes)).withColumn("block", F.col("block").cast("long"))
    sizes = rows.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > TASK)
    hot = keep(sizes.select(F.col("block").alias("b"), F.col("key").alias("k"), F.ceil(F.col("n") / (TASK // 2)).alias("parts")), "hot")
    if not hot.limit(1).count():
        return bucket_edges(rows, ["block", "key"], lanes, radius)
    same = (F.col("block") == F.col("b")) & (F.col("key") == F.col("k"))
    cool = rows.join(hot, same, "left_anti").withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    halves = rows.join(hot, same).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    halves = halves.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(*cool.columns)
    return bucket_edges(cool.union(halves), ["block", "key", "i", "j"], lanes, radius)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint fp0 and component_id, the smallest doc_id reachable over links."""
    prints = keep(fingerprints(docs), "fingerprints")
    distinct = keep(prints.where("doc_id IS NOT NULL").groupBy("fp0").agg(F.min("doc_id").alias("id")), "distinct")
    found = connected_components(links(distinct, exact_tables(distinct.count(), 4), 4))
    total = distinct.join(found, F.col("id") == F.col("node"), "left").select(F.col("fp0").alias("its_fp0"), F.coalesce("label", "id").alias("component_id"))
    return prints.join(total, F.col("fp0") == F.col("its_fp0"), "left").select("doc_id", "fp0", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def set_prints(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """doc_id, mark, the id of the text's set of shingles (a hash of it), its size and its fingerprint."""
    names = lane_names(lanes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, ids, sizes = np.zeros((batch.num_rows, lanes), np.uint64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(2)):
                found = shingle_set((text.as_py() or "").encode(), words)
                prints[i], ids[i], sizes[i] = majority(found, lanes), xxhash.xxh64_intdigest(found.tobytes(), 43), len(found)
            yield pa.record_batch([*batch.columns[:2], pa.array(ids.view(np.int64)), pa.array(sizes), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in prints.T)], ["doc_id", "mark", "id", "n", *names])

    schema = "doc_id long, mark long, id long, n long, " + ", ".join(f"{n} long" for n in names)
    return docs.select("doc_id", "mark", "text").mapInArrow(work, schema)


def similar_forest(ids: list[int], sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Edges (id, id of its root) of a spanning forest of all pairs of sets whose Jaccard similarity is reached."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    if not sizes[-1]:
        yield from ((ids[i], ids[order[0]]) for i in order[1:])
        return
    known, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(known), bool)
    left, left_sizes, left_flat, starts = np.arange(len(order)), sizes, flat, np.concatenate(([0], np.cumsum(sizes)))

    def without(gone: np.ndarray) -> None:
        nonlocal left, left_sizes, left_flat, starts
        left_flat = left_flat[np.repeat(~gone, left_sizes)]
        left, left_sizes = left[~gone], left_sizes[~gone]
        starts = np.concatenate(([0], np.cumsum(left_sizes)))

    while len(left):
        root = int(left[0])
        queue = [root]
        without(np.arange(len(left)) == 0)
        while queue and len(left):
            at = queue.pop()
            size = int(sizes[at])
            a, b = np.searchsorted(left_sizes, (math.floor(similarity * size), math.ceil(size / similarity) + 1))
            if a == b:
                continue
            marked[own[at]] = True
            sums = np.concatenate(([0], np.cumsum(marked[left_flat[starts[a] : starts[b]]])))
            marked[own[at]] = False
            both = np.diff(sums[starts[a : b + 1] - starts[a]])
            near = np.zeros(len(left), bool)
            near[a:b] = both * (1 + similarity) >= similarity * (size + left_sizes[a:b]) - 1e-9
            if near.any():
                new = left[near].tolist()
                queue += new
                yield from ((ids[order[k]], ids[order[root]]) for k in new)
                without(near)


def verified_edges(sets: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """``sets(*keys, id, shingles)`` to edges (u, v) of the pairs within a group that are similar enough."""
    width = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done() -> pa.RecordBatch:
            edges = np.array(list(similar_forest(list(held), list(held.values()), similarity)), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

        for batch in batches:
            for *key, id_, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now and held:
                    yield done()
                    held = {}
                now = key
                held[id_] = np.frombuffer(shingles, "<u8")
        if held:
            yield done()

    assert sets.columns[:width] == keys
    return sets.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(work, "u long, v long")


def similar_sets(docs: DataFrame, distinct: DataFrame, words: int, candidates: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) that connect the ids of ``distinct(id, n, its_doc, its_mark)`` whose sets are similar enough and
    which ``candidates(node, label)`` gives the same label. Labels with more shingles than one task can hold are cut
    into pieces, and every pair of pieces gets a task."""
    members = keep(distinct.join(candidates, F.col("id") == F.col("node")).select("id", "n", "its_doc", "its_mark", "label"), "members")
    parts = F.greatest(F.ceil(F.sum("n") / PIECE_SHINGLES), F.ceil(F.count("*") / PIECE_SETS)).alias("parts")
    cut = keep(members.groupBy("label").agg(parts).where("parts > 1").select(F.col("label").alias("cut_label"), "parts"), "cut")
    found = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = docs.select("doc_id", "mark", "text").join(found, (F.col("doc_id") == F.col("its_doc")) & (F.col("mark") == F.col("its_mark")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set((t.as_py() or "").encode(), words).tobytes() for t in batch.column(2)]
            yield pa.record_batch([*batch.columns[:2], pa.array(sets, pa.binary())], ["label", "id", "shingles"])

    sets = texts.select("label", "id", "text").mapInArrow(work, "label long, id long, shingles binary")
    none = F.lit(0).cast("long")
    if not cut.limit(1).count():
        return verified_edges(sets, ["label"], similarity)
    dealt = sets.join(F.broadcast(cut), F.col("label") == F.col("cut_label"), "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), "parts")).withColumn("other", F.explode(F.sequence(none, F.col("parts") - 1)))
    return verified_edges(dealt.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "shingles"), ["label", "i", "j"], similarity)


def row_hash(docs: DataFrame) -> Column:
    """XXH64 of all columns; maps, which have no hash, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema])


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without all but the smallest doc_id of each group of near copies.

    Two documents link if the Jaccard similarity of their sets of shingles is at least ``similarity``; no other pair
    does. Candidates come from 256-bit fingerprints that every shingle of the set votes on once: sets of similarity
    s share 2s/(1+s) of their shingles, and fingerprints differ in acos(2s/(1+s))/pi of their bits on average.
    Candidates may differ in four standard deviations more; all pairs of a group of candidates are then compared
    by their sets. Rows without a doc_id stay. Texts that share a doc_id are compared like any others; of rows with the
    same doc_id and text that one stays whose columns have the smallest hash. All columns stay as they are.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = round((share + 4 * math.sqrt(share * (1 - share) / (4 * BITS))) * 4 * BITS)
    mark, row = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), row_hash(docs)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark.alias("mark"))
    prints = set_prints(marked.where("doc_id IS NOT NULL"), words, 4)
    first = F.min(F.struct("doc_id", "mark"))
    distinct = keep(prints.groupBy("id", "n", *lane_names(4)).agg(first.alias("first")).select("id", "n", *lane_names(4), F.col("first.doc_id").alias("its_doc"), F.col("first.mark").alias("its_mark")), "distinct")
    candidates = connected_components(links(distinct, sampled_tables(distinct.count(), 4, share), radius))
    found = connected_components(similar_sets(marked, distinct, words, candidates, similarity))
    label = F.coalesce("label", "id")
    first = F.min(F.struct("its_doc", "its_mark")).alias("kept")
    kept = distinct.join(found, F.col("id") == F.col("node"), "left").groupBy(label.alias("component")).agg(first).select("kept.*")
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("row_doc"), mark.alias("row_mark"), row.alias("row"))
    chosen = rows.join(kept, (F.col("row_doc") == F.col("its_doc")) & (F.col("row_mark") == F.col("its_mark"))).groupBy("row_doc", "row_mark").agg(F.min("row").alias("row"))
    names = [fresh(docs, n) for n in ("kept_id", "kept_mark", "kept_row")]
    own_mark, own_row = fresh(docs, "own_mark"), fresh(docs, "own_row")
    both = docs.withColumns({own_mark: mark, own_row: row})
    same = (F.col("doc_id") == F.col(names[0])) & (F.col(own_mark) == F.col(names[1])) & (F.col(own_row) == F.col(names[2]))
    staying = both.join(chosen.toDF(*names), same, "left_semi").dropDuplicates(["doc_id", own_mark, own_row]).drop(own_mark, own_row)
    return staying.unionByName(docs.where("doc_id IS NULL"))
