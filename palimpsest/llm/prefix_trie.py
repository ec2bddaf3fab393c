"""The trie of conversation prefixes, as intervals of the sorted conversations.

Every turn becomes a digest of its role and text, every conversation the row of its turns' digests. Conversations are
range-sorted by these (ties by conv_id), so that the members of a trie node are an interval in which neighbours agree
in at least its depth: the nodes are those of the Cartesian tree over the array of longest common prefixes (LCP), an
interval for each stretch between nearest smaller values, with equal LCPs merged into one node and the depths that the
tree skips expanded. A conversation owns the nodes from its LCP with its predecessor (exclusive) to its length.

Each block of the sort finds nearest smaller values with a stack of its own, in one pass. Two kinds of nodes are left
open: those that the first conversation of the block may share with the block before (one for each of its depths),
and those still on the stack at the end. Blocks tell these, their first and last rows and, by the former, the least LCP
(block minimum) that decides which nodes pass through; where two blocks meet, the LCP of their ends says which open
nodes are one. These few rows a block are joined by depth, summed, and looked up as parents of closed nodes.

All sums over a subtree are sums over its interval: a member that isn't the first saves the words that it shares with
its predecessor below the node; a leaf ends where the next LCP is smaller than the conversation's length.

Rows without a conv_id take no part. Null roles and texts are empty, turns that are null come first, turns of equal
number (repeated rows among them) are in the order of their digests. Very long texts are digested where they are read;
they are not shuffled. A conversation is one row of 24 bytes a turn. An empty table has no trie. Other columns are
not read. Turns are equal if 128 bits of their SHA-256 are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, keep

#: Bytes of a turn's digest; turns a block of the sort has, about; bytes of a piece of a long list of ids.
DIGEST, BLOCK, CHUNK = 16, 500_000, 1 << 20
#: Rows up to which the table of shared nodes (some 30 bytes a row) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 100_000


def digest(role: Column, text: Column) -> Column:
    """Of role and text, as 32 hex digits; the role's length keeps the two apart."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (digest, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").alias("turn"), digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("turn"))
    ordered = F.sort_array(F.collect_list("turn"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % group, h being crc32(c) % heads, and
    goes on with its own turns after its first h. As all with one such head have ids within 2 * group, its window
    has fewer rows than that."""
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, heads))).over(Window.partitionBy("base"))
    known = sequences(conversations).select("conv_id", "turns", base, h.alias("h")).withColumn("head", head)
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return known.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Digests that two rows of them begin with alike."""
    if a == b:
        return len(a) // DIGEST
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


#: Rows that a block tells. NODE: a closed node. EDGE: an open one; late if it began after the first conversation, through
#: if it is open at the end; shared sums what members have in common with their predecessors (in words), before are the
#: words above the node's last turn. PART: a piece of the ids that end at an EDGE. ENDS: first and last digests and
#: the first row's words by depth. up: null, or whether the parent, an EDGE of this block, is late.
NODE, EDGE, PART, ENDS = 0, 1, 2, 3
FIELDS = {"kind": pa.int32(), "block": pa.int32(), "depth": pa.int32(), "late": pa.int32(), "through": pa.bool_(), "conv_id": pa.int64(), "n": pa.int64(), "children": pa.int64(), "leaves": pa.int64(), "shared": pa.int64(), "before": pa.int64(), "up": pa.int32(), "parent": pa.int64(), "ends": pa.string(), "number": pa.int32(), "first": pa.binary(), "last": pa.binary(), "words": pa.list_(pa.int64())}
PIECES = "kind int, block int, depth int, late int, through boolean, conv_id long, n long, children long, leaves long, shared long, before long, up int, parent long, ends string, number int, first binary, last binary, words array<long>"
NO_IDS = hashlib.sha256(b"").hexdigest()


class Node:
    """An open node: whether the block's first conversation is its first here, sums so far, closed children, ids that end
    at it."""

    __slots__ = ("before", "children", "conv_id", "edge", "ends", "held", "leaves", "n", "shared")

    def __init__(self, edge: bool, before: int):
        self.edge, self.before, self.conv_id = edge, before, None
        self.n = self.children = self.leaves = self.shared = 0
        self.held: list[dict] = []
        self.ends: list[int] = []


class Sweep:
    """The stack of one block; the node of depth d stands at d."""

    def __init__(self, block: int):
        self.block, self.stack, self.out = block, [], []
        self.first = self.last = b""
        self.words = np.zeros(1, np.int64)

    def add(self, conv_id: int, digests: bytes, words: np.ndarray) -> None:
        """The next conversation; ``words`` are those of its first 0, 1, 2... turns."""
        depth = len(digests) // DIGEST
        if not self.stack:
            self.first, self.words = digests, words
            self.stack = [Node(True, int(words[max(0, d - 1)])) for d in range(depth + 1)]
        else:
            same = common(self.last, digests)
            if same < len(self.stack) - 1:
                self.stack[-1].leaves += 1
            while len(self.stack) > same + 1:
                self.close()
            self.stack[-1].shared += int(words[same])
            for d in range(same + 1, depth + 1):
                self.stack[-1].children += 1
                self.stack.append(Node(False, int(words[d - 1])))
        node = self.stack[-1]
        node.n += 1
        node.conv_id = conv_id if node.conv_id is None else min(node.conv_id, conv_id)
        node.ends.append(conv_id)
        self.last = digests

    def close(self) -> None:
        """The deepest node ends, and what it has summed holds for its parent too."""
        node, depth = self.stack.pop(), len(self.stack)
        above = self.stack[-1]
        if node.edge:
            self.edge(node, depth, False, 0)
        else:
            self.out += ({**c, "parent": node.conv_id} for c in node.held)
            ids = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else NO_IDS
            own = {"kind": NODE, "block": self.block, "depth": depth, "conv_id": node.conv_id, "n": node.n, "children": node.children, "leaves": node.leaves, "shared": node.shared, "before": node.before, "ends": ids}
            if above.edge:
                self.out.append({**own, "up": 0})
            else:
                above.held.append(own)
        self.sum(node, above)

    @staticmethod
    def sum(node: Node, above: Node) -> None:
        above.n += node.n
        above.leaves += node.leaves
        above.shared += node.shared
        above.conv_id = node.conv_id if above.conv_id is None else min(above.conv_id, node.conv_id)

    def edge(self, node: Node, depth: int, through: bool, up: int | None) -> None:
        late = int(not node.edge)
        self.out.append({"kind": EDGE, "block": self.block, "depth": depth, "late": late, "through": through, "conv_id": node.conv_id, "n": node.n, "children": node.children, "leaves": node.leaves, "shared": node.shared, "before": node.before, "up": up})
        self.out += ({**c, "up": late} for c in node.held)
        ids = ",".join(map(str, node.ends))
        self.out += ({"kind": PART, "block": self.block, "depth": depth, "late": late, "number": k, "ends": ids[at : at + CHUNK]} for k, at in enumerate(range(0, len(ids), CHUNK)))

    def end(self) -> None:
        if not self.stack:
            return
        while self.stack:
            node, depth = self.stack.pop(), len(self.stack)
            self.edge(node, depth, True, int(not self.stack[-1].edge) if depth else None)
            if depth:
                self.sum(node, self.stack[-1])
        self.out.append({"kind": ENDS, "block": self.block, "first": self.first, "last": self.last, "words": self.words.tolist()})


def pieces(known: DataFrame, blocks: int) -> DataFrame:
    """What the blocks tell of ``known(conv_id, digests, words)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, schema = Sweep(TaskContext.get().partitionId()), pa.schema(list(FIELDS.items()))
        for batch in batches:
            for conv_id, digests, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                sweep.add(conv_id, digests.as_py(), np.cumsum([0, *words.as_py()]))
            yield pa.RecordBatch.from_pylist(sweep.out, schema)
            sweep.out = []
        sweep.end()
        yield pa.RecordBatch.from_pylist(sweep.out, schema)

    return known.repartitionByRange(blocks, "digests", "conv_id").sortWithinPartitions("digests", "conv_id").mapInArrow(work, PIECES)


def seams(told: DataFrame) -> DataFrame:
    """Of each block, by two rows a block: meets and next_meets (the LCP with the block before and after, -1 at the ends of
    all), common (the words of the former), first_size and last_size (turns of its first and last conversation)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                meets = -1 if r["above"] is None else common(r["above"], r["first"])
                following = -1 if r["below"] is None else common(r["last"], r["below"])
                out.append((r["block"], meets, following, r["words"][meets] if meets >= 0 else 0, len(r["first"]) // DIGEST, len(r["last"]) // DIGEST))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (*[pa.int32()] * 3, pa.int64(), *[pa.int32()] * 2), strict=True)], ["block", "meets", "next_meets", "common", "first_size", "last_size"])

    order = Window.orderBy("block")
    ends = told.where(F.col("kind") == ENDS).select("block", "first", "last", "words", F.lag("last").over(order).alias("above"), F.lead("first").over(order).alias("below"))
    return ends.mapInArrow(work, "block int, meets int, next_meets int, common long, first_size int, last_size int")


def hashed(parts: DataFrame) -> DataFrame:
    """depth, run, ends: the SHA-256 of the joined pieces of each run of open nodes, read in order, never held whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        give = lambda: pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], ["depth", "run", "ends"])  # noqa: E731
        for batch in batches:
            for depth, run, number, ends in zip(*(batch.column(c).to_pylist() for c in ("depth", "run", "number", "ends")), strict=True):
                if (depth, run) != now:
                    if now is not None:
                        yield give()
                    now, state = (depth, run), hashlib.sha256()
                elif number == 0:
                    state.update(b",")
                state.update(ends.encode())
        if now is not None:
            yield give()

    return parts.repartition("depth", "run").sortWithinPartitions("depth", "run", "block", "late", "number").mapInArrow(work, "depth int, run long, ends string")


def trie(known: DataFrame, blocks: int | None = None) -> DataFrame:
    """The nodes of the trie of ``known(conv_id, turns(digest, words))``, conv_id being unique."""
    spark = known.sparkSession
    rows = keep(known.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("digests"), F.transform("turns", lambda t: t["words"]).alias("words")), "sequences")
    if blocks is None:
        turns = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // BLOCK)
    told = keep(pieces(rows, blocks), "pieces")
    late, own_first = F.col("late") == 1, (F.col("late") == 0) & (F.col("meets") <= F.col("depth")) & (F.col("depth") < F.col("first_size"))
    starts = (late | (F.col("depth") > F.col("meets"))).cast("long")
    edges = told.where(F.col("kind") == EDGE).join(seams(told), "block").withColumn("run", F.sum(starts).over(Window.partitionBy("depth").orderBy("block", "late")))
    edges = keep(edges, "edges")
    runs = edges.groupBy("depth", "run").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n"),
        F.sum(F.col("children") + own_first.cast("long")).alias("children"),
        F.sum(F.col("leaves") + (F.col("through") & (F.col("next_meets") < F.col("last_size"))).cast("long")).alias("leaves"),
        F.sum(F.col("shared") + F.when(~late & (F.col("depth") <= F.col("meets")), F.col("common")).otherwise(0)).alias("shared"),
        F.min("before").alias("before"),
        F.min(F.struct("block", "late", "up")).alias("start"),
    )
    parts = told.where(F.col("kind") == PART).select("block", "depth", "late", "number", "ends").join(edges.select("block", "depth", "late", "run"), ["block", "depth", "late"])
    runs = keep(runs.join(hashed(parts), ["depth", "run"], "left"), "runs")
    owners = keep(edges.select("block", "depth", "late", "run").join(runs.select("depth", "run", "conv_id"), ["depth", "run"]).select(F.col("block").alias("its_block"), (F.col("depth") + 1).alias("its_depth"), F.col("late").alias("its_late"), F.col("conv_id").alias("owner")), "owners")
    side = F.broadcast(owners) if owners.count() <= BROADCAST_ROWS else owners
    met = (F.col("block") == F.col("its_block")) & (F.col("depth") == F.col("its_depth")) & (F.col("up") == F.col("its_late"))
    sums = ["conv_id", "depth", "n", "children", "leaves", "shared", "before", "ends"]
    closed = told.where(F.col("kind") == NODE)
    inside = closed.where("up IS NULL").select(*sums, "parent")
    below = closed.where("up IS NOT NULL").join(side, met).select(*sums, F.col("owner").alias("parent"))
    opened = runs.select(*sums, F.col("start.block").alias("block"), F.col("start.up").alias("up")).join(side, met, "left").select(*sums, F.col("owner").alias("parent"))
    return inside.unionByName(below).unionByName(opened).select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(sequences(conversations))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that :func:`rebuilt` makes."""
    return trie(rebuilt(conversations))


ORACLE = r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
crcs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM ids),
built AS (
  SELECT c.conv_id, t.i, t.digest, t.words FROM crcs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 100 + t.i, t.digest, t.words FROM crcs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, digest, words FROM built),
steps AS (
  SELECT conv_id, d, words, string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
lengths AS (SELECT conv_id, max(d) AS size FROM steps GROUP BY conv_id),
nodes AS (
  SELECT d, prefix, min(s.conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
    coalesce(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (WHERE size = d), '') AS ends
  FROM steps s JOIN lengths l ON s.conv_id = l.conv_id GROUP BY d, prefix),
links AS (SELECT DISTINCT a.d AS up_d, a.prefix AS up, b.d, b.prefix FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.d = a.d + 1),
degree AS (SELECT up_d AS d, up AS prefix, count(*) AS children FROM links GROUP BY 1, 2),
below AS (SELECT DISTINCT a.d, a.prefix, b.d AS low_d, b.prefix AS low FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (
  SELECT b.d, b.prefix, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (WHERE g.children IS NULL) AS leaves
  FROM below b JOIN nodes n ON n.d = b.low_d AND n.prefix = b.low LEFT JOIN degree g ON g.d = n.d AND g.prefix = n.prefix GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(g.children, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.prefix = n.prefix LEFT JOIN degree g ON g.d = n.d AND g.prefix = n.prefix
LEFT JOIN links l ON l.d = n.d AND l.prefix = n.prefix LEFT JOIN nodes p ON p.d = l.up_d AND p.prefix = l.up
"""
