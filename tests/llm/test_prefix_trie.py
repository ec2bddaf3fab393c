"""The trie against one built node by node, with few and many blocks; odd conversations."""

import hashlib
import random
import zlib

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from palimpsest.llm import prefix_trie, queries

FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def by_hand(sequences):
    """sequences: conv_id to a list of (role, text)."""
    nodes = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    children = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in nodes}
    words = lambda p: len(p[-1][1].encode().split()) if p else 0
    return sorted(
        repr((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below[p]), sum((len(nodes[q]) - 1) * words(q) for q in below[p]), hashlib.sha256(",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p)).encode()).hexdigest()))
        for p, m in nodes.items()
    )


def told(df):
    return sorted(repr(tuple(r[f] for f in FIELDS)) for r in df.collect())


def table(spark, sequences):
    return spark.createDataFrame([(c, i, role, text) for c, turns in sequences.items() for i, (role, text) in enumerate(turns)], "conv_id long, turn int, role string, text string")


@pytest.mark.parametrize("blocks", [1, 3, 17])
@pytest.mark.parametrize("kind", ["few letters", "copies", "long"])
def test_against_a_trie_by_hand(spark, kind, blocks):
    rng = random.Random(kind)
    turn = lambda: (rng.choice(["user", "bot"]), rng.choice(["a", "b b", ""]))
    made = {
        "few letters": lambda: {c: [turn() for _ in range(rng.randint(1, 5))] for c in range(300)},
        "copies": lambda: {c: [("user", "same words"), ("bot", "again")][: 1 + (c % 7 > 0)] if c % 3 else [turn() for _ in range(3)] for c in range(300)},
        "long": lambda: {c: [("user", "x")] * (c % 60 + 1) for c in range(150)},
    }[kind]()
    assert told(prefix_trie.trie(prefix_trie.sequences(table(spark, made)), blocks)) == by_hand(made)


def test_rebuilt_conversations(spark):
    rng = random.Random(5)
    made = {c: [("user", rng.choice("abc")) for _ in range(rng.randint(1, 6))] for c in [*range(-25, 70), 400, 401, 402, 403, 404]}
    del made[40]  # whose group has no head
    want = {}
    for c, turns in made.items():
        base, h = c - (abs(c) % 20 if c > 0 else -(abs(c) % 20)), zlib.crc32(str(c).encode()) % 4
        want[c] = made.get(base, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert told(prefix_trie.rebuilt_trie(table(spark, made))) == by_hand(want)


def test_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, 2, "user", "later"), (1, None, None, None), (1, 2, "user", "later"), (None, 1, "user", "nobody's"), (2, None, "", ""), (2, 2, "user", "later"), (2, 2, "user", "later"), (3, 1, "user", "word " * 50_000)],
        "conv_id long, turn int, role string, text string",
    )
    want = {1: [("", ""), ("user", "later"), ("user", "later")], 3: [("user", "word " * 50_000)]}
    want[2] = want[1]
    assert told(prefix_trie.prefix_trie(odd.select("*", *[F.lit(1).alias(c) for c in ("turns", "digests", "block", "depth", "run", "base", "h", "head")]))) == by_hand(want)
    assert prefix_trie.rebuilt_trie(odd.limit(0)).count() == 0


def test_equals_its_sql(spark, duck):
    assert rows(queries.QUERIES["op12_prefix_trie"](spark, SMALL).toPandas()) == rows(duck.sql(queries.ORACLES["op12_prefix_trie"]).df())
