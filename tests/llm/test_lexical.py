"""Ranked search against plain scoring of every document, on every tier, and its SQL."""

import math
import random
import re

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from palimpsest.llm import lexical, queries

from .conftest import CLASHING, docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    split = [(i, plain_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(s) for _, s in split), sum(len(s) for _, s in split)
    out = []
    for item, text in items:
        found = []
        for doc_id, s in split:
            score = 0
            for t in plain_terms(text):
                if tf := s.count(t):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in split) + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * len(s) * n_docs // n_terms)))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(found[:k])]
    return sorted(out)


def told(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("tiers", [(), (0.1, 0.4), (0.02, 0.1, 0.3, 0.9)])
def test_against_plain_scores(spark, tiers):
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(300)] + [(900 + i, "w7 w8 w9") for i in range(30)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(25)] + [(100, "w7 w7 W8"), (101, "nowhere"), (102, "w299")]
    made = spark.createDataFrame(items, "item_id long, text string")
    assert told(lexical.search(docs_of(spark, docs).repartition(5), made, k=5, tiers=tiers, block=9)) == by_hand(docs, items, 5)


def test_proven_items_stop_above_the_last_tier(spark, monkeypatch):
    docs = [(i, f"rare{i % 3} " + "common " * (1 + i % 9)) for i in range(400)]
    items = [(0, "rare1"), (1, "rare0 rare1 rare2")]
    seen, answers = [], lexical.answers
    monkeypatch.setattr(lexical, "answers", lambda tables, asked, k, *rest: seen.append((len(asked), bool(rest))) or answers(tables, asked, k, *rest))
    got = told(lexical.search(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k=5, tiers=(0.2,)))
    assert got == by_hand(docs, items, 5)
    assert seen[0] == (2, False) and (1, True) in seen and seen[-1] == (1, False)


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "same WORDS w3"), (1, "nobody's"), (2, None), (3, "!"), (None, "one")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = lexical.search(odd.select("*", *[F.lit(1).alias(c) for c in CLASHING]), items, k=20)
    want = by_hand(docs, [(1, "same WORDS w3 nobody's"), (-1, "one")], 20)
    assert sorted((-1 if r.item_id is None else r.item_id, r.rank, r.score) for r in got.collect()) == [(i, r, s) for i, r, _, s in want]
    assert lexical.search(nothing, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


def test_equals_its_sql(spark, duck):
    assert rows(queries.QUERIES["op13_lexical"](spark, SMALL).toPandas()) == rows(duck.sql(queries.ORACLES["op13_lexical"]).df())
