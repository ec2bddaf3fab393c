"""The near-copy stage against exact Jaccard similarities."""

import numpy as np
import pytest

from palimpsest.llm import simhash

from .conftest import docs_of


def classes(ids, sets, similarity):
    label = dict(zip(ids, ids, strict=True))
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if label[a] != label[b] and (not x | y or len(x & y) >= similarity * len(x | y) - 1e-9):
                old = label[b]
                label = {k: label[a] if v == old else v for k, v in label.items()}
    groups = {}
    for k, v in label.items():
        groups.setdefault(v, []).append(k)
    return sorted(sorted(g) for g in groups.values())


def texts_of(draw, n=24):
    """Families of texts of which some words were changed: similarities from 0.4 to 1."""
    words = [f"w{i}" for i in range(50_000)]
    made = []
    for _ in range(n):
        base = draw.choice(words, int(draw.integers(60, 300))).tolist()
        for _ in range(5):
            text = list(base)
            for at in draw.choice(len(base), int(draw.integers(0, max(2, len(base) // 25))), replace=False):
                text[at] = str(draw.choice(words))
            made.append(" ".join(text))
    return made


def shingles(text):
    return set(simhash.shingle_set(text.encode(), 5).tolist())


def test_forest_of_similar_sets():
    draw = np.random.default_rng(1)
    sets = [np.array([], np.uint64)] * 2 + [simhash.shingle_set(t.encode(), 5) for t in texts_of(draw)]
    ids = list(range(100, 100 + len(sets)))
    edges = list(simhash.similar_forest(ids, sets, 0.8))
    want = classes(ids, {i: set(s.tolist()) for i, s in zip(ids, sets, strict=True)}, 0.8)
    label = {i: i for i in ids}
    for u, v in edges:
        label = {k: label[v] if x == label[u] else x for k, x in label.items()}
    got = {}
    for k, v in label.items():
        got.setdefault(v, []).append(k)
    assert sorted(sorted(g) for g in got.values()) == want
    assert len(edges) == len(ids) - len(want)


@pytest.mark.parametrize("piece", [simhash.PIECE_SETS, 2])
def test_one_of_each_group_of_true_near_copies(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE_SETS", piece)
    texts = texts_of(np.random.default_rng(2))
    want = {g[0] for g in classes(list(range(len(texts))), {i: shingles(t) for i, t in enumerate(texts)}, 0.8)}
    assert 24 < len(want) < len(texts)
    assert {r.doc_id for r in simhash.one_of_each(docs_of(spark, list(enumerate(texts)))).collect()} == want


def test_a_repeated_line_makes_no_near_copies(spark):
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50_000)]
    line = " ".join(draw.choice(words, 10))
    texts = [f"{' '.join(draw.choice(words, 500))} {' '.join([line] * 20)}" for _ in range(6)]
    assert {r.doc_id for r in simhash.one_of_each(docs_of(spark, list(enumerate(texts)))).collect()} == set(range(6))
