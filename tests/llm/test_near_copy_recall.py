"""How many lone pairs of near copies, between 0.8 and 0.9, the near-copy stage finds."""

import numpy as np

from palimpsest.llm import simhash

from .conftest import docs_of
from .test_similar_sets import shingles


def test_lone_pairs_just_above_the_limit(spark):
    draw = np.random.default_rng(11)
    words = [f"w{i}" for i in range(50_000)]
    texts, pairs = [], 0
    for _ in range(150):
        base = draw.choice(words, 300).tolist()
        other = list(base)
        for at in draw.choice(300, int(draw.integers(4, 7)), replace=False):
            other[at] = str(draw.choice(words))
        a, b = " ".join(base), " ".join(other)
        x, y = shingles(a), shingles(b)
        if 0.8 <= len(x & y) / len(x | y) <= 0.9:
            pairs += 1
            texts += [a, b]
    kept = simhash.one_of_each(docs_of(spark, list(enumerate(texts)))).count()
    assert pairs > 100 and (len(texts) - kept) / pairs >= 0.95
