"""What the language model reads and sends: texts once, a portion's different pairs once, nothing learnt from held-out ones."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import hpylm

from .conftest import docs_of


def texts_of(n, seed):
    draw = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in draw.zipf(1.3, 40) % 500) for _ in range(n)]


def test_texts_are_cut_into_words_once(spark):
    """Apart from their lengths, which set the number of shards; they were cut again for their scores."""
    seen = spark.sparkContext.accumulator(0)

    def noted(text):
        seen.add(1)
        return text

    docs = docs_of(spark, list(enumerate(texts_of(50, 1)))).withColumn("text", F.udf(noted, "string").asNondeterministic()("text"))
    assert hpylm.score(docs).count() == 50
    assert 50 < seen.value <= 100


def test_pairs_come_in_order_and_once():
    texts = ["b a b a", "", "a b", "c b a b"]
    words = [[*t.split(), None] for t in texts]
    batch = pa.record_batch([pa.array(range(4)), pa.array(texts), pa.array([1, 2, 3, 4]), pa.array([False, False, False, True])], ["uid", "text", "doc_id", "held_out"])
    (portion,) = hpylm.joined_portions(iter([batch]), 1000)
    word, context, n, every, rows = hpylm.ordered_pairs(portion)
    pairs = [(w, b, i) for i, ws in enumerate(words) for b, w in zip([None, *ws], ws, strict=False)]
    total, learnt = Counter(p[:2] for p in pairs), Counter(p[:2] for p in pairs if p[2] != 3)
    assert sorted(zip(every.tolist(), n.tolist(), strict=True)) == sorted((k, learnt[p]) for p, k in total.items())
    assert list(zip(word.tolist(), context.tolist(), strict=True)) == sorted(zip(word.tolist(), context.tolist(), strict=True))
    assert np.bincount(rows).tolist() == [len(ws) for ws in words]
    steps, gaps = hpylm.gaps(word), hpylm.name_gaps(context)
    assert (hpylm.sums_of(steps) == word).all() and (hpylm.names_of(gaps) == context).all()


def test_held_out_texts_teach_nothing(spark):
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = texts_of(200, 2)
    other = [re.sub("w", "v", t) if out(i) else t for i, t in enumerate(texts)]
    one, two = ({r.doc_id: r for r in hpylm.score(docs_of(spark, list(enumerate(x)))).collect()} for x in (texts, other))
    assert {r.held_out for r in one.values()} == {True, False}
    for i, r in one.items():
        assert r.train_tokens == two[i].train_tokens
        if not out(i):
            assert (r.n_known, r.n_tokens) == (two[i].n_known, two[i].n_tokens) == (r.n_tokens, r.n_tokens)
            assert np.isclose(r.base_score, two[i].base_score) and np.isclose(r.score, two[i].score, rtol=1e-6)
        else:
            assert two[i].n_known == 1 and two[i].score < r.score
