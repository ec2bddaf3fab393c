"""Packing: ids against the tokenizers library, rounds against sequential best fit, pieces that put texts together again."""

import bisect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import packing

from .conftest import docs_of

SF = "/root/testdata/sf0.01"


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own


def best_fit_decreasing(sizes, capacity):
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        if gap > size:
            bisect.insort(gaps, gap - size)
    return opened


@pytest.mark.parametrize("kind", ["even", "small", "alike", "halves", "one", "huge group"])
def test_rounds_against_best_fit(spark, kind):
    rng = random.Random(kind)
    sizes = {
        "even": [rng.randint(1, 1024) for _ in range(1500)],
        "small": [rng.randint(1, 9) for _ in range(1500)],
        "alike": [100] * 900,
        "halves": [512] * 301 + [513] * 100 + [511] * 100,
        "one": [3],
        "huge group": [340] * 800 + [rng.randint(1, 700) for _ in range(400)],
    }[kind]
    made = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    got = packing.best_fit(made, block=200).collect()
    assert sorted(r.id for r in got) == list(range(len(sizes)))
    loads = {}
    for r in got:
        loads[r.seq] = loads.get(r.seq, 0) + sizes[r.id]
    assert max(loads.values()) <= 1024
    assert len(loads) <= 1.02 * best_fit_decreasing(sizes, 1024) + 1


def test_pairings_serve_the_nearest_blocks_first():
    # block 1's three pieces of up to 100 go two to a gap of at least 210; block 2 gets what is left of block 1, then of 0
    assert packing.pairings([(0, 3, 210, 0, 0), (1, 1, 90, 3, 100), (2, 0, 0, 2, 80)]) == [(1, 0, 3, 0, 0, 2), (2, 0, 1, 1, 0, 1), (2, 1, 2, 0, 2, 2)]


def whole(rows):
    """Pieces tile their documents, sequences are gapless and not too long."""
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for of in places.values():
        of.sort()
        assert [at for at, _ in of] == [sum(n for _, n in of[:k]) for k in range(len(of))]
        assert sum(n for _, n in of) <= 1024
    return len(places)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, block=300).collect()
    n = whole(got)
    own, want = tokenizer(), []
    for r in docs.collect():
        ids = np.array([*own.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert n <= 1.01 * best_fit_decreasing([w[3] for w in want], 1024) + 1


def test_odd_documents(spark, odd, nothing):
    got = packing.pack(odd.select("*", F.lit(1).alias("id"), F.lit(2).alias("size"), F.lit(3).alias("seq"), F.lit(4).alias("kind"))).collect()
    whole(got)
    assert sorted((r.doc_id, r.length) for r in got if r.doc_id in (1, 2)) == [(1, 1), (2, 1)]
    assert sum(r.doc_id == 6 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert packing.pack(nothing).count() == 0


def test_texts_that_are_hard_to_split(spark):
    own = tokenizer()
    for text in ("<|endoftext|> a", "\n" * 50_000 + "x", " " * 50_000, "a" * 100_000, "é" * 20_000, "\x00​", "it's 12's\r\n\t x"):
        assert packing.encoder(None)(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_sequences_hold_their_documents_ids(spark):
    docs = docs_of(spark, [(k, "word " * (k * 37 % 900)) for k in range(60)])
    own, texts = tokenizer(), {r.doc_id: r.text for r in docs.collect()}
    parts = {}
    for r in packing.sequences(docs, capacity=256).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 256
        ends = [*[p.offset for p in r.parts[1:]], len(ids)]
        for p, end in zip(r.parts, ends, strict=True):
            parts[p.doc_id, p.piece] = ids[p.offset : end].tolist()
    for k, text in texts.items():
        assert sum((parts[key] for key in sorted(parts) if key[0] == k), []) == [*own.encode(text, add_special_tokens=False).ids, 2]
