"""Items that a template says little about, filters of any size, and all windows by brute force."""

import random

import pytest

from palimpsest.llm import decontamination

from .conftest import docs_of

SUM = "12 + 7 * 3 kg = 33 kg, 14 + 9 * 2 kg = 32 kg"
ITEMS = [(1, SUM), (2, "What is 2 + 2?"), (3, "4 8 15 16 23 42"), (4, "Why?"), (5, ""), (6, None)]


def found(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r["items"] for r in decontamination.contaminated(docs_of(spark, docs), bench).collect()}


def test_items_of_figures_and_short_items_match_verbatim(spark):
    docs = [
        (1, f"before {SUM} behind"),
        (2, SUM.replace("12", "13").replace("7", "8").replace("33", "37").replace("14", "15").replace("9", "5").replace("32", "25")),
        (3, "some text\nwhat is 2 + 2?\nmore text"),
        (4, "what is 2 + 2? asked on a line with more"),
        (5, "what is 3 + 3?"),
        (6, "the numbers 4 8 15 16 23 42 again"),
        (7, "the numbers 4 8 15 16 23 43 again"),
        (8, "why"),
        (9, "and why not\n\n"),
        (10, ""),
        (11, None),
    ]
    assert found(spark, docs, ITEMS) == {1: [1], 3: [2], 6: [3], 8: [4]}


@pytest.mark.parametrize("most", [1 << 28, 1 << 10, 1 << 12])
def test_filters_of_any_size_lose_no_window(spark, monkeypatch, most):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(str(rng.randrange(100)) if rng.random() < 0.4 else rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(5, 30))) for i in range(40)]
    docs = [(i, " ".join([text(15), *(rng.choice(items)[1] for _ in range(i % 2)), text(15)])) for i in range(60)]
    monkeypatch.setattr(decontamination, "MOST_BITS", most)
    monkeypatch.setattr(decontamination, "LEAST_BITS", 1 << 10)

    def windows_of(text):
        tokens, slots = decontamination.template(text)
        size = min(decontamination.WORDS, len(tokens))
        return [(tuple(tokens[i : i + size]) if sum(k in slots for k in range(i, i + size)) * 2 <= size else tuple(decontamination.stated(tokens, slots)[i : i + size])) for i in range(len(tokens) - size + 1)]

    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = decontamination.item_windows(bench).cache()
    got = {(r.doc_id, r.doc_pos, r.doc_words, r.doc_h) for r in decontamination.candidates(docs_of(spark, docs), windows, windows.count()).collect()}
    hashes = {}
    for r in windows.collect():
        hashes[windows_of(dict(items)[r.item_id])[r.item_pos]] = (r.words, r.h)
    want = set()
    for i, text in docs:
        tokens, slots = decontamination.template(text)
        exact = decontamination.stated(tokens, slots)
        for size in {w for w, _ in hashes.values()}:
            for at in range(len(tokens) - size + 1):
                key = tuple(tokens[at : at + size]) if sum(k in slots for k in range(at, at + size)) * 2 <= size else tuple(exact[at : at + size])
                if key in hashes:
                    want.add((i, at, *hashes[key]))
    assert want and want <= got
