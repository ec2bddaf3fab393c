"""Component search over long chains, and toxicity words in the face of copies."""

import random

from palimpsest.llm import toxicity
from palimpsest.llm.common import connected_components


def test_chains_and_stars(spark):
    ids = list(range(1, 121))
    random.Random(3).shuffle(ids)
    chain = list(zip(ids, ids[1:], strict=False))
    star = [(1000 + i, 5000) for i in range(50)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame([*chain, *star, (7, 7)], "u long, v long")).collect()}
    assert got == {i: 1 for i in ids} | {i: 1000 for i in [*range(1000, 1050), 5000]}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_of_copies_are_not_significant():
    draw = random.Random(5)
    text = lambda: [f"w{draw.randrange(3000)}".encode() for _ in range(60)]
    copied = [b"copied", b"passage", *text()]
    toxic = [[*t[:20], b"moron", *t[20:40], b"moron", *t[40:]] for t in (text() for _ in range(60))] + [copied] * 200
    runs = toxicity.toxic_runs(toxic, [text() for _ in range(200)])
    found = {p for words in toxic for p in toxicity.passages(words, runs)}
    assert found and all(b"moron" in p for p in found)
    assert toxicity.passages([b"a"], runs) == toxicity.passages([], runs) == toxicity.passages(copied, runs) == []
    assert len(toxicity.without_copies([*([copied] * 5), text(), [], []])) == 3
