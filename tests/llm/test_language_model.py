"""The sharded sampler against a plain one that seats every customer of every restaurant one by one."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import hpylm

from .conftest import docs_of


class Restaurant:
    def __init__(self, parent, d, s):
        self.parent, self.d, self.s, self.tables = parent, d, s, {}
        self.c = self.t = 0

    def p(self, w):
        own = self.tables.get(w, ())
        return (sum(own) - self.d * len(own) + (self.s + self.d * self.t) * self.parent.p(w)) / (self.s + self.c)

    def add(self, w, draw):
        own = self.tables.setdefault(w, [])
        weights = [n - self.d for n in own] + [(self.s + self.d * self.t) * self.parent.p(w)]
        k = draw.choices(range(len(weights)), weights)[0]
        self.c += 1
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            self.t += 1
            self.parent.add(w, draw)

    def remove(self, w, draw):
        own = self.tables[w]
        k = draw.choices(range(len(own)), own)[0]
        own[k] -= 1
        self.c -= 1
        if not own[k]:
            del own[k]
            self.t -= 1
            self.parent.remove(w, draw)


class Uniform:
    def __init__(self, p):
        self.p = lambda w: p

    def add(self, w, draw):
        pass

    remove = add


def plain_scores(split, learn, states, sweeps=60, burn_in=20):
    d = states[0].discounts
    s = [float(np.mean([x.strengths[k] for x in states])) for k in range(3)]
    root = Restaurant(Uniform(1 / (len({w for i in learn for w in split[i]}) + 1)), d[2], s[2])
    classes, contexts, draw = {}, {}, random.Random(1)

    def restaurant(before):
        if before not in contexts:
            two = np.array([0, 0, *before[-2:]], np.uint8)[-2:]
            k = -1 if before == b"" else int(hpylm.class_of(two[:1], two[1:])[0])
            classes.setdefault(k, Restaurant(root, d[1], s[1]))
            contexts[before] = Restaurant(classes[k], d[0], s[0])
        return contexts[before]

    pairs = lambda ws: list(zip([b"", *ws], ws, strict=False))
    seen = [x for i in learn for x in pairs(split[i])]
    for b, w in seen:
        restaurant(b).add(w, draw)
    every = {x for ws in split.values() for x in pairs(ws)}
    total = Counter()
    for sweep in range(sweeps):
        for b, w in seen:
            restaurant(b).remove(w, draw)
            restaurant(b).add(w, draw)
        if sweep >= burn_in:
            for x in every:
                total[x] += restaurant(x[0]).p(x[1])
    return {i: sum(math.log10(total[x] / (sweeps - burn_in)) for x in pairs(ws)) for i, ws in split.items()}


def test_scores_are_those_of_a_plain_sampler(spark, monkeypatch):
    draw = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("ing", "en", "es", "tion")]
    weights = 1 / np.arange(1, len(words) + 1)
    texts = []
    for _ in range(50):
        at, text = 0, []
        for _ in range(int(draw.integers(5, 60))):
            at = int(draw.choice(len(words), p=weights / weights.sum())) if draw.random() < 0.5 else (at * 7 + 3) % len(words)
            text.append(words[at])
        texts.append(" ".join(text))
    states = []
    trained = hpylm.trained

    def noted(*args):
        out = trained(*args)
        states.extend(x[2] for x in out[2])
        return out

    monkeypatch.setattr(hpylm, "trained", noted)
    monkeypatch.setattr(hpylm, "SWEEPS", 7)
    got = {r.doc_id: r for r in hpylm.score(docs_of(spark, list(enumerate(texts)))).collect()}
    split = {i: [*t.encode().split(), b""] for i, t in enumerate(texts)}
    want = plain_scores(split, [i for i in split if not got[i].held_out], states)
    gaps = [abs(got[i].score - want[i]) / len(split[i]) for i in split]
    assert {got[i].held_out for i in split} == {True, False}
    assert max(gaps) < 0.06 and np.mean(gaps) < 0.02, (max(gaps), np.mean(gaps))


def test_words_and_hashes():
    data = b"ab  abc\tab \x0b\xc3\xa9 a\nabc" + b" long" * 1000
    starts, hashes, classes = hpylm.words_of(np.frombuffer(data, np.uint8))
    words = data.split()
    assert [data[a : a + len(w)] for a, w in zip(starts.tolist(), words, strict=True)] == words
    known = dict(zip(words, zip(hashes.tolist(), classes.tolist(), strict=True), strict=True))
    assert [known[w] for w in words] == list(zip(hashes.tolist(), classes.tolist(), strict=True)) and len({h for h, _ in known.values()}) == len(set(words))
    assert len(hpylm.words_of(np.frombuffer(b"  ", np.uint8))[0]) == len(hpylm.words_of(np.zeros(0, np.uint8))[0]) == 0


@pytest.mark.parametrize(("c", "d"), [(100, 0.5), (120, 0.8), (128, 0.2)])
def test_the_saddle_point_meets_the_stirling_numbers(c, d):
    t = np.arange(2, c // 2)
    exact, near = hpylm.alone_table(d)[c, t], hpylm.alone_beyond(np.full(len(t), c), t, d)
    assert np.abs(exact - near).max() < 0.06


def test_reseating_keeps_the_distribution_of_tables():
    """One restaurant, one dish: the chain's share of states against the numbers of arrangements."""
    c, d, s, p = 6, 0.4, 1.3, 0.3
    ways = {1: {1: 1.0}}
    for n in range(2, c + 1):
        ways[n] = {t: ways[n - 1].get(t - 1, 0) + (n - 1 - d * t) * ways[n - 1].get(t, 0) for t in range(1, n + 1)}
    want = np.array([ways[c][t] * p**t * math.prod(s + d * i for i in range(t)) for t in range(1, c + 1)])
    seats = hpylm.Seats(np.full(20_000, c), np.full(20_000, 1), d, np.random.default_rng(2))
    for _ in range(30):
        seats.reseat(np.full(20_000, s), np.full(20_000, p))
    got = np.bincount(seats.t, minlength=c + 1)[1:] / 20_000
    assert np.abs(got - want / want.sum()).max() < 0.02


@pytest.mark.parametrize("c", [100, 200, 3000])
def test_a_sweep_reseats_every_customer(c):
    """Of customers who all sit alone, though hardly anyone opens a table, about half find company in one sweep."""
    seats = hpylm.Seats(np.full(500, c), np.full(500, c), 0.01, np.random.default_rng(3))
    seats.reseat(np.full(500, 1e-9), np.full(500, 1e-9))
    assert (seats.c == c).all() and 0.3 * c < seats.t.min() and seats.t.max() < 0.7 * c


@pytest.mark.parametrize(("c", "d", "s", "p"), [(127, 0.4, 1.3, 0.3), (200, 0.6, 50.0, 0.1), (1000, 0.4, 1.3, 0.3), (1000, 0.95, 2.0, 0.5), (1000, 0.6, 50.0, 0.1)])
def test_blocks_keep_the_distribution_of_tables(c, d, s, p):
    logs = np.full(c + 1, -np.inf)
    logs[1] = 0.0
    for n in range(2, c + 1):
        t = np.arange(1, n + 1)
        logs[1 : n + 1] = np.logaddexp(logs[:n], np.where(t < n, logs[1 : n + 1] + np.log(np.maximum(n - 1 - d * t, 1e-300)), -np.inf))
    t = np.arange(1, c + 1)
    ways = logs[1:] + t * math.log(p) + np.concatenate(([0], np.cumsum(np.log(s + d * np.arange(1, c)))))
    ways = np.exp(ways - ways.max())
    want = (t * ways).sum() / ways.sum()
    seats = hpylm.Seats(np.full(3000, c), np.full(3000, 1), d, np.random.default_rng(4))
    for _ in range(20):
        seats.reseat(np.full(3000, s), np.full(3000, p))
    assert abs(seats.t.mean() - want) < 0.05 * want, (seats.t.mean(), want)


def test_copies_are_told_apart(spark):
    draw = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 3000, 120)) for _ in range(60)]
    got = {r.doc_id: r for r in hpylm.score(docs_of(spark, list(enumerate(texts + texts[:6])))).collect()}
    twice = [got[i].perplexity for i in range(6) if not got[i].held_out and not got[60 + i].held_out]
    once = [got[i].perplexity for i in range(6, 60) if not got[i].held_out]
    assert twice and max(twice) < min(once)
