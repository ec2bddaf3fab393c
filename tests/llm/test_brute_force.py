"""Operators against plain versions of what they promise."""

import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SMALL, rows

from palimpsest.llm import decontamination, hpylm, license_rules, license_scan, mixing, queries, secrets, simhash, substring_dedup, toxicity

from .conftest import docs_of

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def small(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark", "pages", "embeddings")}


@pytest.fixture(scope="module")
def texts(small):
    return {r.doc_id: r.text for r in small["documents"].collect()}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def classes(prints, radius):
    """Connected components of all pairs, by index."""
    label = np.arange(len(prints))
    while True:
        new = np.array([label[np.bitwise_count(prints ^ p).sum(axis=1) <= radius].min() for p in prints])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def merged(edges, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)])


@pytest.mark.parametrize(("lanes", "radius", "n"), [(1, 4, 1), (1, 4, 63), (1, 4, 400), (4, 40, 200)])
def test_bit_sliced_forests(lanes, radius, n):
    draw = np.random.default_rng(n)
    prints = draw.integers(0, 1 << 63, (n // 3 + 1, lanes)).astype(np.uint64)[draw.integers(0, n // 3 + 1, n)]
    for p in prints:
        for b in draw.choice(64 * lanes, draw.integers(0, radius), replace=False).tolist():
            p[b // 64] ^= np.uint64(1 << b % 64)
    assert (merged(simhash.forest(prints, radius), n) == classes(prints, radius)).all()
    cuts = sorted({0, n // 3, n // 2, n})
    found = merged(simhash.forests(prints, np.array(cuts[:-1]), np.array(cuts[1:]), radius), n)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        assert (found[a:b] - a == classes(prints[a:b], radius)).all()


def test_fingerprints_and_components(small, texts):
    def plain(text):
        words = text.encode().translate(LOWER).split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = simhash.near_duplicates(small["documents"]).toPandas()
    assert all(int(f, 16) == plain(texts[i]) and len(f) == 16 for i, f in zip(got.doc_id, got.fingerprint, strict=True))
    order = np.argsort(got.doc_id.to_numpy())
    ids = got.doc_id.to_numpy()[order]
    label = classes(np.array([int(f, 16) for f in got.fingerprint], np.uint64)[order][:, None], 4)
    assert (ids[label] == got.component_id.to_numpy()[order]).all()


def test_hot_bucket_is_cut_and_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK", 16)
    made = spark.createDataFrame([(i, 1 << i % 60) for i in range(60)], "id long, fp0 long")
    edges = simhash.links(made, simhash.exact_tables(60, 4), 4).collect()
    assert len(set(merged([(e.u, e.v) for e in edges], 60))) == 1


def test_near_copies_leave_one(spark):
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    base = [" ".join(draw.choice(words, 300)) for _ in range(20)]
    near = [b.replace(b.split()[40], "changed", 1).replace(b.split()[200], "too", 1) for b in base]
    kept = {r.doc_id for r in simhash.one_of_each(docs_of(spark, list(enumerate(base + near)))).collect()}
    assert kept == set(range(20))


def test_license_base_counts(small, texts):
    got = license_scan.scan(small["documents"]).collect()
    for r in got:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].encode().translate(LOWER))
        places = [(i, label) for phrase, label in license_rules.BASE.items() for p in [phrase.encode().split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_and_suppression():
    assert sum(len(p) for _, _, kinds in license_rules.families() for p in kinds.values()) > 200
    found = lambda t: license_scan.scan_text(t)[5]
    assert found("SPDX-License-Identifier: Apache-2.0") == "apache-2.0"
    assert found("Licensed under CC BY-NC-SA 4.0") == "cc-by,cc-by-nc-sa"
    assert found("under the GNU Lesser General Public License, version 2.1") == "lgpl-2.1"
    assert found("the MIT license MIT License") == "mit"
    assert found("a permit for mittens") == ""


def test_substring_keeps_first_places(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    made = docs_of(spark, [(3, f"a b {shared} c"), (1, f"x {shared} y z"), (2, "short"), (4, shared + " " + shared)])
    got = {r.doc_id: r.kept for r in substring_dedup.dedup(made).collect()}
    assert got == {1: f"x {shared} y z", 2: "short", 3: "a b c", 4: ""}


def test_packing_round_trip():
    for n in (0, 1, 1000):
        a, b = np.sort(np.random.default_rng(n).integers(0, 1 << 40, n)).astype(np.uint64), np.arange(n, dtype="<u4")
        x, y = substring_dedup.columns_unpacked(substring_dedup.columns_packed(a, b), "<u8", "<u4")
        assert (x == a).all() and (y == b).all()
        assert (substring_dedup.unpacked(substring_dedup.packed(np.unique(a.astype(np.int64) % (1 << 30)))) == np.unique(a.astype(np.int64) % (1 << 30))).all()


def test_decontamination(small, texts):
    items = {r.item_id: r.text for r in small["benchmark"].collect()}
    want = {i for i, t in texts.items() if any(x in t for x in items.values())}
    assert {r.doc_id for r in decontamination.contaminated(small["documents"], small["benchmark"]).collect()} == want


def test_parameters_changed_but_consistent(spark):
    item = "A train leaves the city with 120 people and stops in the village where 30 people get off, then 120 people ride on to the coast."
    docs = docs_of(spark, [(1, item.replace("120", "77").replace("30", "12")), (2, item.replace("120", "77", 1).replace("30", "12")), (3, "nothing of the kind " * 20)])
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.exact) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {1: ([9], False)}


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])) + body


def test_secrets_base_and_structure(small, texts):
    key = der(0x30, der(2, b"\x00") + b"".join(der(2, bytes([k + 1]) * 20) for k in range(8)))
    jwt = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2lnbmF0dXJlMTIz"
    text = f"é key {base64.b64encode(key).decode()} hex {key.hex()} jwt {jwt} no {base64.b64encode(key[:-1]).decode()} password: hunter22 AKIA{'A' * 16}"
    base, every = secrets.find_spans(text)
    assert [k for k, _, _ in base] == ["hex", "assign", "access"]
    assert Counter(k for k, _, _ in every) == {"der": 2, "jwt": 1, "hex": 1, "assign": 1, "access": 1}
    assert "hunter22" not in secrets.redacted(text) and secrets.redacted("clean") == "clean"
    for r in secrets.scan(small["documents"]).collect():
        t = texts[r.doc_id]
        spans = [("assign", 0, m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        spans += [("access", 1, m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", 2, m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[2][0], s[1]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, _, (a, b) in spans).encode()).hexdigest()


def test_mix_comes_near_its_targets(spark):
    got = mixing.mix_report(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    per = got.groupby(["source_size", "target"]).agg(size=("size", "sum"), taken=("taken", "sum")).reset_index()
    assert (per["size"] == per.source_size).all() and (got.taken <= 3 * got["size"]).all()
    assert abs(per.taken.sum() / per.target.sum() - 1) < 0.05 and (abs(per.taken / per.target - 1) < 0.2).all()
    assert abs(per.target.sum() - per["size"].sum()) < 1


def test_toxicity_on_held_out_labels(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, known).join(known, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)
    rank, y = got.score.rank().to_numpy(), got.toxic.to_numpy()
    assert (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum()) > 0.88
    assert got[got.toxic == 1].predicted.mean() > 0.6 and got[got.toxic == 0].predicted.mean() < 0.06


def test_savings_are_plain_compressed_lengths():
    """The features of a text against lengths of its windows by compressors made for each window alone."""
    model = toxicity.Model(b" the ordinary words of a text and more of them idiot fool ", b" the ordinary words of a text and more of them ", [0.1, 1, 2, 3, 4, 5, 6])
    text = "What an IDIOT, you fool! The ordinary words of a text; idiot fool idiot and more"
    saved = []
    words = text.lower().replace(",", " ").replace("!", " ").replace(";", " ").encode().split()
    for at in range(0, len(words), toxicity.WINDOW):
        window = b" " + b" ".join(words[at : at + toxicity.WINDOW]) + b" "
        plain, toxic = (len(c.compress(window)) for c in model.compressors())
        saved.append(plain - toxic)
    n = len(saved)
    want = [sum(saved) / (n + 3), min(max(saved), 8) / 8, *(sum(s >= t for s in saved) / (n + 3) for t in (1, 3, 5)), float(sum(s >= 3 for s in saved) >= 2)]
    assert model.features(text, model.compressors()) == want and sum(saved) > 0
    assert math.isclose(model.score(want), 1 / (1 + math.exp(-(0.1 + sum(w * x for w, x in zip([1, 2, 3, 4, 5, 6], want, strict=True))))))


def test_language_model(small, texts):
    got = hpylm.score(small["documents"]).collect()
    split = {i: [*t.encode().translate(LOWER).split(), None] for i, t in texts.items()}
    counts = Counter(w for i, s in split.items() if zlib.crc32(str(i).encode()) % 10 for w in s)
    total, distinct = sum(counts.values()), len(counts)
    for r in got:
        s = split[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in s)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(w in counts for w in s), total)
        assert math.isclose(base, r.base_score, rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_seats_follow_the_restaurant():
    """With a base of one kind, the mean number of tables is that of a plain simulation."""
    draw = np.random.default_rng(1)
    got = hpylm.seated(np.full(4000, 30), np.full(4000, 1.0), 0.5, np.full(4000, 0.3), draw).mean()

    def plain():
        t = 1
        for k in range(1, 30):
            new = (1.0 + 0.5 * t) * 0.3
            t += draw.random() < new / (new + k - 0.5 * t)
        return t

    assert abs(got - np.mean([plain() for _ in range(4000)])) < 0.2


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    assert first.columns == docs.columns
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(x in t for t in got.text for x in items)
    assert got.groupby("doc_id").copy.max().max() <= 4 and not any(secrets.base_spans(t) for t in got.text)
    assert set(got.doc_id) <= {r.doc_id for r in first.collect()}
