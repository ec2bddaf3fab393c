"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary labelled text, and one on the toxic passages, the
stretches of toxic documents made of runs of ``GRAM`` bytes that stand in significantly more places there than in
ordinary ones (a place being a run with ``AROUND`` bytes on each side, so that copies of a passage count once). A
document's words are cut into windows; each is compressed with the ordinary dictionary, and with the toxic one behind
it, and the bytes saved are the window's distance. A logistic curve fitted on labelled documents that trained neither
dictionary turns mean, largest and frequent savings into a probability.

Labels are read only for rows whose crc32(doc_id as text) mod 4 is not 2, and of these at most ``MOST_TOXIC`` and
``MOST_ORDINARY`` documents, chosen by hash, of each kind as many as fit into ``MOST_BYTES`` of text. Nothing but the
text enters a score.

Null texts are empty; empty texts have no savings and get the curve's value there. Without labels of both classes
every score is the share of toxic labels. A null doc_id counts as not held out. Repeated rows repeat.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_TOXIC, MOST_ORDINARY, MOST_BYTES, FOLDS, HELD_OUT = 2000, 4000, 8 << 20, 4, 2
#: Words in a window; bytes of the dictionaries; windows that the ordinary one is trained on.
WINDOW, ORDINARY, TOXIC, WINDOWS, THRESHOLD = 8, 65536, 4096, 60_000, 0.3
FEATURES = 6
#: Parts of the sample for the curve.
PARTS = 3
#: Bytes of a run and on each side of it; standard errors, times and places that make it toxic.
GRAM, AROUND, SIGNIFICANT, RATIO, PLACES = 6, 8, 6.0, 8, 4
MIXERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
SEPARATORS = bytes.maketrans(bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)), b" " * 15 + b" " * 7 + b" " * 6 + b" " * 5)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(SEPARATORS).split()


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


@dataclass
class Model:
    """The two dictionaries and the curve; picklable."""

    toxic: bytes
    ordinary: bytes
    curve: list[float]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        log = max(10, (len(self.toxic) + 4096).bit_length())
        plain = zstandard.ZstdCompressionParameters(
            window_log=log, chain_log=log, hash_log=log, search_log=6, min_match=6, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        made = []
        for content in (self.ordinary, self.toxic):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=plain)
            made.append(zstandard.ZstdCompressor(compression_params=plain, dict_data=known))
        return made

    def features(self, text: str, compressors: list[zstandard.ZstdCompressor]) -> list[float]:
        """Mean, largest, and shares of savings of at least 1, 3 and 5 bytes."""
        plain, toxic = (c.compress for c in compressors)
        saved = [len(plain(window)) - len(toxic(window)) for window in windows(words_of(text))]
        if not saved:
            return [0.0] * FEATURES
        n = len(saved)
        return [sum(saved) / (n + 3), min(max(saved), 8) / 8, *(sum(s >= t for s in saved) / (n + 3) for t in (1, 3, 5)), float(sum(s >= 3 for s in saved) >= 2)]

    def score(self, features: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], features, strict=True))))))


def padded(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def windows(words: list[bytes]) -> list[bytes]:
    return [padded(words[at : at + WINDOW]) for at in range(0, len(words), WINDOW)]


def grams(text: bytes, size: int = GRAM) -> np.ndarray:
    """Each run of ``size`` bytes as a number: exact up to eight bytes, a hash beyond."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(data) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size if n else 0):
        out = out * np.uint64(256 if size <= 8 else 0x9E3779B97F4A7C15) + data[j : j + n]
    return out


def places(docs: list[list[bytes]], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The runs of these documents (those ``among`` some, if given), in order, in how many places each stands, and how
    many places there are (by a sixteenth of them, chosen by hash)."""
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64),) * 2]
    chosen: list[np.ndarray] = [np.zeros(0, np.uint64)]
    for words in docs:
        text = b" " * AROUND + padded(words) + b" " * AROUND
        around, runs = grams(text, GRAM + 2 * AROUND), grams(text[AROUND : len(text) - AROUND])
        chosen.append(around[around >> np.uint64(60) == 0])
        some = slice(None) if among is None else among[np.minimum(np.searchsorted(among, runs), len(among) - 1)] == runs
        held.append((around[some], runs[some]))
    around = np.concatenate([a for a, _ in held])
    runs = np.concatenate([r for _, r in held])
    held.clear()
    order = np.argsort(around)
    around = around[order]
    first = order[np.concatenate(([True], around[1:] != around[:-1]))[: len(order)]]
    del around, order
    return *np.unique(runs[first], return_counts=True), 16 * len(np.unique(np.concatenate(chosen))) + 1


def toxic_runs(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> np.ndarray:
    """Runs whose shares of all places differ by ``SIGNIFICANT`` standard errors and ``RATIO`` times, in order."""
    runs, a, n = places(toxic)
    runs, a = runs[a >= PLACES], a[a >= PLACES]
    if not len(runs) or not ordinary:
        return runs[:0]
    known, there, m = places(ordinary, runs)
    b = np.zeros(len(runs), np.int64)
    b[np.searchsorted(runs, known)] = there
    p = (a + b) / (n + m)
    z = (a / n - b / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
    return runs[(z >= SIGNIFICANT) & (a / n >= RATIO * b / m)]


def passages(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The stretches of a document that toxic runs cover."""
    text = padded(words)
    own = grams(text)
    if not len(runs) or not len(own):
        return []
    hit = np.concatenate(([False], runs[np.minimum(np.searchsorted(runs, own), len(runs) - 1)] == own, [False]))
    starts, ends = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
    return [text[x : y - 1 + GRAM] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]


def without_copies(docs: list[list[bytes]]) -> list[int]:
    """Positions of documents that share none of four minima of hashed word triples with an earlier one."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, words in enumerate(docs):
        hashes = np.array([zlib.crc32(b" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))], np.uint64)
        marks = {(k, int((hashes * np.uint64(odd) & np.uint64(0xFFFFFFFF)).min())) for k, odd in enumerate(MIXERS)}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def trained_dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content that zstandard's trainer picks (without the entropy tables); all of it where there is too little."""
    try:
        return zstandard.train_dictionary(size + 200, samples, k=segment, d=GRAM).as_bytes()[200:].lstrip(b"\0")
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w * (np.arange(len(w)) > 0))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(texts: list[str], toxic: list[int], odds: float | None = None) -> Model:
    """Each part of the documents gets its features from dictionaries that the other parts train; all of these make
    the curve. Then the dictionaries see all.

    Near copies within the sample are left out first. ``odds`` of toxic labels among all labelled rows, where
    given, replace those of the sample, in which toxic documents are more frequent.
    """
    unlike = without_copies([words_of(t) for t in texts])
    texts, toxic = [texts[i] for i in unlike], [toxic[i] for i in unlike]
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1e-6) / (len(y) + 1)
        return Model(b" ", b" ", [math.log(share / (1 - share))] + [0.0] * FEATURES)
    split = [words_of(t) for t in texts]

    def dictionaries(chosen: list[int]) -> tuple[bytes, bytes]:
        ordinary = [split[i] for i in chosen if not y[i]]
        bad = [split[i] for i in chosen if y[i]]
        count = sum(-(-len(words) // WINDOW) for words in ordinary)
        samples = list(islice((w for words in ordinary for w in windows(words)), 0, None, -(-count // WINDOWS) or 1))
        base = trained_dictionary(samples, ORDINARY, 24) or b" "
        del samples
        runs = toxic_runs(bad, ordinary)
        return base + trained_dictionary([x for words in bad for x in passages(words, runs)], TOXIC, 16), base

    found = np.zeros((len(y), FEATURES))
    for k in range(PARTS):
        model = Model(*dictionaries([i for i in range(len(y)) if i % PARTS != k]), [])
        made = model.compressors()
        for i in range(k, len(y), PARTS):
            found[i] = model.features(texts[i], made)
    curve = logistic(found, y)
    if odds:
        curve[0] += math.log(odds) - math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return Model(*dictionaries(list(range(len(y)))), curve)


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int], float]:
    """Texts and labels of the sample, and the odds of a toxic label among all that may be read."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("ordinary")).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).union(known.where("toxic = 0").orderBy(*order).limit(MOST_ORDINARY))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(*order))  # over 4000 rows at most
    got = rows.withColumn("upto", upto).where(F.col("upto") <= MOST_BYTES).orderBy(*order).select("text", "toxic").toArrow()
    return got["text"].to_pylist(), got["toxic"].to_pylist(), (counts["toxic"] + 0.5) / (counts["ordinary"] + 0.5)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs`` (but one named toxicity_score) and toxicity_score."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, labels)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        made = model.compressors()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = [model.score(model.features(t.as_py() or "", made)) for t in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "toxicity_score"])

    docs = docs.drop("toxicity_score")
    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), labels)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).where(F.col("toxicity_score") < THRESHOLD).drop("toxicity_score")
