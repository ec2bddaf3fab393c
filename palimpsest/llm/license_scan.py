"""License scans by ordered signature rules.

A text becomes its words (letters A-Z lowered, runs of ASCII letters, digits and all non-ASCII characters), joined
by single spaces. A label's rules run only if one of its gate words is there. Every match is an interval of words
with a priority: kinds in order (identifiers, notices, names, addresses, bare phrases), then the order of the
rules. Going down the priorities, a match is suppressed if an interval kept before contains it. Labels are those of
the kept matches and of the base phrases; score is the confidence of the surest kept match, lifted a little by
others that agree.

Null texts are empty. Rows are independent: repeated rows repeat, a null doc_id stays null, other columns are not
read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.license_rules import BASE, CONFIDENCE, KINDS, families

#: Lower-cases A-Z and blanks all ASCII but letters and digits.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
Found = tuple[int, int, str, str]


@cache
def compiled() -> tuple[dict[bytes, list[int]], list[list[tuple[int, int, str, str, re.Pattern]]]]:
    """Families by gate word; of each family its rules as (kind's rank, order, label, kind, pattern)."""
    gates: dict[bytes, list[int]] = {}
    rules = []
    for i, (label, words, kinds) in enumerate(families()):
        for word in words:
            gates.setdefault(word.encode(), []).append(i)
        rules.append([(KINDS.index(kind), i, label, kind, re.compile(rb"(?<= )(?:" + p.encode() + rb")(?= )")) for kind, patterns in kinds.items() for p in patterns])
    return gates, rules


def word_starts(padded: bytes) -> list[int]:
    """Where the blank before each word stands, and the last blank."""
    return np.flatnonzero(np.frombuffer(padded, np.uint8) == 32).tolist()


class Kept:
    """Intervals taken so far; whether one of them contains another, by largest ends over starts (a Fenwick tree)."""

    def __init__(self, n: int):
        self.ends = [-1] * (n + 2)

    def contain(self, start: int, end: int) -> bool:
        i = start + 1
        while i > 0:
            if self.ends[i] >= end:
                return True
            i -= i & -i
        return False

    def take(self, start: int, end: int) -> None:
        i = start + 1
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i


def base_places(padded: bytes, starts: list[int]) -> list[Found]:
    found = []
    for phrase, label in BASE.items():
        wanted = f" {phrase} ".encode()
        at = padded.find(wanted)
        while at >= 0:
            start = bisect_left(starts, at)
            found.append((start, start + phrase.count(" ") + 1, label, "base"))
            at = padded.find(wanted, at + 1)
    return found


def detections(padded: bytes, starts: list[int], words: set[bytes], base: list[Found]) -> list[Found]:
    """Kept matches (start, end, label, kind), in words."""
    gates, rules = compiled()
    found = [(len(KINDS), i, *f) for i, f in enumerate(base)]
    for family in sorted({i for word in words & gates.keys() for i in gates[word]}):
        for rank, order, label, kind, pattern in rules[family]:
            for m in pattern.finditer(padded):
                start = bisect_left(starts, m.start() - 1)
                found.append((rank, order, start, start + m[0].count(b" ") + 1, label, kind))
    found.sort(key=lambda f: (f[0], f[2] - f[3], f[1], f[2]))
    kept: list[Found] = []
    taken = Kept(len(starts)) if found else None
    for _, _, start, end, label, kind in found:
        if not taken.contain(start, end):
            taken.take(start, end)
            kept.append((start, end, label, kind))
    return sorted(kept)


def scan_text(text: str) -> tuple[int, int, int | None, int | None, str, str, float, str]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    split = text.encode().translate(NORMAL).split()
    padded = b" " + b" ".join(split) + b" "
    places = word_starts(padded)
    base = base_places(padded, places)
    kept = detections(padded, places, set(split), base)
    starts = [f[0] for f in base]
    base_labels = {f[2] for f in base}
    sure = sorted((CONFIDENCE[kind] for _, _, _, kind in kept), reverse=True)
    score = min(1.0, sure[0] + 0.02 * min(len(sure) - 1, 2)) if sure else 0.0
    return (
        len(split),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {f[2] for f in kept})),
        score,
        ",".join(f"{label}:{a}:{b}" for a, b, label, _ in kept),
    )


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:start:end in words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(scan_text(t.as_py() or "") for t in batch.column(1)), strict=True)) or [()] * len(NAMES)
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, TYPES, strict=True))], ["doc_id", *NAMES])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
