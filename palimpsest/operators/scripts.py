"""Encoded scripts: blocks whose characters are substituted by one of three tables, which one going by the place of the
character among the ASCII ones, with escapes for characters that would end a line or a tag."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.files import latin1

#: Beginning and end of a block; characters between the beginning and the body.
START, END, HEADER = "#@~^", "^#~@", 8
#: Bytes that are substituted at once.
STRETCH = 1 << 20
#: Which table serves each of 64 places in turn.
SCHEDULE = (0, 1, 2, 0, 1, 2, 1, 2, 2, 1, 2, 1, 0, 2, 1, 2, 0, 2, 1, 2, 0, 0, 1, 2, 2, 1, 0, 2, 1, 2, 2, 1, 0, 0, 2, 1, 2, 1, 2, 0, 2, 0, 0, 1, 2, 0, 2, 1, 0, 2, 1, 2, 0, 0, 1, 2, 2, 0, 0, 1, 2, 0, 2, 1)
#: Escapes behind an at sign; others stand for nothing.
ESCAPES = {b"@&": b"\n", b"@#": b"\r", b"@*": b">", b"@!": b"<", b"@$": b"@"}
#: Characters that are substituted: a tab and the printable ones but these.
PLAIN = b"<>@"

Tables = tuple[bytes, bytes, bytes]


def lookup(tables: Tables) -> np.ndarray:
    """The tables, 128 bytes each, with characters that stand for themselves put in."""
    found = np.array([np.frombuffer(t, np.uint8) for t in tables])
    own = np.array([c != 9 and (c < 32 or c in PLAIN) for c in range(128)])
    found[:, own] = np.arange(128, dtype=np.uint8)[own]
    return found


def decoded(block: bytes, known: np.ndarray) -> bytes:
    """Stretches between escapes are substituted at once, long ones in pieces; the place goes on from one to the next."""
    place, out, schedule = 0, [], np.array(SCHEDULE)
    for i, part in enumerate(re.split(rb"(?s)(@.)", block)):
        if i % 2:
            out.append(ESCAPES.get(part, b""))
            continue
        for k in range(0, len(part), STRETCH):
            data = np.frombuffer(part[k : k + STRETCH], np.uint8)
            ascii_ = data < 128
            at = place + np.cumsum(ascii_) - 1
            place += int(ascii_.sum())
            out.append(np.where(ascii_, known[schedule[at % 64], np.minimum(data, 127)], data).astype(np.uint8).tobytes())
    return b"".join(out)


def encoded_scripts(body: Column, tables: Tables) -> Column:
    """Clear texts of the blocks in a body, in order; blocks that don't end are left out. Null gives null.

    ``tables`` are those of the encoding, three of 128 bytes from an encoded character to the clear one."""
    if [len(t) for t in tables] != [128] * 3:
        raise ValueError("three tables of 128 bytes are needed")

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def clear(blocks: pd.Series) -> pd.Series:
        known = lookup(tables)
        return pd.Series([None if b is None else [decoded(x, known) for x in b] for b in blocks], index=blocks.index, dtype=object)

    parts = F.filter(F.transform(F.slice(F.split(latin1(body), re.escape(START)), 2, 1 << 30), lambda p: F.substring(p, F.lit(HEADER + 1), F.length(p))), lambda p: F.contains(p, F.lit(END)))
    blocks = F.transform(parts, lambda p: F.encode(F.substring_index(p, END, 1), "ISO-8859-1"))
    return F.filter(clear(F.when(F.contains(latin1(body), F.lit(START)), blocks).otherwise(F.when(body.isNotNull(), F.array().cast("array<binary>")))), lambda b: F.octet_length(b) > 0)
