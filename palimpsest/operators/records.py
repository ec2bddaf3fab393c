"""Layouts of binary records, compiled to columns: fixed fields at an offset, counted arrays of records, and chains of
records whose length stands in them. Whatever lies beyond the end of the body is null, and ends a chain."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTHS = {"u8": 1, "u16": 2, "u32": 4, "u64": 8}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is taken from its row once: within a lambda a binary column would be copied, and an
    expression evaluated, for every use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(T.ArrayType(T.LongType()))
def numbers(data: pd.Series) -> pd.Series:
    """All unsigned numbers of four bytes in a row, the low byte first; what is left over at the end is no number."""
    return pd.Series([None if d is None else np.frombuffer(d, "<u4", len(d) // 4).astype(np.int64) for d in data], index=data.index, dtype=object)


def number(body: Column, at: Column, size: int) -> Column:
    """An unsigned number of ``size`` bytes (eight wrap to a signed long), the low byte first; null beyond the end."""
    digits = F.hex(F.substring(body, (at + 1).cast("int"), F.lit(size)))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    value = F.conv(swapped, 16, 10).cast("decimal(20,0)") if size == 8 else F.conv(swapped, 16, 10).cast("long")
    if size == 8:
        value = F.when(F.substring(swapped, 1, 1) >= "8", value - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(value).cast("long")
    return F.when((at >= 0) & (at + size <= F.octet_length(body)), value)


def piece(body: Column, at: Column, size: Column) -> Column:
    """Bytes from an offset on, as many as there are up to ``size``; null if the offset lies outside."""
    return F.when((at >= 0) & (at <= F.octet_length(body)) & (size >= 0), F.substring(body, (at + 1).cast("int"), F.least(size, F.lit((1 << 31) - 1)).cast("int")))


def c_string(body: Column, at: Column, most: int = 256) -> Column:
    """Characters up to a zero byte."""
    return F.regexp_extract(F.decode(piece(body, at, F.lit(most)), "ISO-8859-1"), r"^([^\x00]*)", 1)


class Layout:
    """Fields in order: (name, kind), kind being u8, u16, u32, u64, or a number of bytes; without a name they are
    skipped."""

    def __init__(self, *fields: tuple[str | None, str | int]):
        self.fields, at = [], 0
        for name, kind in fields:
            width = WIDTHS.get(kind, kind)
            if name:
                self.fields.append((name, kind, at))
            at += width
        self.size = at

    def at(self, body: Column, start: Column) -> Column:
        """A struct of the fields of the record that begins there."""
        read = lambda kind, at: number(body, start + at, WIDTHS[kind]) if kind in WIDTHS else piece(body, start + at, F.lit(kind))
        return F.struct(*[read(kind, at).alias(name) for name, kind, at in self.fields])

    def type(self, **more: str) -> str:
        return "struct<" + ",".join([f"{n}:{'bigint' if k in WIDTHS else 'binary'}" for n, k, _ in self.fields] + [f"{n}:{t}" for n, t in more.items()]) + ">"

    def array(self, body: Column, start: Column, count: Column, most: int) -> Column:
        """``count`` records one after the other, at most ``most``, as far as the body goes."""
        fit = F.floor((F.octet_length(body) - start) / self.size)
        n = F.greatest(F.least(F.coalesce(count, F.lit(0)), fit, F.lit(most)), F.lit(0)).cast("int")
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return once(F.struct(body.alias("body"), start.alias("start"), places.alias("places")), lambda v: once(v["body"], lambda b: F.transform(v["places"], lambda i: self.at(b, v["start"] + i * self.size))))

    def chain(self, body: Column, start: Column, length: Callable[[Column], Column], most: int, going: Callable[[Column], Column] = lambda r: F.lit(True), least: int = 1) -> Column:
        """Records of ``length(record)`` bytes each, with their offset at, until one is cut, is longer than nothing by less
        than a byte, or ``going`` says no; at most ``most``. No record is shorter than ``least``, so a body has only so
        many."""
        kind = self.type(at="bigint")
        state = f"struct<at:bigint,found:array<{kind}>>"

        def step(b: Column, s: Column) -> Column:
            r = self.at(b, s["at"])
            cut = (s["at"] + self.size > F.octet_length(b)) | ~F.coalesce(going(r), F.lit(False)) | ~F.coalesce(length(r) > 0, F.lit(False))
            own = F.struct(*[r[n].alias(n) for n, _, _ in self.fields], s["at"].alias("at")).cast(kind)
            new = F.struct((s["at"] + length(r)).alias("at"), F.concat(s["found"], F.array(own)).alias("found")).cast(state)
            ended = F.struct(F.lit(None).cast("bigint").alias("at"), s["found"].alias("found")).cast(state)
            return F.when(s["at"].isNull(), s).when(cut, ended).otherwise(new)

        first = F.struct(start.cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("found")).cast(state)
        steps = F.sequence(F.lit(0), F.least(F.lit(most - 1), F.floor(F.octet_length(body) / least)).cast("int"))
        return once(F.struct(body.alias("body"), first.alias("first"), steps.alias("steps")), lambda v: once(v["body"], lambda b: F.aggregate(v["steps"], v["first"], lambda s, _: step(b, s))["found"]))
