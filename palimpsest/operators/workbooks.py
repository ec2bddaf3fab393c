"""Records of workbook streams: hidden macro sheets, and names that start macros."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.records import number, piece

#: Records of a sheet and of a name, those looked at in a stream, and the states of a sheet.
SHEET, NAME, RECORDS, STATES = 0x85, 0x18, 1 << 18, {1: "hidden", 2: "veryHidden"}
#: Bytes kept of a record: more than a sheet's longest name takes.
KEPT = 1024


def told(body: bytes) -> list[dict]:
    """Sheets and names among a stream's records; a record that is cut ends them."""
    found, at = [], 0
    for _ in range(RECORDS):
        if at + 4 > len(body):
            break
        kind, size = struct.unpack_from("<HH", body, at)
        if at + 4 + size > len(body):
            break
        if kind in (SHEET, NAME):
            found.append({"type": kind, "body": body[at + 4 : at + 4 + min(size, KEPT)]})
        at += 4 + size
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.IntegerType()), T.StructField("body", T.BinaryType())])))
def sheets_and_names(bodies: pd.Series) -> pd.Series:
    return bodies.map(told, na_action="ignore")


def macro_markers(streams: DataFrame) -> DataFrame:
    """``streams(key, path, body)``: key, marker of the macro sheets that aren't shown and of built-in names that run when
    a workbook is opened or closed, each once. Both streams of a workbook with two are read."""
    books = streams.where(F.regexp_extract("path", r"([^/!]+)$", 1).isin("Workbook", "Book")).select("key", F.explode(sheets_and_names("body")).alias("r")).select("key", "r.type", "r.body")
    b = F.col("body")
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[(number(b, F.lit(4), 1) % 4).cast("int")]
    count = number(b, F.lit(6), 1)
    title = F.when(number(b, F.lit(7), 1) % 2 == 1, F.decode(piece(b, F.lit(8), count * 2), "UTF-16LE")).otherwise(F.decode(piece(b, F.lit(8), count), "ISO-8859-1"))
    hidden = F.when((F.col("type") == SHEET) & (number(b, F.lit(5), 1) == 1) & state.isNotNull(), F.concat(F.lit("XLM-HIDDEN-MACROSHEET "), state, F.lit(" "), F.coalesce(title, F.lit(""))))
    builtin = (F.col("type") == NAME) & (F.floor(number(b, F.lit(0), 2) / 32) % 2 == 1) & (number(b, F.lit(3), 1) == 1)
    starts = F.when(builtin & (number(b, F.lit(14), 1) == 1), "XLM-AUTO-OPEN").when(builtin & (number(b, F.lit(14), 1) == 2), "XLM-AUTO-CLOSE")
    return books.select("key", F.coalesce(hidden, starts).alias("marker")).where("marker IS NOT NULL").distinct()
