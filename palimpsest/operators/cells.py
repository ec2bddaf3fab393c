"""Cells of macro sheets: cells(doc, sheet, pos, coord, formula, value), pos being their order in the sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = r"\$?[A-Z]{1,3}\$?[0-9]{1,7}"
#: Fixed value: a formula that gives another cell its value.
SETS = r"(?is)^=?SET\.VALUE\(\s*(\$?[A-Z]{1,3}\$?[0-9]{1,7})\s*,\s*(.*?)\s*\)$"


def normal(coord: Column) -> Column:
    """A1 style without dollar signs."""
    return F.replace(F.upper(coord), F.lit("$"), F.lit(""))


def letters(column: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA; up to three letters."""
    digit = lambda n: F.char(F.lit(65) + F.pmod(n, F.lit(26)))
    n = column - 1
    two, three = F.floor(n / 26) - 1, F.floor((n / 26 - 1) / 26) - 1
    return F.concat(F.when(column > 702, digit(three)).otherwise(""), F.when(column > 26, digit(two)).otherwise(""), digit(n))


def from_r1c1(coord: Column) -> Column:
    """``R3C27`` as ``AA3``; null for anything else."""
    part = lambda i: F.regexp_extract(coord, r"(?i)^R(\d{1,7})C(\d{1,5})$", i)
    return F.when(part(1) != "", F.concat(letters(part(2).cast("int")), part(1)))


def below(coord: Column) -> Column:
    """The cell in the next row."""
    return F.concat(F.regexp_extract(coord, r"^([A-Z]+)", 1), (F.regexp_extract(coord, r"(\d+)$", 1).cast("int") + 1).cast("string"))


def substituted(cells: DataFrame) -> DataFrame:
    """doc, sheet, coord, formula, text: formulas in which each reference to a cell with a value, one hop away, is that
    value as a literal. Of the values of one name the first that isn't empty counts, but the last that a formula sets
    goes before it. An equi-join by (doc, sheet, coord)."""
    stated = cells.where("value <> ''").select("doc", "sheet", "pos", normal(F.col("coord")).alias("name"), F.col("value").alias("first"), F.lit(None).cast("string").alias("put"))
    wanted = F.regexp_replace(F.regexp_extract("formula", SETS, 2), r'(?s)^"(.*)"$', "$1")
    setting = cells.where(F.col("formula").rlike(SETS)).select("doc", "sheet", "pos", normal(F.regexp_extract("formula", SETS, 1)).alias("name"), F.lit(None).cast("string").alias("first"), wanted.alias("put"))
    ordered = lambda pick, c: pick(c, F.when(F.col(c).isNotNull(), F.struct("pos", c)))
    values = stated.unionByName(setting).groupBy("doc", "sheet", "name").agg(F.coalesce(ordered(F.max_by, "put"), ordered(F.min_by, "first")).alias("known"))
    formulas = cells.where("formula IS NOT NULL").select("doc", "sheet", "coord", "formula")
    bare = F.regexp_replace("formula", r'"[^"]*"', "")
    wanted = formulas.select("doc", "sheet", "coord", "formula", F.explode_outer(F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"(?<![A-Za-z.]){REFERENCE}(?![A-Za-z0-9(])"), 0))).alias("ref"))
    found = wanted.withColumn("name", normal(F.col("ref"))).join(values, ["doc", "sheet", "name"], "left")
    known = found.groupBy("doc", "sheet", "coord", "formula").agg(F.map_from_entries(F.collect_set(F.when(F.col("known").isNotNull(), F.struct("ref", "known")))).alias("known"))
    pieces = F.split(F.regexp_replace("formula", rf'("[^"]*"|(?<![A-Za-z.]){REFERENCE}(?![A-Za-z0-9(]))', "\x01$1\x01"), "\x01")
    put = lambda p: F.coalesce(F.concat(F.lit('"'), F.try_element_at("known", p), F.lit('"')), p)
    return known.select("doc", "sheet", "coord", "formula", F.array_join(F.transform(pieces, put), "").alias("text"))
