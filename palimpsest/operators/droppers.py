"""Files that batch scripts write line by line: a line is a row, so that a script's length and the number of its files
don't matter, and what a line belongs to follows from two windows over the script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that open a block, that write a line to what stands in front, and that do so to what stands
#: behind; what an echo is.
OPENER = r'^>[ \t]*(?:"([^"]+)"[ \t]*|([^" \t>][^ \t]*)[ \t]+)\($'
FRONT = r'^>>?[ \t]*(?:"([^"]+)"[ \t]*|([^" \t>][^ \t]*)[ \t]+)((?i:echo)(?:[. ].*)?)$'
BACK = r'(?i)^@?(echo[. ].*?)\s*>>?\s*"?([^"<>|&\s]+)"?\s*$'
ECHO = r"(?i)^echo(\.| |$)"


def scripted(text: Column) -> Column:
    """Whether a text looks like a script that writes files: its first line of habit, or two redirections into quotes."""
    return text.rlike("(?i)@echo off") | (F.size(F.split(text, '>"')) > 2)


def said(line: Column) -> Column:
    """What an echo writes: nothing for ``echo.``; a caret stands for the character behind it, and a last one for nothing.
    Null for other lines."""
    rest = F.substring(line, F.lit(6), F.length(line))
    plain = F.when(F.contains(rest, F.lit("^")), F.regexp_replace(rest, r"(?s)\^(.?)", "$1")).otherwise(rest)
    return F.when((F.lower(F.substring(line, 1, 4)) == "echo") & line.rlike(ECHO), F.when(F.substring(line, 5, 1) == ".", "").otherwise(plain))


def dropped_files(scripts: DataFrame) -> DataFrame:
    """``scripts(key, text)`` to key, pos, name, body: the files in order of first mention, lines joined by CR LF.

    ``>"f" (`` opens a block, whose echoes go to f up to a line with nothing but ``)``; other lines in it are skipped,
    redirections too. Outside blocks ``>"f" echo x``, ``>>f echo x`` and ``echo x >> f`` write a line each. Files without
    a line, and null texts, give nothing. Keys are unique."""
    lines = scripts.select("key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.ltrim(F.rtrim("line", F.lit("\r")), F.lit(" \t"))).where("line <> ''")
    # what a pattern needs is looked for before it is: most lines have no redirection
    fits = lambda p: F.startswith("line", F.lit(">")) & F.col("line").rlike(p)
    target = lambda p: F.when(fits(p), F.concat(F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2)))
    # a block begins at the first opener behind a closing line, whatever stands between it and the next one: of closing
    # lines and openers, at one that follows no opener. Both windows go by the order of one sort
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    closes = F.col("line") == ")"
    turns = lines.withColumn("opener", target(OPENER)).withColumn("turn", F.when(closes | F.col("opener").isNotNull(), F.struct(closes.alias("closes"), "opener")))
    turns = turns.withColumn("turned", F.last("turn", ignorenulls=True).over(before))
    counts = closes | F.coalesce(F.col("turned.closes"), F.lit(True))
    placed = turns.withColumn("block", F.last(F.when(counts, F.col("turn")), ignorenulls=True).over(before)["opener"])
    inside, front, back = F.col("block").isNotNull(), fits(FRONT), F.contains("line", F.lit(">")) & F.col("line").rlike(BACK)
    name = F.when(inside, F.col("block")).when(front, target(FRONT)).when(back, F.regexp_extract("line", BACK, 2)).otherwise(F.col("opener"))
    text = F.when(inside, said(F.col("line"))).when(front, said(F.regexp_extract("line", FRONT, 3))).when(back, said(F.regexp_extract("line", BACK, 1)))
    written = placed.where("line <> ')'").select("key", "at", name.alias("name"), text.alias("said"))
    files = written.where("name IS NOT NULL").groupBy("key", "name").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("at", "said")))).alias("lines"))
    ordered = F.row_number().over(Window.partitionBy("key").orderBy("first")) - 1
    return files.where(F.size("lines") > 0).select("key", ordered.alias("pos"), "name", F.array_join(F.transform("lines", lambda x: x["said"]), "\r\n").alias("body"))
