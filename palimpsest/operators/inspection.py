"""From raw bodies to channelled streams: containers are opened layer by layer, and the passes follow over all that came
out, in the order raw body, members, script and cell markers, decoded blobs, carved executables, structure of
executables, combined markers.

The frontier is a table. Each round routes its bodies by kind to the operators of
:mod:`palimpsest.operators.members`, drops what the document has shown before (an anti-join on digests), charges the
document's budget with what is new, in order, and keeps the result as the next frontier. So no document is one task's
recursion, and a round lost with an executor is run again from the table before it.

``files(doc, body)``: a null body is a document without streams. Rows of equal doc are one document. Kinds of streams:
``raw``, the container's kind for members, and the pass's name for the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import encodings, files, markers
from palimpsest.functions.files import latin1
from palimpsest.operators import decode, droppers, executables, members, streams, structure, workbooks
from palimpsest.operators.tables import kept

#: What one document may unfold to.
DEPTH, MOST_MEMBERS, TOTAL_BYTES = 6, 4096, 128 << 20
#: Passes in their order; what makes streams of the text has a number of its own within its pass.
MEMBER, TEXT, DECODED, CARVED, BINARY, COMBINED = range(0, 600, 100)


def unfolded(bodies: DataFrame, depth: int = DEPTH, most: int = MOST_MEMBERS, total: int = TOTAL_BYTES) -> DataFrame:
    """doc, at (an array: the places on the way, so that its order is that of opening each before the next), kind, path,
    layer, body: the raw body at layer 0, and members below it."""
    first = bodies.where("body IS NOT NULL").select("doc", F.row_number().over(Window.partitionBy("doc").orderBy(F.sha2("body", 256))).alias("n"), "body")
    frontier = kept(first.select("doc", F.array(F.col("n")).alias("at"), F.lit("raw").alias("kind"), F.lit("").alias("path"), F.lit(0).alias("layer"), "body", F.sha2("body", 256).alias("digest")), "frontier")
    found = frontier
    spent = None
    for layer in range(1, depth + 1):
        routed = frontier.withColumn("is", files.kind(F.col("body"))).where(F.col("is").isin(*members.OPENERS))
        routed = kept(routed.withColumn("file", F.sha2(F.concat_ws("/", F.col("doc").cast("string"), F.col("at").cast("string")), 256)), "routed")
        kinds = sorted(r["is"] for r in routed.select("is").distinct().collect())  # there are as many kinds as openers
        if not kinds:
            break
        opened = reduce(DataFrame.unionByName, [members.opened(routed.where(F.col("is") == k).select("file", "body"), k).withColumn("kind", F.lit(k)) for k in kinds])
        above = routed.select("file", "doc", F.col("at").alias("above"), F.col("path").alias("outer"))
        new = opened.join(above, "file").select("doc", F.concat("above", F.array(F.col("pos"))).alias("at"), "kind", F.concat(F.when(F.col("outer") == "", "").otherwise(F.concat("outer", F.lit("!"))), "name").alias("path"), F.lit(layer).alias("layer"), "body", F.sha2("body", 256).alias("digest"))
        new = kept(new, "opened")
        own = new.groupBy("doc", "digest").agg(F.min("at").alias("at"))
        own = own.join(found.select("doc", "digest"), ["doc", "digest"], "left_anti")
        sized = new.join(own, ["doc", "digest", "at"], "left_semi").select("doc", "at", F.octet_length("body").cast("long").alias("size"))
        ordered = Window.partitionBy("doc").orderBy("at")
        charged = sized.select("doc", "at", F.row_number().over(ordered).alias("n"), F.sum("size").over(ordered).alias("bytes"))
        if spent is not None:
            charged = charged.join(spent, "doc", "left").select("doc", "at", (F.col("n") + F.coalesce("members_before", F.lit(0))).alias("n"), (F.col("bytes") + F.coalesce("bytes_before", F.lit(0))).alias("bytes"))
        fits = kept(charged.where((F.col("n") <= most) & (F.col("bytes") <= total)), "charged")
        frontier = kept(new.join(fits.select("doc", "at"), ["doc", "at"], "left_semi").select(found.columns), "frontier")
        now = fits.groupBy("doc").agg(F.max("n").alias("members_before"), F.max("bytes").alias("bytes_before"))
        spent = kept(now if spent is None else now.unionByName(spent).groupBy("doc").agg(F.max("members_before").alias("members_before"), F.max("bytes_before").alias("bytes_before")), "spent")
        found = found.unionByName(frontier)
    return found.drop("digest")


def office_parts(found: DataFrame) -> DataFrame:
    """doc, at of members that are parts of an Office archive's format: they are read for markers, but are no streams
    unless they carry something themselves."""
    zips = found.where("kind = 'zip'").withColumn("archive", F.slice("at", F.lit(1), F.size("at") - 1))
    own = F.regexp_extract("path", r"([^!]*)$", 1).rlike(structure.PARTS)
    office = zips.where(own).select("doc", "archive").distinct()
    inner = zips.where(files.kind(F.col("body")) == "none").where(~F.startswith(F.regexp_extract("path", r"([^!]*)$", 1), F.lit("#")))
    return inner.join(office, ["doc", "archive"], "left_semi").select("doc", "at")


def rows_from(found: DataFrame, array: Column, number: int, kind: str) -> DataFrame:
    """A stream for each item of an array of strings, which hold one byte a character."""
    return found.select("doc", "at", F.posexplode_outer(array).alias("pos", "x")).where("pos IS NOT NULL").select("doc", F.lit(number).alias("pass"), F.concat("at", F.array(F.col("pos"))).alias("at"), F.lit(kind).alias("kind"), F.lit("").alias("path"), F.encode("x", "ISO-8859-1").alias("body"))


def marker_rows(found: DataFrame, number: int, kind: str) -> DataFrame:
    """``found(doc, marker)`` as streams, in the order of the marker."""
    ordered = Window.partitionBy("doc").orderBy("marker")
    return found.select("doc", F.lit(number).alias("pass"), F.array(F.row_number().over(ordered)).alias("at"), F.lit(kind).alias("kind"), F.lit("").alias("path"), F.encode("marker", "ISO-8859-1").alias("body"))


def inspected(bodies: DataFrame, now: Column, depth: int = DEPTH) -> DataFrame:
    """doc, pos, kind, path, channel, body: all streams of each document in the order of the passes, equal ones once."""
    every = kept(unfolded(bodies, depth), "unfolded")
    parts = office_parts(every)
    shown = every.join(parts, ["doc", "at"], "left_anti")
    out = [shown.select("doc", F.lit(MEMBER).alias("pass"), "at", "kind", "path", "body")]

    kinds = every.where("layer = 0").withColumn("is", files.kind(F.col("body")))
    text = latin1(F.col("body"))
    plain = kinds.where("is = 'none'")
    out += [rows_from(plain, markers.csv_injections(text), TEXT, "cells"), rows_from(plain, markers.html_smuggling(text), TEXT + 1, "page")]
    scripts = plain.where(droppers.scripted(text)).select(F.struct("doc", "at").alias("key"), text.alias("text"))
    out.append(droppers.dropped_files(scripts).select("key.doc", F.lit(TEXT + 2).alias("pass"), F.concat("key.at", F.array("pos")).alias("at"), F.lit("script").alias("kind"), F.lit("").alias("path"), F.encode("body", "ISO-8859-1").alias("body")))
    for i, (name, test) in enumerate((("sylk", markers.sylk_injections), ("spreadsheet_xml", markers.spreadsheet_xml_injections), ("pdf", markers.pdf_indicators), ("rtf", markers.rtf_markers)), 3):
        out.append(rows_from(kinds.where(F.col("is") == name), test(text), TEXT + i, name))
    out.append(rows_from(kinds, markers.binary_markers(F.col("body")), TEXT + 7, "binary"))
    tree = every.where("layer > 0").select(F.col("doc").alias("key"), F.row_number().over(Window.partitionBy("doc").orderBy("at")).alias("pos"), "path", "kind", "layer", "body")
    for number, found in enumerate((structure.office_markers(tree), structure.compound_markers(tree), workbooks.macro_markers(tree.where("kind = 'ole2'")), structure.property_texts(tree).withColumnRenamed("stream", "marker"))):
        out.append(marker_rows(found.withColumnRenamed("key", "doc"), TEXT + 8 + number, "structure"))
    before = kept(reduce(DataFrame.unionByName, out), "streams")

    content = before.where(streams.markers.channel(text) == "content").withColumn("source", F.struct("doc", F.col("pass").alias("before"), "at"))
    hidden = decode.layered(content.where(encodings.mostly_text(text)).select("source", text.alias("text")), "source", F.col("text"))
    decoded = kept(hidden.select("source.doc", F.lit(DECODED).alias("pass"), F.concat(F.array(F.col("source.before")), F.col("source.at"), F.array(F.col("pos"))).alias("at"), F.lit("decoded").alias("kind"), F.col("decoder").alias("path"), F.col("blob").alias("body")), "decoded")
    deep = decode.depth_markers(hidden.select(F.col("source.doc").alias("doc"), "layer"), "doc")
    carved = structure.carved_executables(decoded.select(F.struct("doc", "at").alias("key"), F.lit(0).alias("pos"), "body"))
    carved = carved.select("key.doc", F.lit(CARVED).alias("pass"), "key.at", F.lit("carved").alias("kind"), F.lit("").alias("path"), "body")
    after = before.unionByName(decoded).unionByName(carved).unionByName(marker_rows(deep, DECODED + 1, "depth"))
    binary = executables.binary_markers(after.where(F.col("kind") != "structure").select(F.col("doc").alias("key"), "body"), now)
    after = kept(after.unionByName(marker_rows(binary.withColumnRenamed("key", "doc"), BINARY, "structure")), "passes")

    said = after.where(F.octet_length("body") < 4096).select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("pass", "at")).alias("pos"), text.alias("marker"))
    combined = streams.sheet_stack(said).unionByName(streams.behaviour_scores(said)).withColumnRenamed("stream", "marker")
    after = after.unionByName(marker_rows(combined, COMBINED, "combined"))
    first = after.groupBy("doc", streams.stream_key(F.col("body")).alias("key")).agg(F.min(F.struct("pass", "at")).alias("x")).select("doc", "x.pass", "x.at")
    only = after.join(first, ["doc", "pass", "at"], "left_semi")
    placed = only.withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("pass", "at")) - 1)
    return streams.channelled(placed).select("doc", "pos", "kind", "path", "channel", "body")
