"""Markers from the structure of documents: columns over the rows of :func:`palimpsest.operators.containers.extracted`
(key, pos, path, kind, layer, body), gathered by document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import files, markers
from palimpsest.functions.files import latin1

#: Records of a workbook looked at; code without source that counts as stomped.
RECORDS, CODE_LEAST, SOURCE_MOST = 64, 256, 32
#: Fixed value: parts of an Office archive that belong to its format.
PARTS = r"^(?:word|xl|ppt|visio|customXml|_rels|docProps)/|^\[Content_Types\]\.xml$|^mimetype$"


def number(body: Column, at: Column, size: int) -> Column:
    """A number of ``size`` bytes at an offset, the low byte first; null beyond the end."""
    digits = [F.hex(F.substring(body, at + F.lit(i + 1), F.lit(1))) for i in reversed(range(size))]
    return F.when(at + size <= F.octet_length(body), F.conv(F.concat(*digits), 16, 10).cast("long"))


def workbook_encryption(body: Column) -> Column:
    """The marker of a workbook's password record, found among its first records."""
    kind = "struct<at:bigint,marker:string>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("string").alias("marker")).cast(kind)

    def step(s: Column, _: Column) -> Column:
        record, length = number(body, s["at"], 2), number(body, s["at"] + 2, 2)
        found = F.when(record == 0x2F, F.when(number(body, s["at"] + 4, 2) == 0, "ENCRYPTION-XOR").otherwise("ENCRYPTION-RC4"))
        going = s["marker"].isNull() & record.isNotNull() & (record != 0x0A)
        return F.when(going, F.struct(F.when(found.isNull(), s["at"] + 4 + length).otherwise(s["at"]).alias("at"), found.alias("marker"))).otherwise(F.struct(F.lit(None).cast("bigint").alias("at"), s["marker"].alias("marker"))).cast(kind)

    return F.aggregate(F.sequence(F.lit(1), F.lit(RECORDS)), start, step)["marker"]


def compound_markers(members: DataFrame) -> DataFrame:
    """key, marker: encryption, signatures, embedded objects, macros and links of compound files, each once."""
    name = F.regexp_extract("path", r"([^/!]+)$", 1)
    word = (number(F.col("body"), F.lit(0), 2) == 0xA5EC) & (F.floor(number(F.col("body"), F.lit(10), 2) / 256) % 2 == 1)
    found = F.array(
        F.when(name.isin("Workbook", "Book"), workbook_encryption(F.col("body"))),
        F.when((name == "WordDocument") & word, "ENCRYPTION-RC4"),
        F.when(name == "EncryptedSummary", "ENCRYPTION-RC4"),
        F.when(name == "EncryptionInfo", "ENCRYPTION-AES"),
        F.when(F.col("path").rlike(r"(?:^|/)_(?:xml)?signatures(?:/|$)"), "DIGITAL-SIGNATURE"),
        F.when(F.col("path").rlike(r"(?:^|/)ObjectPool/"), "OLEID-OBJECTPOOL"),
        F.when(latin1(F.col("body")).rlike(r"^(?:[FCZ]WS)[\x01-\x20]"), "OLEID-FLASH"),
        F.when(F.endswith("path", F.lit("#vba")), "OLEID-VBA-PRESENT"),
        F.when(F.endswith("path", F.lit("#extra")), "OLE2-EXTRA-DATA"),
        F.when(F.endswith("path", F.lit("#address")), F.concat(F.lit("OLE2LINK-URL "), latin1(F.col("body")))),
    )
    rows = members.where("kind = 'ole2'").select("key", F.explode(F.filter(found, lambda m: m.isNotNull())).alias("marker"))
    return rows.distinct()


def office_markers(members: DataFrame) -> DataFrame:
    """key, marker: fields that start programs, hidden macro sheets and outer relations of Office archives."""
    xml = latin1(F.col("body"))
    texts = F.array_join(F.regexp_extract_all(xml, F.lit(r"<w:instrText\b[^>]*>([^<]*)<"), 1), "")
    fields = F.concat(F.array(texts), F.regexp_extract_all(xml, F.lit(r'<w:fldSimple\b[^>]*\bw:instr="([^"]*)"'), 1))
    plain = F.transform(fields, lambda f: F.trim(F.regexp_replace(markers.unescaped_xml(f), r"\s+", " ")))
    dde = F.transform(F.filter(plain, lambda f: F.regexp_replace(f, " ", "").rlike("(?i)^DDE(?:AUTO)?")), lambda f: F.concat(F.lit("OOXML-DDE-FIELD "), f))
    sheets = F.regexp_extract_all(xml, F.lit(r"<sheet\b[^>]*>"), 0)
    hidden = F.filter(sheets, lambda s: s.rlike('state="(?:hidden|veryHidden)"'))
    named = F.transform(hidden, lambda s: F.concat(F.lit("XLM-HIDDEN-MACROSHEET "), F.regexp_extract(s, 'state="([^"]*)"', 1), F.lit(" "), F.regexp_extract(s, r'\bname="([^"]*)"', 1)))
    none = F.array().cast("array<string>")
    rows = members.where("kind = 'zip'").select(
        "key",
        F.col("path").rlike(r"(?:^|!)xl/macrosheets/").alias("macro"),
        F.when(F.col("path").rlike(r"(?:^|!)word/[^/#]*\.xml$"), dde).when(F.col("path").rlike(r"\.rels#\d+$"), F.array(xml)).otherwise(none).alias("found"),
        F.when(F.col("path").rlike(r"(?:^|!)xl/workbook\.xml$"), named).otherwise(none).alias("sheets"),
    )
    gathered = rows.groupBy("key").agg(F.max("macro").alias("macro"), F.flatten(F.collect_list("found")).alias("found"), F.flatten(F.collect_list("sheets")).alias("sheets"))
    return gathered.select("key", F.explode(F.array_distinct(F.concat("found", F.when(F.col("macro"), F.col("sheets")).otherwise(none)))).alias("marker"))


def office_siblings(members: DataFrame) -> DataFrame:
    """Members of Office archives that aren't parts of the format and carry something themselves."""
    office = members.where("kind = 'zip' AND layer = 1").groupBy("key").agg(F.max(F.col("path").rlike(PARTS)).alias("office")).where("office").select("key")
    own = members.where("layer = 1").where(~F.col("path").rlike(PARTS) & (files.kind(F.col("body")) != "none"))
    return own.join(office, "key", "left_semi")


def property_texts(members: DataFrame) -> DataFrame:
    """key, stream: the texts of an Office archive's property parts behind their marker."""
    texts = F.filter(F.transform(F.regexp_extract_all(latin1(F.col("body")), F.lit(r">([^<]+)<"), 1), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    rows = members.where(F.col("path").rlike(r"(?:^|!)docProps/[^/]*\.xml$")).select("key", "pos", texts.alias("texts"))
    lines = rows.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "texts"))), lambda x: x["texts"])).alias("texts")).where(F.size("texts") > 0)
    return lines.select("key", F.concat(F.lit("DOCPROPS-STRINGS\n"), F.array_join("texts", "\n")).alias("stream"))


def effective_source(source: Column) -> Column:
    """Characters of macro source that say something: trimmed lines, without blank ones and attributes."""
    lines = F.transform(F.split(source, "\r?\n"), lambda x: F.trim(x))
    return F.aggregate(F.filter(lines, lambda x: ~F.startswith(x, F.lit("Attribute VB_"))), F.lit(0), lambda s, x: s + F.length(x))


def stomped(modules: DataFrame) -> DataFrame:
    """``modules(key, module, code_bytes, source)``: key, marker of those with compiled code but next to no source."""
    size = effective_source(F.col("source"))
    hit = modules.where((F.col("code_bytes") >= CODE_LEAST) & (size < SOURCE_MOST))
    return hit.select("key", F.concat(F.lit("VBA-STOMPED "), "module", F.lit(" pcode="), F.col("code_bytes").cast("string"), F.lit(" src="), size.cast("string")).alias("marker"))


def summary_markers(summaries: DataFrame) -> DataFrame:
    """``summaries(key, template, app, revision, minutes, security)``: key, marker of templates from elsewhere, the formula
    editor, documents that nobody edited, and protection bits."""
    remote = F.lower(F.trim("template")).rlike(r"^https?://") | F.startswith(F.trim("template"), F.lit("\\\\"))
    found = F.array(
        F.when(remote, "OLE-META TEMPLATE-INJECTION"),
        F.when(F.contains(F.lower("app"), F.lit("equation")), "OLE-META APPNAME-EQUATION"),
        F.when(F.trim("revision").isin("0", "1"), "OLE-META REVISION"),
        F.when(F.col("minutes") == 0, "OLE-META EDIT-TIME"),
        F.when(F.col("security") > 0, F.concat(F.lit("OLE-DOC-SECURITY-"), F.col("security").cast("string"))),
    )
    return summaries.select("key", F.explode(F.filter(found, lambda m: m.isNotNull())).alias("marker"))


def time_markers(entries: DataFrame, now: Column) -> DataFrame:
    """``entries(key, pos, created, modified)``: key, marker of the first time over two days ahead, and of pairs of times
    that three entries or more share."""
    ahead = F.greatest("created", "modified") > now + F.expr("INTERVAL 48 HOURS")
    first = entries.where(ahead).groupBy("key").agg(F.min_by(F.greatest("created", "modified"), "pos").alias("at"))
    future = first.select("key", F.concat(F.lit("OLETIMES-FUTURE "), F.date_format("at", "yyyy-MM-dd")).alias("marker"))
    same = entries.where("created IS NOT NULL AND modified IS NOT NULL").groupBy("key", "created", "modified").agg(F.count("*").alias("n")).where("n >= 3")
    return future.union(same.select("key", F.concat(F.lit("OLETIMES-SYNTHETIC "), F.col("n").cast("string")).alias("marker")))


def carved_executables(blobs: DataFrame) -> DataFrame:
    """``blobs(key, pos, body)``: key, pos, offset, body from there on, where an executable begins behind the start."""
    parts = F.slice(F.split(latin1(F.col("body")), "MZ"), 1, 64)
    lengths = F.transform(parts, lambda p: F.length(p))
    offsets = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x) + (i - 1) * 2)
    rest = lambda o: F.substring(F.col("body"), o + 1, F.octet_length("body"))
    good = F.filter(offsets, lambda o: (o > 0) & F.coalesce(markers.executable_at_start(rest(o)), F.lit(False)))
    rows = blobs.where(F.contains(latin1(F.col("body")), F.lit("MZ"))).select("key", "pos", F.get(good, F.lit(0)).alias("offset"), "body").where("offset IS NOT NULL")
    return rows.select("key", "pos", "offset", F.expr("substring(body, offset + 1)").alias("body"))


def entropy_of(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(counts.sum(), 1)
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


def byte_entropy(body: Column) -> Column:
    """Bits for each byte of a body; 0 for an empty one. Counted in Arrow batches, without a row for each byte."""

    @F.pandas_udf("double")
    def entropy(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: entropy_of(np.bincount(np.frombuffer(b, np.uint8), minlength=256)), na_action="ignore")

    return entropy(body)


def character_entropy(text: Column) -> Column:
    """The same for each character of a text."""

    @F.pandas_udf("double")
    def entropy(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: entropy_of(np.unique(np.frombuffer(t.encode("utf-32-le"), "<u4"), return_counts=True)[1]), na_action="ignore")

    return entropy(text)
