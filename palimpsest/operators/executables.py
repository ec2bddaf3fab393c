"""Executables as records: headers, sections, directories and imports of PE files as one struct of columns, entropy of
any range of bytes from a body's block histograms, and the markers that follow."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import files
from palimpsest.functions.markers import executable_at_start
from palimpsest.operators.records import Layout, c_string, number, once
from palimpsest.operators.structure import entropy_of
from palimpsest.operators.tables import kept

#: Bits a byte from which a section counts as packed, and as dense.
PACKED, DENSE = 7.2, 7.0
#: Sections, imported libraries and functions of each that are looked at.
SECTIONS, LIBRARIES, FUNCTIONS = 96, 64, 256
#: Places of directories: imports, certificates, the common language runtime.
IMPORTS, CERTIFICATES, RUNTIME = 1, 4, 14
BLOCK = 4096

COFF = Layout(("machine", "u16"), ("sections", "u16"), ("time", "u32"), (None, 8), ("optional", "u16"), ("characteristics", "u16"))
SECTION = Layout(("name", 8), ("virtual_size", "u32"), ("virtual_address", "u32"), ("raw_size", "u32"), ("raw_offset", "u32"), (None, 12), ("characteristics", "u32"))
DIRECTORY = Layout(("address", "u32"), ("size", "u32"))
IMPORT = Layout(("lookup", "u32"), (None, 8), ("name", "u32"), ("thunk", "u32"))


def offset_of(sections: Column, address: Column) -> Column:
    """The place in the file of a virtual address; null if no section holds it."""
    inside = F.filter(sections, lambda s: (address >= s["virtual_address"]) & (address < s["virtual_address"] + F.greatest(s["raw_size"], s["virtual_size"])))
    return address - F.get(inside, F.lit(0))["virtual_address"] + F.get(inside, F.lit(0))["raw_offset"]


def headers(executables: DataFrame, body: str = "body") -> DataFrame:
    """With column pe, null for bodies that don't begin like an executable: machine, time, characteristics, magic, entry,
    image_base, image_size, header_size, subsystem, sections, directories, overlay (bytes behind the last section)."""
    b = F.col(body)
    found = executables.withColumn("pe_at", F.when(F.coalesce(executable_at_start(b), F.lit(False)), number(b, F.lit(60), 4)))
    found = found.withColumn("coff", COFF.at(b, F.col("pe_at") + 4)).withColumn("magic", number(b, F.col("pe_at") + 24, 2))
    opt, wide = F.col("pe_at") + 24, F.col("magic") == 0x20B
    sections = SECTION.array(b, opt + F.col("coff.optional"), F.col("coff.sections"), SECTIONS)
    named = F.transform(sections, lambda s: s.withField("name", F.regexp_replace(F.decode(s["name"], "ISO-8859-1"), r"\x00.*$", "")))
    directories = DIRECTORY.array(b, opt + F.when(wide, 112).otherwise(96), number(b, opt + F.when(wide, 108).otherwise(92), 4), 16)
    found = found.withColumn("parts", named)
    ends = F.transform(F.filter("parts", lambda s: s["raw_size"] > 0), lambda s: s["raw_offset"] + s["raw_size"])
    overlay = F.greatest(F.octet_length(b) - F.array_max(ends), F.lit(0))
    pe = F.struct(
        "coff.machine", "coff.time", "coff.characteristics", "magic", number(b, opt + 16, 4).alias("entry"),
        F.when(wide, number(b, opt + 24, 8)).otherwise(number(b, opt + 28, 4)).alias("image_base"),
        number(b, opt + 56, 4).alias("image_size"), number(b, opt + 60, 4).alias("header_size"), number(b, opt + 68, 2).alias("subsystem"),
        F.col("parts").alias("sections"), directories.alias("directories"), overlay.alias("overlay"), F.col("coff.sections").alias("number_of_sections"),
    )
    return found.withColumn("pe", F.when(F.col("pe_at").isNotNull() & F.col("coff.machine").isNotNull(), pe)).drop("pe_at", "coff", "magic", "parts")


def imports(known: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Of bodies with column pe: key, pos, library, functions, a row for each imported library in the order of the file; a
    function that is imported by number is ``#n``. ``key`` tells bodies apart."""
    b, sections = F.col(body), F.col("sections")
    start = offset_of(F.col("pe.sections"), F.get(F.col("pe.directories"), F.lit(IMPORTS))["address"])
    found = known.where("pe IS NOT NULL").select(key, body, "pe.sections", (F.col("pe.magic") == 0x20B).alias("wide"), start.alias("start"))
    found = kept(found, "executables").where("start IS NOT NULL")  # else each use of the sections would read the headers again
    libraries = IMPORT.chain(b, F.col("start"), lambda r: F.lit(IMPORT.size), LIBRARIES, lambda r: (r["name"] != 0) & (r["thunk"] != 0), IMPORT.size)
    rows = found.select(key, body, "sections", "wide", F.posexplode_outer(libraries).alias("pos", "x")).where("pos IS NOT NULL")
    rows = rows.select(key, body, "sections", "wide", "pos", offset_of(sections, F.col("x.name")).alias("name_at"), offset_of(sections, F.when(F.col("x.lookup") != 0, F.col("x.lookup")).otherwise(F.col("x.thunk"))).alias("at"))
    short, long = Layout(("low", "u32")), Layout(("low", "u32"), ("high", "u32"))
    thunk = "array<struct<value:bigint,numbered:boolean>>"
    of = lambda layout, top: F.transform(layout.array(b, F.col("at"), F.lit(FUNCTIONS), FUNCTIONS), lambda t: F.struct((t["low"] + (t["high"] % (1 << 31) if layout is long else 0)).alias("value"), (t[top] >= 1 << 31).alias("numbered"))).cast(thunk)
    rows = rows.select(key, body, "sections", "pos", F.lower(c_string(b, F.col("name_at"))).alias("library"), F.when(F.col("wide"), of(long, "high")).otherwise(of(short, "low")).alias("thunks"))
    end = F.array_position(F.transform("thunks", lambda t: (t["value"] == 0) & ~t["numbered"]), True)
    rows = rows.select(key, body, "pos", "library", "sections", F.slice("thunks", F.lit(1), F.when(end > 0, end - 1).otherwise(F.size("thunks")).cast("int")).alias("thunks"))
    placed = F.transform("thunks", lambda t: F.struct(F.when(t["numbered"], t["value"] % 65536).alias("number"), F.when(~t["numbered"], offset_of(sections, t["value"])).alias("at")))
    rows = rows.select(key, body, "pos", "library", placed.alias("placed"))
    names = once(b, lambda whole: F.transform("placed", lambda p: F.coalesce(F.concat(F.lit("#"), p["number"].cast("string")), c_string(whole, p["at"] + 2))))
    return rows.select(key, "pos", "library", names.alias("functions"))


def with_imports(known: DataFrame, key: str, body: str = "body") -> DataFrame:
    """With column imports, an array of (pos, library, functions)."""
    listed = imports(known, key, body).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "library", "functions"))).alias("imports"))
    return known.join(listed, key, "left")


def range_entropies(body: Column, ranges: Column) -> Column:
    """Bits a byte of each (start, size) of an array of structs. A body is counted once, in blocks of 4096 bytes whose
    histograms are summed from the front: a range is a difference of two sums and what its ends have besides."""

    def between(data: np.ndarray, sums: np.ndarray, start: int, end: int) -> np.ndarray:
        first, last = -(-start // BLOCK), end // BLOCK
        if first >= last:
            return np.bincount(data[start:end], minlength=256)
        inner = sums[last] - sums[first]
        return inner + np.bincount(data[start : first * BLOCK], minlength=256) + np.bincount(data[last * BLOCK : end], minlength=256)

    @F.pandas_udf("array<double>")
    def entropies(bodies: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for content, some in zip(bodies, asked, strict=True):
            if content is None or some is None:
                out.append(None)
                continue
            data = np.frombuffer(content, np.uint8)
            whole = data[: len(data) // BLOCK * BLOCK].reshape(-1, BLOCK)
            sums = np.zeros((len(whole) + 1, 256), np.int64)
            np.cumsum(np.array([np.bincount(w, minlength=256) for w in whole]).reshape(-1, 256), axis=0, out=sums[1:])
            out.append([entropy_of(between(data, sums, min(max(0, int(r["start"])), len(data)), min(max(0, int(r["start"])) + max(0, int(r["size"])), len(data)))) for r in some])
        return pd.Series(out, index=bodies.index)

    return entropies(body, ranges)


def anomalies(now: Column) -> list[tuple[str, Column]]:
    """What a header that a linker wrote doesn't have."""
    pe = lambda n: F.col(f"pe.{n}")
    return [
        ("no sections", pe("number_of_sections") == 0),
        ("many sections", pe("number_of_sections") >= 10),
        ("no time", pe("time") == 0),
        ("time ahead", pe("time") > F.unix_timestamp(now)),
        ("entry in header", (pe("entry") != 0) & (pe("entry") < pe("header_size"))),
        ("base not aligned", pe("image_base") % 65536 != 0),
        ("image ends before sections", F.exists(pe("sections"), lambda s: s["virtual_address"] >= pe("image_size"))),
        ("section beyond the file", F.exists(pe("sections"), lambda s: (s["raw_size"] > 0) & (s["raw_offset"] > F.octet_length("body")))),
    ]


def binary_markers(bodies: DataFrame, now: Column) -> DataFrame:
    """``bodies(key, body)``: key, marker, each once a key: executables of the two formats, packed and dense
    sections, sections without bytes, bytes behind the last section (certificates are such too), managed code, and
    headers with an anomaly."""
    known = headers(bodies.withColumn("elf", files.is_elf(F.col("body"))).where(F.col("elf") | F.coalesce(executable_at_start(F.col("body")), F.lit(False))))
    asked = F.transform("pe.sections", lambda s: F.struct(s["raw_offset"].alias("start"), s["raw_size"].alias("size")))
    known = known.withColumn("bits", range_entropies(F.col("body"), asked))
    some = lambda test: F.coalesce(F.exists("pe.sections", test), F.lit(False))
    bits = lambda test: F.coalesce(F.exists("bits", test), F.lit(False))
    runtime = F.get(F.col("pe.directories"), F.lit(RUNTIME))
    tests = (
        (F.col("elf"), "ELF-EXECUTABLE"),
        (some(lambda s: (s["raw_size"] == 0) & (s["virtual_size"] > 0)), "PE-VIRTUAL-SECTION"),
        (bits(lambda x: x >= PACKED), "PE-SECTION-PACKED"),
        (bits(lambda x: (x >= DENSE) & (x < PACKED)), "PE-SECTION-HIGH-ENTROPY"),
        (F.coalesce(F.col("pe.overlay") > 0, F.lit(False)), "PE-OVERLAY"),
        (F.coalesce((runtime["address"] != 0) & (runtime["size"] != 0), F.lit(False)), "PE-DOTNET"),
        (reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for _, c in anomalies(now)]), "PE-ANOMALY"),
    )
    found = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in tests]), lambda m: m.isNotNull())
    return known.select("key", F.explode(found).alias("marker")).distinct()
