"""Whole documents through the frontier, and the readers below it, against files built here."""

import gzip
import io
import math
import random
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from test_containers import compound as mixed_compound

from palimpsest.operators import compound, executables, inspection, members, structure
from palimpsest.plans import binaries, containers_made

NOW = "2024-01-01"


def told(spark, **files):
    made = spark.createDataFrame([(k, v) for k, v in files.items()], "doc string, body binary")
    rows = inspection.inspected(made, F.lit(NOW).cast("timestamp")).orderBy("doc", "pos").collect()
    return {k: [r for r in rows if r.doc == k] for k in files}


def test_three_nested_kinds_markers_and_combined_evidence(spark):
    zipped = binaries.archive
    program = binaries.executable([(b".pack", binaries.noise(1, 8192), 8192)], overlay=b"tail")
    got = told(
        spark,
        deep=zipped(a=gzip.compress(b"{\\rtf1 {\\objdata " + zipped(s=b"hello there").hex().encode() + b"}\\objupdate}")),
        office=containers_made.office(b"text inside"),
        page=b"<html><script>new Blob(x)</script><a download=\"x\">",
        exe=program,
        twice=zipped(a=b"same bytes", b=b"same bytes"),
        broken=b"PK\x03\x04 nothing behind",
        nothing=None,
    )
    assert [(r.kind, r.path) for r in got["deep"] if r.kind in members.OPENERS] == [("zip", "a"), ("gzip", "a!content"), ("rtf", "a!content!object0"), ("zip", "a!content!object0!s")]
    assert bytes(next(r.body for r in got["deep"] if r.path.endswith("!s"))) == b"hello there"
    office = {bytes(r.body).decode("latin-1"): r.channel for r in got["office"] if r.kind == "structure"}
    assert office["DOCPROPS-STRINGS\nTitle\nMe"] == "marker" and "OOXML-DDE-FIELD DDEAUTO c:\\cmd.exe" in office
    assert not any(r.path == "word/document.xml" for r in got["office"]) and any(r.path == "extra/inner.zip" for r in got["office"])
    assert [r.channel for r in got["page"]] == ["content", "marker"] and bytes(got["page"][1].body) == b"HTML-SMUGGLING-BLOB"
    assert {bytes(r.body) for r in got["exe"][1:]} == {b"PE-SECTION-PACKED", b"PE-OVERLAY"}
    assert len(got["twice"]) == 2 and len(got["broken"]) == 1 and not got["nothing"]
    assert all([r.pos for r in rows] == list(range(len(rows))) for rows in got.values())


def test_budget_is_charged_in_order(spark):
    made = spark.createDataFrame([("d", binaries.archive(**{f"m{i}": b"%d" % i * 100 for i in range(10)}))], "doc string, body binary")
    found = inspection.unfolded(made, most=4).where("layer = 1").orderBy("at").collect()
    assert [r.path for r in found] == ["m0", "m1", "m2", "m3"]
    assert inspection.unfolded(made, total=250).where("layer = 1").count() == 2
    assert inspection.unfolded(made.limit(0)).count() == 0


def opened(spark, kind, body):
    return {r.name: bytes(r.body) for r in members.opened(spark.createDataFrame([("f", body)], "file string, body binary"), kind).collect()}


def test_members_of_every_kind(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in (("one", b"1" * 700), ("two", b"2")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert opened(spark, "tar", out.getvalue()) == {"one": b"1" * 700, "two": b"2"}
    assert opened(spark, "gzip", gzip.compress(b"x" * 50)) == {"content": b"x" * 50}
    import zlib

    pdf = b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>>\nstream\n" + zlib.compress(b"inner") + b"\nendstream\n2 0 obj <</Filter [/ASCIIHexDecode]>> stream\r\n68 69>\nendstream"
    assert opened(spark, "pdf", pdf) == {"stream0": b"inner", "stream1": b"hi"}
    assert opened(spark, "rtf", b"{\\rtf1\\objdata 68 \n69}{\\objdata 7}") == {"object0": b"hi", "object1": b""}
    locked = opened(spark, "zip", containers_made.crypt(b"secret", b"pass"))
    assert locked == {"#ARCHIVE-ENCRYPTED": b"ARCHIVE-ENCRYPTED"}
    for kind, make in (("lnk", containers_made.shortcut), ("zip", lambda b: b"PK\x03\x04" + b), ("pdf", lambda b: b), ("tnef", lambda b: b), ("onenote", lambda b: b)):
        assert isinstance(opened(spark, kind, make(b"a b")[:40]), dict)
        assert opened(spark, kind, b"") == {}


def test_compound_files_with_short_and_long_streams(spark):
    rng = random.Random(3)
    streams = {f"s{i}": rng.randbytes(n) for i, n in enumerate((1, 63, 64, 65, 700, 4095, 4096, 5000, 20_000))}
    made = spark.createDataFrame([("a", mixed_compound(streams)), ("b", mixed_compound({"x": b"y" * 10})), ("c", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\xff" * 600), ("d", None)], "file string, body binary")
    got = {(r.file, r.path): bytes(r.body) for r in compound.streams(made).collect()}
    assert got == {**{("a", k): v for k, v in streams.items()}, ("b", "x"): b"y" * 10}


def test_chains_of_any_length_and_circles(spark):
    links = [("a", i, i + 1 if i < 999 else None) for i in range(1000)] + [("b", 0, 1), ("b", 1, 0), ("b", 2, None)]
    got = {(r.file, r.node): (r.end, r.left) for r in compound.chains(spark.createDataFrame(links, "file string, node long, next long")).collect()}
    assert got == {**{("a", i): (999, 999 - i) for i in range(1000)}, ("b", 2): (2, 0)}


def test_times_of_entries(spark):
    tick = lambda day: (19_700 + day) * 86_400 * 10_000_000 + 116_444_736_000_000_000
    body = bytearray(mixed_compound({f"s{i}": b"x" * 10 for i in range(4)}))
    at = 512 * (1 + struct.unpack_from("<I", body, 48)[0])
    for i in range(4):
        struct.pack_into("<QQ", body, at + 128 * (i + 1) + 100, tick(1), tick(2) if i else tick(30))
    entries, _ = compound.directory(spark.createDataFrame([("f", bytes(body))], "file string, body binary"))
    times = compound.entry_times(entries)
    assert {(r.key, r.marker) for r in structure.time_markers(times, F.lit("2023-12-15").cast("timestamp")).collect()} == {("f", "OLETIMES-FUTURE 2024-01-08"), ("f", "OLETIMES-SYNTHETIC 3")}


def test_summaries_of_odd_bodies(spark):
    good = binaries.summary(b"http://x", b"Equation", b"1", 0, 2)
    made = spark.createDataFrame([("a", good), ("b", good[:70]), ("c", b""), ("d", None), ("e", b"\xfe\xff" + b"\0" * 60)], "key string, body binary")
    got = {r.key: (r.template, r.app, r.revision, r.minutes, r.security) for r in compound.summaries(made).collect()}
    assert got["a"] == ("http://x", "Equation", "1", 0, 2) and all(v == (None,) * 5 for k, v in got.items() if k != "a")


def entropy(data):
    return -sum(c / len(data) * math.log2(c / len(data)) for c in map(data.count, set(data)))


def test_entropy_of_ranges(spark):
    rng = random.Random(5)
    body = rng.randbytes(20_000) + b"a" * 9000 + bytes(range(256)) * 10
    ranges = [(rng.randrange(len(body)), rng.randrange(1, 15_000)) for _ in range(40)] + [(0, len(body)), (4096, 4096), (len(body), 10), (5, 0)]
    made = spark.createDataFrame([(body, [{"start": a, "size": n} for a, n in ranges])], "body binary, ranges array<struct<start:long,size:long>>")
    got = made.select(executables.range_entropies(F.col("body"), F.col("ranges"))).first()[0]
    assert got == pytest.approx([entropy(body[a : a + n]) if body[a : a + n] else 0.0 for a, n in ranges], abs=1e-9)


def test_each_marker_of_executables(spark):
    text = (".text", b"x" * 600, 600)
    plain = [(text[0].encode(), text[1], 600)]
    cases = {
        "plain": (binaries.executable(plain), set()),
        "wide": (binaries.executable(plain, {"a.dll": ["b"]}, wide=True), set()),
        "packed": (binaries.executable([(b".p", binaries.noise(1, 8192), 8192)]), {"PE-SECTION-PACKED"}),
        "dense": (binaries.executable([(b".p", bytes(i % 140 for i in range(140 * 512)), 71680)]), {"PE-SECTION-HIGH-ENTROPY"}),
        "empty": (binaries.executable([*plain, (b".bss", b"", 10)]), {"PE-VIRTUAL-SECTION"}),
        "tail": (binaries.executable(plain, overlay=b"x"), {"PE-OVERLAY"}),
        "managed": (binaries.executable(plain, managed=True), {"PE-DOTNET"}),
        "ahead": (binaries.executable(plain, time=1_900_000_000), {"PE-ANOMALY"}),
        "in header": (binaries.executable(plain, entry=16), {"PE-ANOMALY"}),
        "elf": (b"\x7fELF\x02\x01\x01" + b"\0" * 9 + b"\x02\0", {"ELF-EXECUTABLE"}),
        "cut": (binaries.executable(plain)[:200], set()),
        "none": (b"MZ", set()),
    }
    made = spark.createDataFrame([(k, b) for k, (b, _) in cases.items()] + [("null", None)], "key string, body binary")
    got = {k: set() for k in cases}
    for r in executables.binary_markers(made, F.lit(NOW).cast("timestamp")).collect():
        got[r.key].add(r.marker)
    got["cut"] -= {"PE-ANOMALY"}  # a cut header may show one or not
    assert got == {k: m for k, (_, m) in cases.items()}
