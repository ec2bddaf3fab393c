"""Steps carried over blocks, scripts that write files, records of workbooks, lost and appended parts of compound files."""

import random
import struct

from pyspark.sql import functions as F
from test_containers import compound as mixed_compound

from palimpsest.operators import cells, compound, droppers, structure, workbooks
from palimpsest.sources import sinks
from palimpsest.streaming import effort_steps


def folded(rows):
    out = {}
    for node in {r[0] for r in rows}:
        level = 0
        for _, tick, target in sorted((r for r in rows if r[0] == node), key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
            level = level if target is None else effort_steps.step(level, min(max(target, 1), 10))
            out.setdefault((node, tick), []).append(level)
    return out


def test_steps_over_many_blocks(spark):
    rng = random.Random(5)
    nodes = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(nodes), tick // 2, rng.choice((None, 0, 1, 4, 9, 10, 40))) for tick in range(4000)]
    made = spark.createDataFrame(rows, "node string, tick long, target int")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {}
        for r in effort_steps.steps(made).collect():
            got.setdefault((r.node, r.tick), []).append(r.level)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in folded(rows).items()}
    assert effort_steps.steps(made.limit(0)).count() == 0


def dropped(spark, **scripts):
    made = spark.createDataFrame(list(scripts.items()), "key string, text string")
    return {k: [(r.name, r.body) for r in sorted(droppers.dropped_files(made).where(F.col("key") == k).collect(), key=lambda r: r.pos)] for k in scripts}


def test_files_that_scripts_write(spark):
    got = dropped(
        spark,
        lines='@echo off\n>"a.vbs" echo one^&two\n>>"a.vbs" echo.\n>>"a.vbs" echo three\ndir',
        behind="echo x > b.txt\r\necho y^^ >> b.txt\r\n>>c.js echo z\r\n",
        none="dir\necho hello",
        block='>"p.ps1"(\n  echo first\n>"q.txt" (\n>>"q.txt" echo no\nrem no\nECHO\necho.\n echo last^\n)\n>>"q.txt" echo yes\n>"p.ps1" (\necho more\n',
        appended='>>"f" (\necho outside\n)\n',
        empty='>"f" (\nrem nothing\n)\n',
        nothing=None,
    )
    assert got["lines"] == [("a.vbs", "one&two\r\n\r\nthree")]
    assert got["behind"] == [("b.txt", "x\r\ny^"), ("c.js", "z")]
    assert got["block"] == [("p.ps1", "first\r\n\r\n\r\nlast\r\nmore"), ("q.txt", "yes")]
    assert not (got["none"] or got["appended"] or got["empty"] or got["nothing"])


def test_macro_sheets_and_cut_records(spark):
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    sheet = lambda state, kind, name: record(0x85, struct.pack("<IBBBB", 0, state, kind, len(name), 0) + name)
    whole = record(0x809, b"\0" * 4) + sheet(0, 1, b"shown") + sheet(1, 0, b"plain") + sheet(2, 1, b"Macro1") + record(0x85, b"abc")
    cut = sheet(1, 1, b"first") + struct.pack("<HH", 0x85, 500) + b"short"
    made = spark.createDataFrame([("a", "Workbook", whole), ("b", "x/Book", cut), ("c", "Book", b""), ("d", "Book", None), ("e", "Other", whole)], "key string, path string, body binary")
    assert {tuple(r) for r in workbooks.macro_markers(made).collect()} == {("a", "XLM-HIDDEN-MACROSHEET veryHidden Macro1"), ("b", "XLM-HIDDEN-MACROSHEET hidden first")}


def test_streams_outside_the_tree_and_behind_the_end(spark):
    body = bytearray(mixed_compound({"kept": b"k" * 5000, "lost": b"l" * 4500, "small": b"s" * 10}))
    at = 512 * (1 + struct.unpack_from("<I", body, 48)[0])
    struct.pack_into("<I", body, at + 128 + 72, 0xFFFFFFFF)  # the first entry loses its right neighbour
    files = spark.createDataFrame([("a", bytes(body)), ("b", bytes(body) + b"\0" * 2000), ("c", bytes(body) + b"tail" * 200), ("d", bytes(body) + b"short"), ("e", None)], "file string, body binary")
    entries, bodies = compound.directory(files)
    assert {(r.file, r.pos, bytes(r.body)) for r in compound.orphans(entries, bodies).where("file = 'a'").collect()} == {("a", 2, b"l" * 4500), ("a", 3, b"s" * 10)}
    assert {(r.file, bytes(r.body)) for r in compound.extra_data(files).collect()} == {("c", b"tail" * 200)}
    marked = spark.createDataFrame([("c", 0, "#extra", "ole2", 1, b"x")], "key string, pos int, path string, kind string, layer int, body binary")
    assert [r.marker for r in structure.compound_markers(marked).collect()] == ["OLE2-EXTRA-DATA"]


def test_values_that_formulas_set(spark):
    rows = [("d", "s", 0, "A1", "=B1&C1&D1", None), ("d", "s", 1, "B1", None, "zz"), ("d", "s", 2, "$B$1", None, "aa"), ("d", "s", 3, "C1", None, "old"), ("d", "s", 4, "E1", '=SET.VALUE($C$1, "new")', None), ("d", "s", 5, "D1", None, "")]
    got = cells.substituted(spark.createDataFrame(rows, "doc string, sheet string, pos int, coord string, formula string, value string"))
    assert {r.coord: r.text for r in got.collect()}["A1"] == '="zz"&"new"&D1'


def test_responses_keep_the_order(spark):
    found = spark.createDataFrame([("a", p, f"r{p}", "n") for p in (11, 2, 30, 1)], "doc string, pos long, rule string, namespace string")
    docs = spark.createDataFrame([("a",), ("b",)], "doc string")
    assert {r.doc: r.response for r in sinks.json_responses(docs, found).collect()} == {"a": "[" + ",".join(f'{{"rule":"r{p}","namespace":"n"}}' for p in (1, 2, 11, 30)) + "]", "b": "[]"}
