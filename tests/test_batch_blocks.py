"""Blocks of batch scripts against a plain reading of the lines, and what finding them costs."""

import random
import re

from palimpsest.operators import droppers

LINES = [")", '>"a.txt" (', '>"b.txt" (', "echo one", "ECHO t^wo^", "echo.", "rem no", '>"c.txt" echo three', "echo four >> d.txt", "echoes", "echo"]


def read(lines):
    files, block = {}, None
    for line in lines:
        said = None if not re.match(droppers.ECHO, line) else "" if line[4:5] == "." else re.sub(r"\^(.?)", r"\1", line[5:])
        if line == ")":
            block = None
        elif block:
            files[block] += [said] if said is not None else []
        elif line.endswith(" ("):
            block = line[2:7]
            files.setdefault(block, [])
        elif line.startswith(">"):
            files.setdefault("c.txt", []).append("three")
        elif ">>" in line:
            files.setdefault("d.txt", []).append("four")
    return [(n, "\r\n".join(x)) for n, x in files.items() if x]


def test_blocks_as_read_line_by_line(spark):
    rng = random.Random(5)
    scripts = {k: [rng.choice(LINES) for _ in range(rng.randint(0, 40))] for k in range(60)}
    found = droppers.dropped_files(spark.createDataFrame([(k, "\r\n".join(x)) for k, x in scripts.items()], "key long, text string"))
    got = {k: [] for k in scripts}
    for r in sorted(found.collect(), key=lambda r: (r.key, r.pos)):
        got[r.key].append((r.name, r.body))
    assert got == {k: read(x) for k, x in scripts.items()}


def test_lines_are_sorted_once(spark):
    found = droppers.dropped_files(spark.createDataFrame([(1, "echo x >> a")], "key long, text string"))
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert len(re.findall(r"\bSort \[", plan)) == 2  # the lines, and the few files in their order
