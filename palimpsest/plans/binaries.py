"""Queries over executables and compound files built from documents' texts."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from palimpsest.functions import encodings
from palimpsest.operators import compound, droppers, executables, inspection, rules, scripts, structure, workbooks
from palimpsest.operators.rules import NOTHING, Rule
from palimpsest.plans.catalogue import made_bodies, query

NOW = "2024-01-01"


def executable(sections: list[tuple[bytes, bytes, int]], imports: dict[str, list[str]] | None = None, wide: bool = False, time: int = 1_600_000_000, managed: bool = False, overlay: bytes = b"", entry: int = 0x1000) -> bytes:
    """An executable with (name, data, virtual size) sections at multiples of 64 KiB, and imports in a section of their
    own."""
    sections = list(sections)
    if imports:
        base, width = 0x10000 * (len(sections) + 1), 8 if wide else 4
        table, rest = b"", b""
        start = base + 20 * (len(imports) + 1)
        for library, names in imports.items():
            thunks, texts = b"", b""
            at = start + len(rest) + width * (len(names) + 1)
            for n in names:
                if n.startswith("#"):
                    thunks += (int(n[1:]) | 1 << (8 * width - 1)).to_bytes(width, "little")
                else:
                    thunks += (at + len(texts)).to_bytes(width, "little")
                    texts += b"\0\0" + n.encode() + b"\0"
            texts += library.encode() + b"\0"
            table += struct.pack("<5I", start + len(rest), 0, 0, at + len(texts) - len(library) - 1, start + len(rest))
            rest += thunks + b"\0" * width + texts
        sections.append((b".idata", table + b"\0" * 20 + rest, 0x1000))
    directories = [(0, 0)] * 16
    if imports:
        directories[1] = (base, 20 * (len(imports) + 1))
    if managed:
        directories[14] = (0x10000, 72)
    optional = struct.pack("<HBBIIII", 0x20B if wide else 0x10B, 14, 0, 0, 0, 0, entry) + struct.pack("<I", 0x1000)
    optional += struct.pack("<Q", 0x140000000) if wide else struct.pack("<II", 0x2000, 0x400000)
    optional += struct.pack("<II6HIIIIHH", 0x10000, 512, 6, 0, 0, 0, 6, 0, 0, 0x10000 * (len(sections) + 2), 1024, 0, 3, 0)
    optional += struct.pack("<4Q" if wide else "<4I", 0, 0, 0, 0) + struct.pack("<II", 0, 16) + b"".join(struct.pack("<II", *d) for d in directories)
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664 if wide else 0x14C, len(sections), time, 0, 0, len(optional), 0x102) + optional
    table, data, at = b"", b"", 1024
    for i, (name, content, virtual) in enumerate(sections):
        size = -(-len(content) // 512) * 512
        table += name.ljust(8, b"\0") + struct.pack("<IIII", virtual, 0x10000 * (i + 1), size, at if size else 0) + b"\0" * 12 + struct.pack("<I", 0x60000020)
        data += content.ljust(size, b"\0")
        at += size
    return (head + table).ljust(1024, b"\0") + data + overlay


def noise(seed: int, size: int) -> bytes:
    """Bytes without a pattern."""
    import hashlib

    return b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(-(-size // 32)))[:size]


def made(read, make):
    """``make(doc_id, text)`` of every document, as key and body. Documents are dealt by key: a file's row groups, however
    few and large, don't set how many tasks make and read bodies."""
    return made_bodies(read("documents").select("doc_id", "text").repartition("doc_id"), make, "key long, body binary")


def program(i: int, text: bytes) -> bytes:
    """What the sections hold, and what is odd, goes by the text's length."""
    n = len(text)
    sections = [(b".text", text[:65000], n % 65536)]
    if n % 3 == 0:
        sections.append((b".pack", noise(n, 8192), 8192))
    if n % 5 == 0:
        sections.append((b".bss", b"", 4096))
    return executable(sections, {"KERNEL32.dll": ["CreateFileA", "#17"], "ws2_32.dll": ["connect"]} if n % 2 else None, n % 4 < 2, 0 if n % 7 == 0 else 1_600_000_000, n % 11 == 0, text[:100] if n % 13 == 0 else b"")


LENGTHS = "(SELECT doc_id, strlen(text) AS n FROM documents)"


@query(f"SELECT doc_id AS key, unnest(list_filter([CASE WHEN n % 3 = 0 THEN 'PE-SECTION-PACKED' END, CASE WHEN n % 5 = 0 OR n = 0 THEN 'PE-VIRTUAL-SECTION' END, CASE WHEN n % 13 = 0 AND n > 0 THEN 'PE-OVERLAY' END, CASE WHEN n % 11 = 0 THEN 'PE-DOTNET' END, CASE WHEN n % 7 = 0 THEN 'PE-ANOMALY' END], lambda m: m IS NOT NULL)) AS marker FROM {LENGTHS}")
def executable_markers(read):
    return executables.binary_markers(made(read, program), F.lit(NOW).cast("timestamp"))


@query(f"SELECT doc_id AS key, library, fs AS functions FROM {LENGTHS}, (SELECT unnest(['kernel32.dll', 'ws2_32.dll']) AS library, unnest(['CreateFileA,#17', 'connect']) AS fs) WHERE n % 2 = 1")
def executable_imports(read):
    found = executables.imports(executables.headers(made(read, program)), "key")
    return found.select("key", "library", F.array_join("functions", ",").alias("functions"))


@query(f"SELECT doc_id AS key, CAST(1 + (n % 3 = 0)::INT + (n % 5 = 0)::INT + (n % 2 = 1)::INT AS BIGINT) AS sections, CASE WHEN n % 7 = 0 THEN 0 ELSE 1600000000 END::BIGINT AS time, CASE WHEN n % 4 < 2 THEN 34404 ELSE 332 END::BIGINT AS machine, CAST(ceil(least(n, 65000) / 512.0) * 512 AS BIGINT) AS first_size FROM {LENGTHS}")
def executable_headers(read):
    pe = executables.headers(made(read, program))
    return pe.select("key", F.col("pe.number_of_sections").alias("sections"), "pe.time", "pe.machine", F.get(F.col("pe.sections"), F.lit(0))["raw_size"].alias("first_size"))


PE_RULES = [
    Rule("Opens_Sockets", "pe", {}, condition=rules.pe_imports("ws2_32.dll", "connect") & rules.pe(lambda p: p["number_of_sections"] < 4)),
    Rule("Packed_And_Old", "pe", {}, condition=rules.pe_section(lambda s: s["name"] == ".pack") & rules.pe(lambda p: p["time"] < 1_000_000)),
    Rule("Word_In_Managed", "pe", {"a": ("text", "the", NOTHING)}, condition=rules.matches("a") & rules.pe(lambda p: F.get(p["directories"], F.lit(14))["size"] > 0)),
]


#: What the sections hold from the text on: its first 65000 bytes, filled up to a multiple of 512, and the noise.
CONTENT = """hex(encode(text))[:130000] || CASE WHEN n < 65000 AND n % 512 = 0 THEN '' ELSE '00' END || CASE WHEN n % 3 = 0 THEN array_to_string(list_transform(range(256), lambda i: upper(sha256(n || ':' || i))), '') ELSE '' END"""


@query(
    f"""SELECT key, rule FROM (SELECT doc_id AS key, unnest(list_filter([CASE WHEN n % 2 = 1 AND 2 + (n % 3 = 0)::INT + (n % 5 = 0)::INT < 4 THEN 'Opens_Sockets' END, CASE WHEN n % 3 = 0 AND n % 7 = 0 THEN 'Packed_And_Old' END,
    CASE WHEN n % 11 = 0 AND regexp_matches({CONTENT}, '^(..)*746865') THEN 'Word_In_Managed' END], lambda m: m IS NOT NULL)) AS rule FROM {LENGTHS} JOIN (SELECT doc_id AS d, text FROM documents) ON doc_id = d)"""
)
def executable_rules(read):
    known = executables.with_imports(executables.headers(made(read, program)), "key")
    return rules.matched(known, F.decode("body", "ISO-8859-1"), PE_RULES, "key", size=F.octet_length("body"), executable=F.struct("pe.*", "imports")).select("key", "rule")


def streams_of(i: int, text: bytes) -> bytes:
    """A compound file, with streams above and below the size from which they have sectors of their own."""
    from palimpsest.plans import containers_made

    return containers_made.compound({"One": text, "Two": b"two " + text[:50], "Three": noise(i, 700)})


@query("SELECT doc_id AS key, path, sha256(CASE path WHEN 'One' THEN text || repeat(chr(0), greatest(4096 - strlen(text), 0)) ELSE NULL END) AS sha256 FROM documents, (SELECT 'One' AS path)")
def compound_streams(read):
    found = compound.streams(made(read, streams_of).withColumnRenamed("key", "file")).where("path = 'One'")
    return found.select(F.col("file").alias("key"), "path", F.sha2("body", 256).alias("sha256"))


def archive(**members: bytes) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def nested(i: int, text: bytes) -> bytes:
    """The text in an archive in an archive, or a shortcut in one."""
    from palimpsest.plans import containers_made

    return archive(a=archive(b=text)) if i % 2 else archive(a=containers_made.shortcut(text))


@query(r"""SELECT doc_id AS doc, path, layer, sha256(body) AS sha256 FROM (
SELECT doc_id, 'a!b' AS path, 2 AS layer, text AS body FROM documents WHERE doc_id % 2 = 1 UNION ALL
SELECT doc_id, 'a!name', 2, 'name' FROM documents WHERE doc_id % 2 = 0 UNION ALL
SELECT doc_id, 'a!arguments', 2, array_to_string((regexp_extract_all(text, '[^ 	-
]+'))[1:5], ' ') FROM documents WHERE doc_id % 2 = 0)""")
def nested_members(read):
    found = inspection.unfolded(made(read, nested).withColumnRenamed("key", "doc")).where("layer = 2")
    return found.select("doc", "path", "layer", F.sha2("body", 256).alias("sha256"))


def carrier(i: int, text: bytes) -> bytes:
    """A script in an archive in an object of a rich text in an archive."""
    import re

    word = (re.search(rb"[A-Za-z]+", text) or [b""])[0]
    script = b'x = StrReverse("' + (b"run me " + word)[::-1] + b'")'
    return archive(a=b"{\\rtf1 {\\objdata " + archive(s=script).hex().encode() + b"}}")


@query(
    r"""WITH w AS (SELECT doc_id AS doc, 'run me ' || regexp_extract(text, '[A-Za-z]+') AS said FROM documents)
SELECT doc, 3 AS pos, 'zip' AS kind, 'a!object0!s' AS path, 'content' AS channel, sha256('x = StrReverse("' || reverse(said) || '")') AS sha256 FROM w
UNION ALL SELECT doc, 4, 'decoded', 'strreverse', 'content', sha256(said) FROM w WHERE strlen(said) >= 8"""
)
def inspected_streams(read):
    found = inspection.inspected(made(read, carrier).withColumnRenamed("key", "doc"), F.lit(NOW).cast("timestamp"))
    return found.where("pos >= 3").select("doc", "pos", "kind", "path", "channel", F.sha2("body", 256).alias("sha256"))


def summary(template: bytes, app: bytes, revision: bytes, ticks: int, security: int) -> bytes:
    """A summary stream with five properties."""
    text = lambda b: struct.pack("<II", 0x1E, len(b) + 1) + b + b"\0" + b"\0" * (-(len(b) + 1) % 4)
    values = [(0x07, text(template)), (0x12, text(app)), (0x09, text(revision)), (0x0A, struct.pack("<IQ", 0x40, ticks)), (0x13, struct.pack("<II", 3, security))]
    table, body, at = b"", b"", 8 + 8 * len(values)
    for ident, value in values:
        table += struct.pack("<II", ident, at + len(body))
        body += value
    section = struct.pack("<II", at + len(body), len(values)) + table + body
    return struct.pack("<HHI", 0xFFFE, 0, 0) + b"\0" * 16 + struct.pack("<I", 1) + b"\0" * 16 + struct.pack("<I", 48) + section


def described(i: int, text: bytes) -> bytes:
    from palimpsest.plans import containers_made

    n = len(text)
    return containers_made.compound({"\x05SummaryInformation": summary(b"\\\\host\\t.dot" if n % 2 else b"Normal.dotm", b"Microsoft Equation " + text[:5] if n % 3 == 0 else b"Word", b"1" if n % 5 == 0 else b"12", 0 if n % 7 == 0 else n, n % 4), "Body": text})


@query(f"SELECT doc_id AS key, unnest(list_filter([CASE WHEN n % 2 = 1 THEN 'OLE-META TEMPLATE-INJECTION' END, CASE WHEN n % 3 = 0 THEN 'OLE-META APPNAME-EQUATION' END, CASE WHEN n % 5 = 0 THEN 'OLE-META REVISION' END, CASE WHEN n % 7 = 0 THEN 'OLE-META EDIT-TIME' END, CASE WHEN n % 4 > 0 THEN 'OLE-DOC-SECURITY-' || n % 4 END], lambda x: x IS NOT NULL)) AS marker FROM {LENGTHS}")
def compound_summaries(read):
    found = compound.streams(made(read, described).withColumnRenamed("key", "file")).where(F.endswith("path", F.lit("SummaryInformation")))
    return structure.summary_markers(compound.summaries(found.select(F.col("file").alias("key"), "body")))


#: Three tables made by a rule: odd multipliers permute the substituted characters.
SUBSTITUTED = [9, *(c for c in range(32, 128) if c not in scripts.PLAIN)]


def tables() -> scripts.Tables:
    n = len(SUBSTITUTED)
    made = [bytearray(range(128)) for _ in range(3)]
    for table, step in zip(made, (5, 7, 11), strict=True):
        for i, c in enumerate(SUBSTITUTED):
            table[c] = SUBSTITUTED[(i * step + 3) % n]
    return tuple(map(bytes, made))


def encoded_block(text: bytes) -> bytes:
    """What :func:`palimpsest.operators.scripts.decoded` undoes, a character after the other."""
    back = [{clear: c for c, clear in enumerate(t) if c in SUBSTITUTED} for t in tables()]
    escapes = {v[0]: k for k, v in scripts.ESCAPES.items()}
    out, place = bytearray(), 0
    for c in text:
        if c in escapes:
            out += escapes[c]
            continue
        out.append(back[scripts.SCHEDULE[place % 64]].get(c, c) if c < 128 else c)
        place += c < 128
    return b"junk " + scripts.START.encode() + b"AAAAAA==" + bytes(out) + scripts.END.encode() + b" tail"


@query("SELECT doc_id AS key, sha256(text) AS sha256 FROM documents WHERE text <> ''")
def encoded_scripts(read):
    """Every whole text encoded and decoded again."""
    found = made(read, lambda i, t: encoded_block(t)).select("key", F.explode(scripts.encoded_scripts(F.col("body"), tables())).alias("clear"))
    return found.select("key", F.sha2("clear", 256).alias("sha256"))


def keyed(text: bytes) -> bytes:
    """A run that carries its key: groups of ten, of digits and letters, a key of three digits."""
    key, width = 101 + len(text) % 800, 10
    one = {c: f"{c * key + c % key % 7:06d}ZqXy" for c in set(text)}
    groups = "".join(map(one.__getitem__, text))
    half = len(groups) // 2 // width * width  # the key goes to the middle: pad with blanks' groups on the shorter side
    rest = groups[half:]
    while len(rest) > half:
        groups, half = f"{32 * key:06d}ZqXy" + groups, half + width
    inner = groups[:half] + f"{key:03d}".rjust(width, "K") + groups[half:]
    middle = len(inner) // 2
    return b'x = "' + ("pad0" + inner[:middle] + "05" + "15" + inner[middle:] + "end0").encode() + b'"'


@query("SELECT doc_id AS key, sha256(CASE WHEN strlen(w) % 2 = 1 THEN ' ' || w ELSE w END) AS sha256 FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS w FROM documents) WHERE w <> ''")
def decode_keyed_digits(read):
    """Every whole text's printable characters."""
    import re

    rows = made(read, lambda i, t: keyed(re.sub(rb"[^ -~]", b"", t)))
    said = F.posexplode_outer(encodings.keyed_digits(F.decode("body", "ISO-8859-1"))).alias("pos", "said")  # a plain explode decodes once more to leave empty rows out
    return rows.select("key", said).where("pos IS NOT NULL").select("key", F.sha2("said", 256).alias("sha256"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '[\r\n\^]', ' ', 'g') AS t FROM documents)
SELECT doc_id, 0 AS pos, 'words.vbs' AS name, sha256(replace(t, ' ', chr(13) || chr(10)) || chr(13) || chr(10) || '>>"tail.txt" said & done') AS sha256 FROM d UNION ALL
SELECT doc_id, 1, 'tail.txt', sha256(doc_id || chr(13) || chr(10) || chr(13) || chr(10) || 'end^') FROM d""")
def batch_files(read):
    """A script that writes each document's words line by line within a block, and a second file by redirections."""
    clean = F.regexp_replace("text", r"[\r\n\^]", " ")
    words = F.array_join(F.transform(F.split(clean, " "), lambda w: F.concat(F.lit("  ECHO "), w)), "\r\n")
    tail = F.concat(F.lit('\r\n)\r\n>>"tail.txt" echo '), F.col("doc_id").cast("string"), F.lit('\r\n>> tail.txt echo.ignored\r\necho end^^ >> tail.txt\r\n'))
    script = F.concat(F.lit('@echo off\r\n>"words.vbs" (\r\n'), words, F.lit('\r\nrem skipped\r\n>>"tail.txt" echo skipped\r\necho ^>^>"tail.txt" said ^& done'), tail)
    found = droppers.dropped_files(read("documents").select("doc_id", "text").repartition("doc_id").select(F.col("doc_id").alias("key"), script.alias("text")))
    return found.select(F.col("key").alias("doc_id"), "pos", "name", F.sha2("body", 256).alias("sha256"))


def workbook(i: int, text: bytes) -> bytes:
    """A workbook of many records: a macro sheet named by the text's first letters, hidden or not, and a built-in name."""
    from palimpsest.plans import containers_made

    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    name = b"s%d" % i
    sheet = struct.pack("<IBBBB", 0, i % 4, i % 2, len(name), i % 3 == 0) + (name.decode().encode("utf-16-le") if i % 3 == 0 else name)
    builtin = struct.pack("<HBB", 0x20, 0, 1) + b"\0" * 10 + bytes([1 + i % 5]) + b"rest"
    cells = b"".join(record(0x06, text[k : k + 100]) for k in range(0, len(text), 100))
    return containers_made.compound({"Workbook": record(0x809, b"\0\6\5\0") + cells + record(0x85, sheet) + record(0x18, builtin) + record(0x0A, b"")})


@query("""SELECT doc_id AS key, 'XLM-HIDDEN-MACROSHEET ' || (CASE doc_id % 4 WHEN 1 THEN 'hidden' ELSE 'veryHidden' END) || ' s' || doc_id AS marker FROM documents WHERE doc_id % 4 IN (1, 2) AND doc_id % 2 = 1
UNION ALL SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'XLM-AUTO-OPEN' ELSE 'XLM-AUTO-CLOSE' END FROM documents WHERE doc_id % 5 < 2""")
def hidden_macro_sheets(read):
    found = compound.streams(made(read, workbook).withColumnRenamed("key", "file"))
    return workbooks.macro_markers(found.select(F.col("file").alias("key"), "path", "body"))


@query("SELECT doc_id AS key, sha256('x' || text || repeat('y', 600)) AS sha256 FROM documents")
def compound_extra_data(read):
    """Bytes behind the last sector of a compound file of each text."""
    files = made(read, lambda i, text: streams_of(i, text[:20]) + b"x" + text + b"y" * 600)
    found = compound.extra_data(files.withColumnRenamed("key", "file"))
    return found.select(F.col("file").alias("key"), F.sha2("body", 256).alias("sha256"))
