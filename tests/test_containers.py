"""Formats are built here from their published layouts and opened again."""

import gzip
import io
import struct
import tarfile
import zipfile

from palimpsest.operators import containers
from palimpsest.operators.containers import Budget, unfolded


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors with streams of at least 4096 bytes, and one small stream."""
    sectors, fat, entries = [], [], []

    def put(data):
        start, n = len(fat), -(-len(data) // 512)
        sectors.extend(data[k * 512 : k * 512 + 512].ljust(512, b"\0") for k in range(n))
        fat.extend([*range(start + 1, start + n), 0xFFFFFFFE])
        return start

    small = b"".join(d.ljust(-(-len(d) // 64) * 64, b"\0") for d in streams.values() if len(d) < 4096)
    mini_fat, at = [], 0
    entry = lambda name, kind, right, child, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", len(name) * 2 + 2, kind, 1, 0xFFFFFFFF, right, child)).ljust(116, b"\0") + struct.pack("<IQ", start, size)
    for i, (name, data) in enumerate(streams.items()):
        right = i + 2 if i + 1 < len(streams) else 0xFFFFFFFF
        if len(data) >= 4096:
            entries.append(entry(name, 2, right, 0xFFFFFFFF, put(data), len(data)))
        else:
            n = -(-len(data) // 64)
            entries.append(entry(name, 2, right, 0xFFFFFFFF, at, len(data)))
            mini_fat += [*range(at + 1, at + n), 0xFFFFFFFE]
            at += n
    root = entry("Root Entry", 5, 0xFFFFFFFF, 1, put(small), len(small))
    mini_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff"))
    directory = put(b"".join([root, *entries]))
    fat_at = len(fat)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = containers.CFB_MAGIC.ljust(24, b"\0") + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6)
    head = head.ljust(44, b"\0") + struct.pack("<IIIIIIII", 1, directory, 0, 4096, mini_start, 1, 0xFFFFFFFE, 0)
    return (head + struct.pack("<I", fat_at)).ljust(512, b"\xff") + b"".join(sectors)


def test_compound_file():
    streams = {"big": bytes(range(256)) * 20, "small": b"hello", "other": b"y" * 100}
    assert {p: b for p, _, _, b in unfolded(compound(streams), Budget())} == streams


def test_macro_source():
    packed = bytes.fromhex("012FB000236161616263646582660070616768696A013808616B6C00306D6E6F700671027004107273747576107778797A003C")
    assert containers.vba_decompressed(packed) == b"#aaabcdefaaaaghijaaaaaklaaamnopqaaaaaaaaaaaarstuvwxyzaaa"
    assert containers.vba_decompressed(b"") == containers.vba_decompressed(b"\x00abc") == b""


def test_nested_members_and_budget():
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("two.txt", "2")
    outer = io.BytesIO()
    with tarfile.open(fileobj=outer, mode="w") as t:
        info = tarfile.TarInfo("in.zip")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))
    found = [(p, k, layer) for p, k, layer, _ in unfolded(gzip.compress(outer.getvalue()), Budget())]
    assert found == [("content", "gzip", 1), ("content!in.zip", "tar", 2), ("content!in.zip!one.txt", "zip", 3), ("content!in.zip!two.txt", "zip", 3)]
    assert len(list(unfolded(gzip.compress(outer.getvalue()), Budget(members=2)))) == 2


def test_damage_yields_fewer_rows():
    for body in (b"", b"PK\x03\x04broken", b"\x1f\x8bbroken", containers.CFB_MAGIC, containers.CFB_MAGIC + b"\xff" * 600, b"%PDF-1.4 <<>> stream\n", b"{\\rtf1 \\objdata zz}"):
        list(unfolded(body, Budget()))


def test_null_bodies_and_no_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"{\\rt\\objdata 6869}"))], "k long, body binary")
    got = containers.extracted(rows, "k").collect()
    assert [(r.key, r.path, bytes(r.body)) for r in got] == [(2, "object0", b"hi")]
    assert containers.extracted(rows.limit(0), "k").count() == 0
