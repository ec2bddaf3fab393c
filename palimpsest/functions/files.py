"""Names, extensions and kinds of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import markers

#: Leading bytes by kind, in the order they are tried.
MAGICS = (
    ("ole2", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"),
    ("zip", b"PK\x03\x04"),
    ("gzip", b"\x1f\x8b"),
    ("7z", b"7z\xbc\xaf\x27\x1c"),
    ("rar", b"Rar!\x1a\x07"),
    ("cab", b"MSCF"),
    ("lnk", bytes.fromhex("4C0000000114020000000000C000000000000046")),
    ("onenote", bytes.fromhex("E4525C7B8CD8A74DAEB15378D02996D3")),
    ("onenote", bytes.fromhex("A12FFF43D9EF764C9EE210EA5722765F")),
    ("tnef", b"\x78\x9f\x3e\x22"),
)
#: What marks a spreadsheet in XML within its first 512 characters.
SHEET_XML = ('progid="Excel.Sheet"', "urn:schemas-microsoft-com:office:spreadsheet")
#: Fixed value: extensions that promise harmless content.
BENIGN = (".txt", ".text", ".log", ".csv", ".rtf", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".pdf", ".html", ".htm", ".xml", ".json", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".dat", ".bin", ".tmp")


def latin1(body: Column) -> Column:
    return F.decode(body, "ISO-8859-1")


def kind(body: Column) -> Column:
    """What a binary column holds, judged by its first bytes."""
    text = latin1(F.substring(body, 1, 1024))
    out = F.when(F.lit(False), "")
    for name, magic in MAGICS[:6]:
        out = out.when(F.startswith(text, F.lit(magic.decode("latin-1"))), name)
    out = out.when(F.contains(text, F.lit("%PDF-")), "pdf").when(text.rlike(r"^(?:ï»¿)?[\x09-\x0d\x20]*\{\\rt"), "rtf")
    for name, magic in MAGICS[6:]:
        out = out.when(F.startswith(text, F.lit(magic.decode("latin-1"))), name)
    head = F.substring(F.regexp_replace(text, "^ï»¿", ""), 1, 512)
    sheet = F.startswith(head, F.lit("<")) & reduce(lambda a, b: a | b, [F.contains(head, F.lit(s)) for s in SHEET_XML])
    exe, elf = F.coalesce(markers.executable_at_start(body), F.lit(False)), is_elf(body)
    out = out.when(text.rlike(r"^(?:ï»¿)?ID;"), "sylk").when(sheet, "spreadsheet_xml").when(exe, "pe").when(elf, "elf")
    return out.when(F.substring(text, 258, 5) == "ustar", "tar").otherwise("none")


def is_elf(body: Column) -> Column:
    """The magic, 32 or 64 bits, either byte order, and one of the four types of objects."""
    digits = F.hex(F.substring(body, 1, 18))
    low, high = F.substring(digits, 33, 2), F.substring(digits, 35, 2)
    kind = F.when(F.substring(digits, 11, 2) == "01", F.concat(high, low)).otherwise(F.concat(low, high))
    return F.coalesce(digits.rlike("^7F454C46(01|02)(01|02)") & kind.isin("0001", "0002", "0003", "0004"), F.lit(False))


def base_name(name: Column) -> Column:
    """After the last slash or backslash, without control characters and outer blanks, at most 255 bytes."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[\x00-\x1f\x7f]", ""))
    cut = F.regexp_replace(F.decode(F.substring(F.encode(bare, "UTF-8"), 1, 255), "UTF-8"), "\ufffd+$", "")
    return F.when(F.octet_length(bare) > 255, cut).otherwise(bare)


def extension(name: Column) -> Column:
    """Lower case with its dot; none for a name that starts or ends with its only dot."""
    return F.lower(F.regexp_extract(base_name(name), r"^.+(\.[^.]+)$", 1))


def file_type(ext: Column) -> Column:
    return F.when(ext.isin(".msg", ".oft"), "outlook").otherwise("")


def mismatch(ext: Column, actual: Column) -> Column:
    """``type:extension``, without the dot, where a harmless extension hides a carrier. ``actual`` is rtf, msi, lnk,
    onenote, ole-package or office-doc; each may have its own extensions; other kinds never differ."""
    own = F.when(actual == "rtf", ext == ".rtf").otherwise(F.lit(False))
    return F.when(F.lower(ext).isin(*BENIGN) & actual.isin("rtf", "msi", "lnk", "onenote", "ole-package", "office-doc") & ~own, F.concat(actual, F.lit(":"), F.regexp_replace(F.lower(ext), r"^\.", "")))


def name_tokens(name: Column, most: int = 6) -> Column:
    """Parts of a name that may be passwords: 3 to 32 characters, the first six."""
    stem = F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", "")
    return F.slice(F.filter(F.split(stem, r"[ _\-.()\[\]]"), lambda t: (F.length(t) >= 3) & (F.length(t) <= 32)), 1, most)


#: Fixed value: statements of a password, the password in group 1.
PASSWORD = r"""(?i)\b(?:password|passwort|wachtwoord|senha|contrase|pass|pwd|pw|code)(?:\s+is\s+|[\s:=]+)([^\s,;"'<>]{1,64})"""


def stated_passwords(text: Column, most: int = 32, longest: int = 64) -> Column:
    """Different passwords stated in the first 64 Ki characters, in order of their first statement."""
    found = F.regexp_extract_all(F.substring(text, 1, 1 << 16), F.lit(PASSWORD), 1)
    return F.slice(F.array_distinct(F.filter(found, lambda c: F.octet_length(c) <= longest)), 1, most)


def header_candidates(header: Column, most: int = 32, longest: int = 64) -> Column:
    """Lines of a base64 header: without control characters and outer blanks, different, not too long."""
    lines = F.split(F.decode(F.try_to_binary(header, F.lit("base64")), "UTF-8"), "\n")
    clean = F.transform(lines, lambda c: F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")))
    return F.slice(F.array_distinct(F.filter(clean, lambda c: (c != "") & (F.octet_length(c) <= longest))), 1, most)


def candidates_in_order(*lists: Column, most: int = 64) -> Column:
    """Candidates of several lists: trimmed, different, the first ``most``."""
    joined = F.transform(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda c: F.trim(c))
    return F.slice(F.array_distinct(F.filter(joined, lambda c: c != "")), 1, most)


def filetime(ticks: Column) -> Column:
    """Tenths of microseconds since 1601 as a timestamp; null for 0."""
    return F.when(ticks != 0, F.timestamp_micros(F.floor(ticks / 10) - F.lit(11_644_473_600_000_000)))


def cache_key(fingerprint: Column, name: Column, ext: Column, kind: Column, level: Column, body: Column, passwords: Column | None = None) -> Column:
    """What a verdict is cached under: the rules, what rules may read of the file, candidates for its password in their
    order, where there are any, and the body's digest."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = F.concat_ws("\0", blank(name), blank(ext), blank(kind), blank(level))
    if passwords is not None:
        tried = F.concat(F.lit("\0pw:"), F.substring(F.sha2(F.array_join(passwords, "\0"), 256), 1, 16))
        parts = F.concat(parts, F.when(F.size(passwords) > 0, tried).otherwise(""))
    return F.concat(fingerprint, F.lit(":"), parts, F.lit(":"), F.sha2(body, 256))


def header_value(text: Column, longest: int) -> Column:
    """Fit for a mail header: no control characters, not too long."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]", ""), 1, longest)
