"""Structural markers: what a document's markup, cells or dictionaries give away, as arrays of strings.

Texts hold one byte a character. Nulls give null, empty texts no markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import encodings

#: Calls that build files within a page; how much of a page is read, how many data URIs count.
BLOB_CALLS = ("createObjectURL", "msSaveBlob", "msSaveOrOpenBlob", "new Blob")
PAGE, DATA_URIS = 1 << 20, 8
DOWNLOAD = r'(?i)(?:\s|;|"|\.)download\s*='
DATA_URI = r"(?i)data:[a-z0-9.+/-]*;base64,([A-Za-z0-9+/=\s]+)"
NONE = "array<string>"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def when_markers(*pairs: tuple[Column, str]) -> Column:
    """The markers whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in pairs]), lambda m: m.isNotNull())


def data_uris(text: Column) -> Column:
    """Decoded base64 data URIs of the first MiB: 16 digits at least and a length that base64 can have."""
    bare = F.transform(F.regexp_extract_all(F.substring(text, 1, PAGE), F.lit(DATA_URI), 1), lambda d: F.regexp_replace(d, r"[\n\r \t]", ""))
    fit = F.filter(F.slice(bare, 1, 2 * DATA_URIS), lambda d: (F.length(d) >= 16) & (F.length(d) % 4 == 0) & d.rlike("^[A-Za-z0-9+/]+={0,2}$"))
    return F.transform(fit, F.unbase64)


def html_smuggling(text: Column) -> Column:
    """Markers of pages that build a file for the reader: script blobs with a forced download, data URIs, scripted or
    loaded SVG."""
    head = F.substring(text, 1, PAGE)
    low = F.lower(head)
    markup = F.when(F.contains(head, F.lit("<")), any_of(low, ("<script", "<svg", "<a ", "download")) | any_of(head, ("Blob", "data:"))).otherwise(any_of(head, ("Blob", "data:")))
    download = head.rlike(DOWNLOAD) | F.contains(head, F.lit(".click("))
    svg = F.contains(low, F.lit("<svg"))
    uris = data_uris(text)
    containers = F.exists(uris, encodings.container_magic)
    found = when_markers(
        (any_of(head, BLOB_CALLS) & download, "HTML-SMUGGLING-BLOB"),
        (svg & any_of(low, ("<script", "onload=", "<foreignobject")), "SVG-SCRIPT"),
        (svg & containers, "SVG-EMBEDDED-PAYLOAD"),
        (~svg & download & (F.size(uris) > 0), "HTML-SMUGGLING-DATAURI"),
        (~svg & ~download & containers, "HTML-DATAURI-CONTAINER"),
    )
    return F.when(markup, found).otherwise(F.when(text.isNotNull(), F.array().cast(NONE)))


#: Names of a PDF that act by themselves or hide things, with their markers.
PDF_NAMES = (("PDF-AA-ACTION", "AA"), ("PDF-LAUNCH", "Launch"), ("PDF-EMBEDDEDFILE", "EmbeddedFile"), ("PDF-JBIG2", "JBIG2Decode"), ("PDF-OBJSTM", "ObjStm"))


def pdf_scrubbed(text: Column) -> Column:
    """A PDF without stream bodies, comments, hexadecimal and literal strings (two levels of brackets)."""
    out = F.regexp_replace(text, r"(?s)stream\r?\n.*?endstream", "stream endstream")
    out = F.regexp_replace(out, r"%(?!PDF-)[^\r\n]*", " ")
    out = F.regexp_replace(out, r"(?s)\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*+\))*+\)", "()")
    return F.regexp_replace(out, r"(?<!<)<[0-9A-Fa-f\s]*>(?!>)", "<>")


def pdf_indicators(text: Column) -> Column:
    """Markers by whole names (followed by a delimiter or the end), with #xx in names undone."""
    scrubbed = pdf_scrubbed(text)
    hidden = scrubbed.rlike(r"/[^\s()<>\[\]{}/%]*#[0-9A-Fa-f]{2}")
    plain = F.array_join(F.transform(F.split(F.regexp_replace(scrubbed, r"#([0-9A-Fa-f]{2})", "\x01$1\x01"), "\x01"), lambda p: F.when(p.rlike("^[0-9A-Fa-f]{2}$"), F.decode(F.unhex(p), "ISO-8859-1")).otherwise(p)), "")
    name = lambda n: plain.rlike(rf"/{n}(?=[ \t\r\n\f\x00()<>\[\]{{}}/%]|$)")
    pairs = [(hidden, "PDF-HEXOBFUSC"), (name("OpenAction") & (name("JS") | name("JavaScript")), "PDF-OPENACTION-JS")]
    return when_markers(*pairs, *[(name(n), m) for m, n in PDF_NAMES])


#: Lines and hits that count, the longest cell that is shown.
CSV_LINES, CSV_HITS, CSV_CELL = 65536, 64, 4096
CELL = r'(?:^|{0})((?:[^"{0}]++|"[^"]*+(?:"|$))*+)'


def is_injection(cell: Column) -> Column:
    """Starts with = + - or @ and has, outside quotes of either kind, a bar that isn't its second character and an
    exclamation mark after it."""
    bare = F.regexp_replace(cell, r"""(?s)(?<=.)(?:'[^']*+(?:'|$)|"[^"]*+(?:"|$))""", "q")
    return cell.rlike(r"^[=+@-]") & bare.rlike(r"(?s)^..[^|]*\|[^!]*!")


def csv_cells(line: Column) -> Column:
    """Cells of a line cut at commas (at tabs, if there is no comma) outside quotes, unquoted and trimmed."""
    cut = lambda d: F.regexp_extract_all(line, F.lit(CELL.format(d)), 1)
    cells = F.when(~F.contains(line, F.lit(",")) & F.contains(line, F.lit("\t")), cut("\t")).otherwise(cut(","))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    unquote = lambda c: F.when(c.rlike(r'(?s)^".*"$') & (F.length(c) >= 2), trim(F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')))).otherwise(c)
    return F.transform(cells, lambda c: unquote(trim(c)))


def csv_injections(text: Column) -> Column:
    """``CSV-DDE`` and the cell, for each cell of delimited text that would start a command."""
    body = F.regexp_replace(text, "^ï»¿", "")
    lines = F.slice(F.split(body, "\n"), 1, CSV_LINES)
    cells = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("|")) & F.contains(x, F.lit("!"))), lambda x: csv_cells(F.rtrim(x, F.lit("\r")))))
    return F.slice(F.transform(F.filter(cells, is_injection), lambda c: F.concat(F.lit("CSV-DDE "), F.substring(c, 1, CSV_CELL))), 1, CSV_HITS)


def unescaped_xml(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def spreadsheet_xml_injections(text: Column) -> Column:
    """The same in formulas and data of a spreadsheet in XML."""
    formulas = F.regexp_extract_all(text, F.lit(r"""(?i)\bformula\s*=\s*(?:"([^"]*+)"|'[^']*+')"""), 1)
    data = F.regexp_extract_all(text, F.lit(r"(?is)<(?:\w+:)?data\b[^>]*+>([^<]*+)</"), 1)
    cells = F.transform(F.concat(formulas, data), lambda c: F.regexp_replace(unescaped_xml(c), r"^\s+|\s+$", ""))
    return F.slice(F.transform(F.filter(cells, is_injection), lambda c: F.concat(F.lit("CSV-DDE "), F.substring(c, 1, CSV_CELL))), 1, CSV_HITS)


def sylk_expressions(text: Column) -> Column:
    """The expression fields of a SYLK file's C records; a doubled semicolon is one semicolon of a field."""
    body = F.regexp_replace(text, "^ï»¿", "")
    records = F.filter(F.transform(F.split(body, "\n"), lambda x: F.rtrim(x, F.lit("\r"))), lambda x: F.startswith(x, F.lit("C;")))
    fields = lambda r: F.transform(F.split(F.replace(r, F.lit(";;"), F.lit("\x01")), ";"), lambda f: F.replace(f, F.lit("\x01"), F.lit(";")))
    first = lambda r: F.get(F.filter(fields(r), lambda f: f.rlike("^[Ee]")), F.lit(0))
    return F.filter(F.transform(records, lambda r: F.trim(F.substring(first(r), F.lit(2), F.length(first(r))))), lambda f: F.coalesce(f != "", F.lit(False)))


def sylk_injections(text: Column) -> Column:
    return F.transform(F.filter(sylk_expressions(text), lambda f: is_injection(F.when(F.startswith(f, F.lit("=")), f).otherwise(F.concat(F.lit("="), f)))), lambda f: F.concat(F.lit("SLK-DDE "), f))


#: Functions of macro formulas that start, open or send something.
VERBS = ("EXEC", "EXECUTE", "INITIATE", "CALL", "REGISTER", "FOPEN", "FWRITE", "HALT", "OPEN", "SEND.KEYS")


def verb_markers(formula: Column) -> Column:
    """A marker for each dangerous function that a folded formula calls."""
    upper = F.upper(formula)
    hits = F.filter(F.array(*map(F.lit, VERBS)), lambda v: F.contains(upper, F.concat(F.lit("="), v, F.lit("("))))
    return F.transform(hits, lambda v: F.concat(F.lit("XLM-DANGEROUS-FUNC "), v))


def rtf_markers(text: Column) -> Column:
    """Fields that talk to other programs, and objects that update themselves."""
    return when_markers((text.rlike(r"(?is)\\fldinst\b[^}]{0,256}?\bDDE(?:AUTO)?\b"), "RTF-DDE-FIELD"), (F.contains(text, F.lit("\\objupdate")), "RTF-OBJUPDATE"))


def printable_strings(body: Column, least: int = 8) -> Column:
    """Runs of printable characters of bytes: one byte each, or two with a zero on either side."""
    text = F.decode(body, "ISO-8859-1")
    runs = F.regexp_extract_all(text, F.lit(rf"[\x20-\x7e]{{{least},}}"), 0)
    wide = F.transform(F.regexp_extract_all(text, F.lit(rf"(?:[\x20-\x7e]\x00){{{least},}}|(?:\x00[\x20-\x7e]){{{least},}}"), 0), lambda r: F.replace(r, F.lit("\x00"), F.lit("")))
    values = F.filter(F.transform(runs, lambda r: F.regexp_extract(r, r"^[A-Za-z_][\w.]*=(.{4,})$", 1)), lambda v: v != "")
    return F.array_distinct(F.concat(runs, wide, values))


def executable_at_start(body: Column) -> Column:
    """``MZ``, and ``PE`` where the header says."""
    at = F.conv(F.concat(*[F.hex(F.substring(body, i, 1)) for i in (64, 63, 62, 61)]), 16, 10).cast("long")
    inside = F.when(at < F.octet_length(body), at).otherwise(F.lit(0)).cast("int")
    return (F.hex(F.substring(body, 1, 2)) == "4D5A") & (F.octet_length(body) >= 64) & (F.hex(F.substring(body, inside + 1, F.lit(4))) == "50450000")


def binary_markers(body: Column) -> Column:
    """An executable that is also a zip archive, and one that a spreadsheet program loads."""
    text = F.decode(body, "ISO-8859-1")
    exe = F.coalesce(executable_at_start(body), F.lit(False))
    archive = F.contains(text, F.lit("PK\x03\x04")) & F.contains(text, F.lit("PK\x05\x06"))
    return when_markers((exe & archive, "POLYGLOT-PE-ZIP"), (exe & F.contains(text, F.lit("xlAutoOpen")), "XLL-ADDIN"))


#: A document's own markers, and beginnings of those with a number or what was carved behind them.
PURE = ("USERFORM-STRINGS", "DOCPROPS-STRINGS", "OLEID-OBJECTPOOL", "OLEID-FLASH", "OLEID-VBA-PRESENT", "OLEID-EXTREL", "OLEID-DDE", "OLEID-XLM-PRESENT", "PPT-VBA-EXTRACTED", "RTF-OBJUPDATE", "DEFAULTPW-DECRYPTED", "DIGITAL-SIGNATURE", "ENCRYPTION-AES", "ENCRYPTION-RC4", "ENCRYPTION-XOR", "XLM-AUTO-OPEN", "XLM-AUTO-CLOSE", "HTML-SMUGGLING-BLOB", "HTML-SMUGGLING-DATAURI", "HTML-DATAURI-CONTAINER", "SVG-SCRIPT", "SVG-EMBEDDED-PAYLOAD", "ARCHIVE-ENCRYPTED", "ARCHIVE-DECRYPTED", "POLYGLOT-PE-ZIP", "XLL-ADDIN", "BASE64-PE-CARVE", "PE-SECTION-PACKED", "PE-SECTION-HIGH-ENTROPY", "PE-OVERLAY", "PE-VIRTUAL-SECTION", "PE-DOTNET", "PE-ANOMALY", "ELF-EXECUTABLE")
PURE_PREFIXES = ("MSD-DEEPDECODE depth=", "OLE-DOC-SECURITY-", "OLE-META\n", "DOCPROPS-STRINGS\n", "USERFORM-STRINGS\n", "XLM-STACK\n", "MALDOC-BEHAVIOR-SCORE n=")


def channel(stream: Column) -> Column:
    """``marker`` for what only this engine writes, else ``content``."""
    pure = stream.isin(*PURE) | F.exists(F.array(*map(F.lit, PURE_PREFIXES)), lambda p: F.startswith(stream, p))
    return F.when(pure, "marker").otherwise("content")
