"""Finding and undoing encodings, on text that holds one byte a character."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shortest runs that count.
BASE64_RUN, HEX_RUN, ESCAPES, DECIMALS, NETBIOS_RUN, BASE32_RUN = 24, 32, 8, 12, 32, 32
BASE64 = rf"[A-Za-z0-9+/]{{{BASE64_RUN},}}={{0,2}}"
HEX = rf"(?:[0-9A-Fa-f]{{2}}){{{HEX_RUN // 2},}}"
X_ESCAPES = rf"(?:\\x[0-9A-Fa-f]{{2}}){{{ESCAPES},}}"
AMP_ESCAPES = rf"(?:&[Hh][0-9A-Fa-f]{{2}}){{{ESCAPES},}}"
U_ESCAPES = rf"(?:[\\%]u[0-9A-Fa-f]{{4}}){{{ESCAPES},}}"
DECIMAL = rf"[0-9][0-9;,]{{{2 * DECIMALS - 2},}}"
NETBIOS = rf"[A-P]{{{NETBIOS_RUN},}}"
#: What makes it worth while to turn a text round.
REVERSED = ("llehsrewop", "llehs.tpircsw", "tcejboetaerc", "exe.dmc", "elifotevas", "ptthnwod")
MAYBE = r"[A-Za-z0-9+/]{20,}|[0-9,;]{23,}|(?i)\\x|\\u|%u|&h|chr|replace\(|array\(|strreverse|environ|" + "|".join(re.escape(r) for r in REVERSED)
KEYED, WIDEST = r'"(\p{Alnum}{20,})"', 16
BASE32 = rf"[A-Z2-7]{{{BASE32_RUN},}}={{0,6}}"
LITERAL = r'"([^"]*+(?:""[^"]*+)*+)"'
CHR = r"chrw?\((\d{1,5})\)"
CHAIN = rf"(?i)(?:{LITERAL}|{CHR})(?:\s*[&+]\s*(?:{LITERAL}|{CHR}))+"
CALLS = rf"(?i)\breplace\(\s*{LITERAL}|\barray\([0-9,\s]++\)\s*xor\s|strreverse\(\s*\"|environ\$?\(\s*\""
#: The least blob that counts, and how many and how much of them one source may give.
LEAST_BLOB, BLOB_BYTES, BLOBS, TOTAL_BYTES = 8, 1 << 20, 32, 4 << 20


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def may_be_encoded(text: Column) -> Column:
    """A cheap test that fails no text which a decoder would take within the first MiB, which is all it looks at."""
    head = F.substring(text, 1, 1 << 20)
    return head.rlike(MAYBE) | (F.contains(head, F.lit('"')) & (F.contains(head, F.lit("&")) | F.contains(head, F.lit("+"))))


def looks_encoded(text: Column) -> Column:
    """May be encoded, and some decoder's pattern is there (NETBIOS runs are not looked for)."""
    patterns = (BASE64, HEX, X_ESCAPES, AMP_ESCAPES, U_ESCAPES, DECIMAL, BASE32, KEYED, CHAIN, CALLS, r"(?i)" + "|".join(re.escape(r) for r in REVERSED))
    return may_be_encoded(text) & reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def emitted(blobs: Column) -> Column:
    """What a source may give: blobs of at least eight bytes, cut at a MiB, different, the first 32."""
    return F.slice(F.array_distinct(F.transform(F.filter(blobs, lambda b: F.octet_length(b) >= LEAST_BLOB), lambda b: F.substring(b, 1, BLOB_BYTES))), 1, BLOBS)


def mostly_text(text: Column) -> Column:
    """Nine of ten of the first 4096 characters are printable ASCII or tab, CR, LF."""
    head = F.substring(text, 1, 4096)
    return (F.length(head) > 0) & (F.length(F.regexp_replace(head, r"[^\t\n\r\x20-\x7e]", "")) * 100 >= F.length(head) * 90)


def base64_blobs(text: Column) -> Column:
    """Decoded base64 runs; runs of hex digits alone and lengths that can't be base64 are left out."""
    runs = F.filter(found(text, BASE64), lambda r: ~r.rlike("^[0-9A-Fa-f]+$"))
    bare = F.transform(runs, lambda r: F.rtrim(r, F.lit("=")))
    return F.transform(F.filter(bare, lambda r: F.length(r) % 4 != 1), lambda r: F.unbase64(F.rpad(r, (F.ceil(F.length(r) / 4) * 4).cast("int"), "=")))


def hex_blobs(text: Column) -> Column:
    return F.transform(found(text, HEX), F.unhex)


def escape_blobs(text: Column) -> Column:
    return F.transform(found(text, X_ESCAPES), lambda r: F.unhex(F.replace(r, F.lit("\\x"), F.lit(""))))


def netbios_blobs(text: Column) -> Column:
    """Two letters from A to P a byte; kept where the bytes are mostly text or begin like a container."""
    even = F.filter(found(text, NETBIOS), lambda r: F.length(r) % 2 == 0)
    blobs = F.transform(even, lambda r: F.unhex(F.translate(r, "ABCDEFGHIJKLMNOP", "0123456789ABCDEF")))
    return F.filter(blobs, lambda b: mostly_text(F.decode(b, "ISO-8859-1")) | container_magic(b))


def container_magic(body: Column) -> Column:
    """Begins like a zip archive, a compound file, an executable or a PDF."""
    return reduce(lambda a, b: a | b, [F.startswith(F.hex(F.substring(body, 1, 4)), F.lit(m.hex().upper())) for m in (b"PK\x03\x04", b"\xd0\xcf\x11\xe0", b"MZ", b"%PDF")])


def base32_blobs(text: Column) -> Column:
    """Runs with at least one digit and a length that base32 can have; eight letters are five bytes."""
    runs = F.transform(F.filter(found(text, BASE32), lambda r: r.rlike("[2-7]")), lambda r: F.rtrim(r, F.lit("=")))
    fit = F.filter(runs, lambda r: (F.length(r) % 8).isin(0, 2, 4, 5, 7))
    five = lambda g: F.lpad(F.conv(F.translate(g, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"), 32, 16), 10, "0")
    digits = lambda r: F.array_join(F.transform(F.regexp_extract_all(F.rpad(r, (F.ceil(F.length(r) / 8) * 8).cast("int"), "A"), F.lit(".{8}"), 0), five), "")
    return F.transform(fit, lambda r: F.substring(F.unhex(digits(r)), F.lit(1), F.floor(F.length(r) * 5 / 8).cast("int")))


def reversed_text(text: Column) -> Column:
    """The first MiB turned round, where a keyword stands in it backwards."""
    head = F.substring(text, 1, 1 << 20)
    return F.when(head.rlike("(?i)" + "|".join(re.escape(r) for r in REVERSED)), F.array(F.reverse(head))).otherwise(F.array().cast("array<string>"))


def unquoted(literal: Column) -> Column:
    return F.replace(literal, F.lit('""'), F.lit('"'))


def chained_literals(text: Column) -> Column:
    """Chains of literals and ``Chr(n)`` joined by ``&`` or ``+``, carried out; codes beyond Unicode are skipped."""
    token = rf"(?i){LITERAL}|{CHR}"

    def joined(chain: Column) -> Column:
        parts = F.arrays_zip(F.regexp_extract_all(chain, F.lit(token), 1).alias("words"), F.regexp_extract_all(chain, F.lit(token), 2).alias("code"))
        char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.array_join(F.transform(parts, lambda p: F.when(p["code"] == "", unquoted(p["words"])).otherwise(char(p["code"]))), "")

    return F.transform(F.slice(found(text, CHAIN), 1, 64), joined)


def decimal_texts(text: Column) -> Column:
    """Lists of at least twelve byte values with one kind of separator. Groups that repeat and vary in length
    would exhaust the stack of Java's matcher on long lists, so lists are found as runs and checked by item."""
    runs = F.transform(found(F.regexp_replace(text, "[;,]{2,}", " "), DECIMAL), lambda r: F.rtrim(r, F.lit(";,")))
    one_kind = F.filter(runs, lambda r: ~(F.contains(r, F.lit(",")) & F.contains(r, F.lit(";"))))
    lists = F.transform(one_kind, lambda r: F.transform(F.split(r, "[;,]"), lambda x: F.when(F.length(x) <= 3, x.cast("int"))))
    whole = F.filter(lists, lambda l: (F.size(l) >= DECIMALS) & F.forall(l, lambda x: F.coalesce(x <= 255, F.lit(False))))
    return F.transform(whole, lambda l: F.array_join(F.transform(l, F.char), ""))


def amp_blobs(text: Column) -> Column:
    """Runs of ``&HXX`` with or without commas and blanks between them."""
    joined = F.regexp_replace(text, r"[,\s]++(?=&[Hh])", "")
    return F.transform(found(joined, AMP_ESCAPES), lambda r: F.unhex(F.regexp_replace(r, "&[Hh]", "")))


def unicode_texts(text: Column) -> Column:
    r"""Runs of ``\uXXXX`` or ``%uXXXX`` as text; halves of pairs are joined."""
    return F.transform(found(text, U_ESCAPES), lambda r: F.decode(F.unhex(F.regexp_replace(r, r"[\\%]u", "")), "UTF-16BE"))


def reversed_literals(text: Column) -> Column:
    """Arguments of StrReverse, turned round."""
    return F.transform(F.regexp_extract_all(text, F.lit(r'(?i)strreverse\(\s*"([^"]*+)"\s*\)'), 1), F.reverse)


def replaced_literals(text: Column) -> Column:
    """``Replace("text", "old", "new")`` with all three given as literals, carried out."""
    call = rf"(?i)\breplace\(\s*{LITERAL}\s*,\s*{LITERAL}\s*,\s*{LITERAL}"
    parts = F.arrays_zip(*[F.transform(F.regexp_extract_all(text, F.lit(call), i), unquoted).alias(f"p{i}") for i in (1, 2, 3)])
    return F.transform(parts, lambda p: F.when(p["p2"] == "", p["p1"]).otherwise(F.replace(p["p1"], p["p2"], p["p3"])))


def xored_arrays(text: Column) -> Column:
    """``Array(1,2,...) Xor key``: low bytes of the items combined with the key, as hex."""
    call = r"(?i)\barray\(([0-9,\s]++)\)\s*xor\s+([0-9]{1,3})"
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(call), 1).alias("items"), F.regexp_extract_all(text, F.lit(call), 2).alias("key"))
    byte = lambda x, key: F.lpad(F.hex(F.trim(x).cast("long").bitwiseXOR(key.cast("long")).bitwiseAND(F.lit(255))), 2, "0")
    return F.transform(parts, lambda p: F.array_join(F.transform(F.split(p["items"], ","), lambda x: byte(x, p["key"])), ""))


def keyed_digits(text: Column) -> Column:
    """Quoted runs of letters and digits that carry their own key. Four characters at either end are padding. Around the
    middle stand two numbers of two characters each, whose difference is the width of a group; without these, the
    group in the middle is a key, and every other group, divided by it, is a character. Letters among digits count for
    nothing. A run of which any group isn't printable gives nothing."""
    words = lambda t: t.cast("string")  # noqa: E731 -- runs are bytes, as a place in a string is found by counting up to it
    digits = lambda t: F.regexp_replace(words(t), "[^0-9]", "")
    value = lambda d: F.when(d != "", d.cast("long"))  # noqa: E731 -- a group has at most 16 of them
    number = lambda t: F.when(words(t).rlike("[0-9]"), F.regexp_replace(words(t), "[^0-9]", "0").cast("int"))  # noqa: E731 -- here letters are zeros
    middle = lambda t, half, n: F.substring(t, half - n + 1, 2 * n)
    without = lambda t, half, n: F.concat(F.substring(t, F.lit(1), half - n), F.substring(t, half + n + 1, F.length(t)))
    halved = lambda t: F.struct(t.alias("t"), F.floor(F.length(t) / 2).cast("int").alias("half"))
    two = F.lit(2)
    runs = F.regexp_extract_all(text, F.lit(KEYED), 1)
    inner = F.transform(F.filter(runs, lambda r: r.rlike("[G-Zg-z]")), lambda r: halved(F.substring(r.cast("binary"), F.lit(5), F.octet_length(r) - 8)))
    sized = F.transform(inner, lambda x: F.struct(halved(without(x["t"], x["half"], two)).alias("x"), (number(F.substring(x["t"], x["half"] + 1, two)) - number(F.substring(x["t"], x["half"] - 1, two))).alias("width")))
    fit = F.filter(sized, lambda s: (s["width"] > 0) & (s["width"] <= WIDEST) & (F.length(s["x"]["t"]) > s["width"]))
    side = lambda s: F.floor(s["width"] / 2).cast("int")
    keyed = F.transform(fit, lambda s: F.struct(s["width"].alias("width"), value(digits(middle(s["x"]["t"], s["x"]["half"], side(s)))).alias("key"), without(s["x"]["t"], s["x"]["half"], side(s)).alias("t")))
    good = F.filter(keyed, lambda k: (k["key"] > 0) & (F.length(k["t"]) > 0))
    # groups are cut, and letters dropped, for a whole run at once: the cost of a group is that of its number
    marked = lambda k: F.regexp_replace(words(k["t"]), F.concat(F.lit("(?s).{1,"), k["width"].cast("string"), F.lit("}")), F.lit("$0,"))
    groups = lambda k: F.slice(F.split(F.regexp_replace(marked(k), r"\p{Alpha}++", ""), ","), F.lit(1), F.ceil(F.length(k["t"]) / k["width"]).cast("int"))  # noqa: E731 -- nothing stands behind the last comma
    codes = F.transform(good, lambda k: F.transform(groups(k), lambda g: F.call_function("div", value(g), k["key"])))
    printable = F.filter(codes, lambda c: F.forall(c, lambda x: F.coalesce((x >= 0x20) & (x <= 0x7E), F.lit(False))))
    return F.transform(printable, lambda c: F.array_join(F.transform(c, F.char), ""))


def environ_markers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r'(?i)\benviron\$?\(\s*"([^"]+)"\s*\)'), 1), lambda n: F.concat(F.lit("VBA-ENVIRON %"), n, F.lit("%")))


def transcoded(body: Column) -> Column:
    """UTF-16 as text, null for other bytes: with a mark, or, from sixteen bytes on, where of the first 4096 at least 60 of
    100 are zero on one side of the pairs and at most 20 on the other."""
    mark = F.hex(F.substring(body, 1, 2))
    rest = F.substring(body, 3, (1 << 31) - 1)
    sample = F.hex(F.substring(body, 1, 4096))
    pairs = F.floor(F.length(sample) / 4)
    zeros = lambda side: F.size(F.filter(F.regexp_extract_all(sample, F.lit("(..)(..)"), side), lambda b: b == "00")) * 100
    long_enough = F.octet_length(body) >= 16
    little = long_enough & (zeros(2) >= pairs * 60) & (zeros(1) <= pairs * 20)
    big = long_enough & (zeros(1) >= pairs * 60) & (zeros(2) <= pairs * 20)
    whole = F.substring(body, F.lit(1), (F.floor(F.octet_length(body) / 2) * 2).cast("int"))
    out = F.when(mark == "FFFE", F.decode(rest, "UTF-16LE")).when(mark == "FEFF", F.decode(rest, "UTF-16BE"))
    return out.when(little, F.decode(whole, "UTF-16LE")).when(big, F.decode(whole, "UTF-16BE"))


#: Written-out forms of dots, colons and at signs, in the order in which they are undone.
DEFANGED = (("[://]", "://"), ("[//]", "//"), ("[/]", "/"), ("[:]", ":"), ("[.]", "."), ("(.)", "."), ("{.}", "."), ("[dot]", "."), ("[DOT]", "."), ("(dot)", "."), ("(DOT)", "."), ("[@]", "@"), ("(@)", "@"), ("[at]", "@"), ("[AT]", "@"), ("(at)", "@"), ("(AT)", "@"), ("[tt]", "tt"), ("[TT]", "TT"))


def undefanged(text: Column) -> Column:
    """The first MiB with hxxp and fxp schemes and written-out signs put right; null where nothing changes."""
    head = F.substring(text, 1, 1 << 20)
    out = F.regexp_replace(F.regexp_replace(head, r"(?i)hxxp(s?)(:|\[)", "http$1$2"), r"(?i)fxp(:|\[)", "ftp$1")
    for a, b in DEFANGED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(out != head, out)
