"""URL candidates: finding, refanging and normalising them as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what an address is in a text.
FOUND = r"(?i)\bhttps?://[^\s\"'<>)\]}\x00-\x1f]+"
#: Tokens that make a second, refanged pass worth while, and its replacements in order.
DEFANG_TOKENS = ("hxxp", "hXXp", "[.]", "(.)", "{.}", "[dot]", "(dot)", "{dot}", "[DOT]", " dot ", "[:]", "[://]")
REFANG = (("hxxps", "https"), ("hXXps", "https"), ("hxxp", "http"), ("hXXp", "http"), ("[.]", "."), ("(.)", "."), ("{.}", "."), ("[dot]", "."), ("(dot)", "."), ("{dot}", "."), ("[DOT]", "."), (" dot ", "."), ("[:]", ":"), ("[://]", "://"))
PIECES = r"^(?i)(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def refanged(text: Column) -> Column:
    """All written-out signs put right in one pass, so that what a replacement makes is not replaced again: the text is
    cut before and after each token, and tokens are looked up."""
    tokens = "|".join(re.escape(a) for a, _ in REFANG)
    known = F.create_map(*[F.lit(x) for pair in REFANG for x in pair])
    parts = F.split(F.regexp_replace(text, f"({tokens})", "\x01$1\x01"), "\x01")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def is_defanged(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in DEFANG_TOKENS])


def candidates(text: Column, most: int = 64) -> Column:
    """Array of (raw, deobfuscated): URLs as they stand, then those of the refanged copy, ``most`` in all."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(FOUND), 0), lambda u: F.struct(u.alias("raw"), F.lit(False).alias("deobf")))
    fanged = F.transform(F.regexp_extract_all(F.when(is_defanged(text), refanged(text)).otherwise(""), F.lit(FOUND), 0), lambda u: F.struct(u.alias("raw"), F.lit(True).alias("deobf")))
    return F.slice(F.concat(plain, fanged), 1, most)


def normalised(url: Column) -> tuple[Column, Column]:
    """The URL in the form feeds are compared in, and its host; empty for anything but http(s) with a host."""
    trimmed = F.regexp_replace(F.trim(url), r"""[.,);\]}'"]+$""", "")
    scheme, host, port, path, query = (F.regexp_extract(trimmed, PIECES, i) for i in range(1, 6))
    scheme, host = F.lower(scheme), F.lower(host)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    norm = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "/", "").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", "").otherwise(norm), host


def is_ipv4(host: Column) -> Column:
    """Digits and exactly three dots; ranges aren't looked at."""
    return host.rlike(r"^[0-9]*(\.[0-9]*){3}$")
