"""Layered decoding: everything hidden in a text, layer by layer, without a shuffle; one source's budget is one array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import encodings as e
from palimpsest.functions.files import latin1
from palimpsest.operators.tables import discard, kept, spread

utf8 = lambda texts: F.transform(texts, lambda x: F.encode(x, "UTF-8"))
says = lambda *words: lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
anything = lambda low: F.lit(True)
#: Decoders in the order in which a layer tries them: text of one byte a character to blobs; and what must stand in the
#: text in lower case for a decoder to find anything, which is looked for before its pattern is.
DECODERS = (
    ("base64", anything, e.base64_blobs),
    ("hex", anything, e.hex_blobs),
    ("reverse", says(*e.REVERSED), lambda t: F.transform(e.reversed_text(t), lambda x: F.encode(x, "ISO-8859-1"))),
    ("chain", says("&", "+"), lambda t: utf8(e.chained_literals(t))),
    ("replace", says("replace("), lambda t: utf8(e.replaced_literals(t))),
    ("xor", says("array("), lambda t: F.transform(e.xored_arrays(t), F.unhex)),
    ("strreverse", says("strreverse("), lambda t: utf8(e.reversed_literals(t))),
    ("environ", says("environ"), lambda t: utf8(e.environ_markers(t))),
    ("keyed", says('"'), lambda t: utf8(e.keyed_digits(t))),
    ("x_escape", says("\\x"), e.escape_blobs),
    ("ampersand", says("&h"), e.amp_blobs),
    ("unicode", says("\\u", "%u"), lambda t: utf8(e.unicode_texts(t))),
    ("decimal", says(",", ";"), lambda t: F.transform(e.decimal_texts(t), lambda x: F.encode(x, "ISO-8859-1"))),
    ("netbios", anything, e.netbios_blobs),
    ("base32", anything, e.base32_blobs),
)
#: Blobs in their order. Those of layers before the last have done their work and are known by digest and size alone.
FOUND = "array<struct<layer:int,decoder:string,blob:binary,digest:string,bytes:int>>"
DEEP = 3


def offers(layer: int):
    """What a text, with its lower case beside it, gives in this layer."""
    none = F.array().cast("array<binary>")
    told = lambda b, name: F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("decoder"), b.alias("blob"), F.sha2(b, 256).alias("digest"), F.octet_length(b).alias("bytes"))
    one = lambda x, name, gate, f: F.transform(F.when(gate(x["low"]), e.emitted(f(x["text"]))).otherwise(none), lambda b: told(b, name))
    return lambda x: F.flatten(F.array(*[one(x, name, gate, f) for name, gate, f in DECODERS]))


def of_layer(layer: int):
    return lambda x: x["layer"] == layer


def worthwhile(layer: int):
    """Whether a text is decoded in this layer: the source if it may be encoded, blobs if they look it."""
    test = e.may_be_encoded if layer == 1 else e.looks_encoded
    return lambda t: t.isNotNull() & test(t)


def taken(found: Column, offered: Column) -> Column:
    """What was found and, of what is offered, in order, all that is new and fits into the source's budget."""
    size = lambda acc: F.aggregate(acc, F.lit(0), lambda s, x: s + x["bytes"])

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc) < e.BLOBS) & (size(acc) + x["bytes"] <= e.TOTAL_BYTES)
        return F.when(fits & ~F.exists(acc, lambda y: y["digest"] == x["digest"]), F.concat(acc, F.array(x)).cast(FOUND)).otherwise(acc)

    return F.aggregate(offered.cast(FOUND), found, step)


def layered(docs: DataFrame, key: str, text: Column, depth: int = 4) -> DataFrame:
    """key, pos, layer, decoder, blob: what the text hides, breadth first, to ``depth`` layers. Blobs that look encoded
    are decoded again; all layers share one budget. A null text hides nothing.

    Each layer is a table of its own, of the sources that still have something to decode: so no layer is computed twice,
    and no filter on the result is pushed through the expressions of all layers. A blob is kept by its own layer alone,
    and what was offered goes once it has been chosen from."""
    rows = spread(docs.select(key, F.array(text).alias("queue"), F.array().cast(FOUND).alias("found")))
    done = None
    for layer in range(1, depth + 1):
        gated = F.transform(F.filter("queue", worthwhile(layer)), lambda t: F.struct(t.alias("text"), F.lower(t).alias("low")))
        offered = kept(rows.select(key, "found", F.flatten(F.transform(gated, offers(layer))).alias("offered")), "offered")
        got = kept(offered.where(F.size("offered") > 0).select(key, taken(F.col("found"), F.col("offered")).alias("found")), "layer")
        discard(offered)
        new = got.select(key, F.posexplode_outer("found").alias("pos", "x")).where(F.col("x.layer") == layer).select(key, "pos", "x.layer", "x.decoder", "x.blob")
        done = new if done is None else done.unionByName(new)
        mine = F.transform(F.filter("found", of_layer(layer)), lambda x: latin1(x["blob"]))
        before = F.transform("found", lambda x: x.withField("blob", F.lit(None).cast("binary")))
        rows = got.select(key, mine.alias("queue"), before.alias("found")).where(F.size("queue") > 0)
    return done


def depth_markers(found: DataFrame, key: str) -> DataFrame:
    """key, marker: one for each source with a blob three layers deep or deeper."""
    deepest = found.groupBy(key).agg(F.max("layer").alias("layer")).where(F.col("layer") >= DEEP)
    return deepest.select(key, F.concat(F.lit("MSD-DEEPDECODE depth="), F.col("layer").cast("string")).alias("marker"))


def refanged_layers(docs: DataFrame, key: str, text: Column, depth: int = 4) -> DataFrame:
    """The same for the copy with its addresses put right, where that differs from the text."""
    return layered(docs.select(key, e.undefanged(text).alias("text")).where("text IS NOT NULL"), key, F.col("text"), depth)


#: Assignments of literals, aliases and calls with literals or names. Literals are written with possessive
#: groups, which match the same but spare Java's matcher the stack that an alternation repeated over a long literal takes.
ASSIGN = r'(?im)^[ \t]*([A-Za-z]\w{0,63})\s*=\s*"([^"]*+(?:""[^"]*+)*+)"'
ALIAS = r"(?im)^[ \t]*([A-Za-z]\w{0,63})\s*=\s*([A-Za-z]\w{0,63})\s*$"
ARGUMENT = r'(?:"([^"]*+(?:""[^"]*+)*+)"|([A-Za-z]\w{0,63}))'
CALL = rf"(?i)Replace\(\s*{ARGUMENT}\s*,\s*{ARGUMENT}\s*,\s*{ARGUMENT}\s*\)"


def all_groups(text: Column, pattern: str, n: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), i).alias(f"g{i}") for i in range(1, n + 1)])


def replaced_variables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, value: ``Replace`` calls with a variable among their arguments, carried out. Variables have the first
    literal assigned to them (at most 256 of 4096 characters), by way of one alias at most; calls with an unknown
    variable have no row. An equi-join of calls with assignments by (key, variable)."""
    rows = docs.select(key, text)
    every = rows.select(key, F.posexplode(F.slice(all_groups(F.col(text), ASSIGN, 2), 1, 256)).alias("at", "a"))
    literal = every.where(F.length("a.g2") <= 4096).groupBy(key, F.lower("a.g1").alias("name")).agg(F.min_by(e.unquoted(F.col("a.g2")), "at").alias("value"))
    hops = rows.select(key, F.posexplode(all_groups(F.col(text), ALIAS, 2)).alias("at", "a")).groupBy(key, F.lower("a.g1").alias("alias")).agg(F.min_by(F.lower("a.g2"), "at").alias("name"))
    by_alias = hops.join(literal, [key, "name"]).select(key, F.col("alias").alias("name"), "value").join(literal.select(key, "name"), [key, "name"], "left_anti")
    known = literal.unionByName(by_alias)
    calls = rows.select(key, F.posexplode(all_groups(F.col(text), CALL, 6)).alias("pos", "c")).where("c.g2 <> '' OR c.g4 <> '' OR c.g6 <> ''")
    argument = lambda i: F.struct(F.lit(i).alias("i"), F.lower(F.col(f"c.g{2 * i}")).alias("name"), e.unquoted(F.col(f"c.g{2 * i - 1}")).alias("literal"))
    flat = calls.select(key, "pos", F.inline(F.array(*[argument(i) for i in (1, 2, 3)])))
    valued = flat.join(known, [key, "name"], "left").withColumn("value", F.when(F.col("name") == "", F.col("literal")).otherwise(F.col("value")))
    one = lambda i: F.max(F.when(F.col("i") == i, F.col("value")))
    whole = valued.groupBy(key, "pos").agg(one(1).alias("a"), one(2).alias("b"), one(3).alias("c")).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
    return whole.select(key, "pos", F.when(F.col("b") == "", F.col("a")).otherwise(F.replace("a", F.col("b"), F.col("c"))).alias("value"))
