"""Compound files as rows. A sector is a row, and so is each link of the allocation table; chains of any length are
ordered by pointer doubling, and bodies joined from their sectors. The directory's tree is resolved the same way.

Everything is keyed by (file, sector), so a large file spreads over tasks like many small ones. Chains that run in a
circle have no end and give nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.files import filetime, latin1
from palimpsest.operators.records import Layout, number, numbers, once, piece
from palimpsest.operators.tables import by_key, kept

#: Numbers from which on a link leads nowhere; table sectors named in the header; kinds of entries.
NOWHERE, IN_HEADER, STORAGE, STREAM, ROOT = 0xFFFFFFFA, 109, 1, 2, 5
#: Sectors of further table numbers that are followed (each names over a hundred), levels of storages.
MORE_TABLES, LEVELS = 1024, 32
#: Fixed value: the longest stream that is put together.
STREAM_BYTES = 16 << 20

ENTRY = Layout(("name", 64), ("name_size", "u16"), ("type", "u8"), (None, 1), ("left", "u32"), ("right", "u32"), ("child", "u32"), (None, 20), ("created", "u64"), ("modified", "u64"), ("start", "u32"), ("size", "u32"), (None, 4))


def opened(files: DataFrame) -> DataFrame:
    """``files(file, body)``: with the fields of the header and tables, the sectors of the allocation table in order."""
    b = F.col("body")
    known = files.where(F.startswith(F.hex(F.substring("body", 1, 8)), F.lit("D0CF11E0A1B11AE1"))).select(
        "file", "body",
        F.pow(F.lit(2), F.least(number(b, F.lit(30), 2), F.lit(16))).cast("long").alias("width"),
        F.pow(F.lit(2), F.least(number(b, F.lit(32), 2), F.lit(16))).cast("long").alias("mini_width"),
        *[number(b, F.lit(at), 4).alias(n) for n, at in (("directory", 48), ("cutoff", 56), ("mini_start", 60), ("more", 68))],
    )
    first = numbers(piece(b, F.lit(76), F.lit(4 * IN_HEADER)))
    state = "struct<at:bigint,found:array<bigint>>"
    here = lambda s: (s["at"] + 1) * F.col("width")
    rest = lambda v, s: F.transform(F.sequence(F.lit(0), (F.col("width") / 4 - 2).cast("int")), lambda i: number(v, here(s) + i * 4, 4))
    step = lambda v: lambda s, _: F.when(s["at"] < NOWHERE, F.struct(number(v, here(s) + F.col("width") - 4, 4).alias("at"), F.concat(s["found"], rest(v, s)).alias("found")).cast(state)).otherwise(s)
    # as many steps as there can be sectors of this kind in the body
    steps = F.least(F.floor(F.octet_length("body") / (F.col("width") * F.col("width") / 4)) + 1, F.lit(MORE_TABLES)).cast("int")
    tables = once(b, lambda v: F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.col("more").alias("at"), F.col("tables").alias("found")).cast(state), step(v))["found"])
    return known.where("width >= 64 AND mini_width >= 16").withColumn("tables", first).withColumn("tables", F.filter(tables, lambda t: t < NOWHERE))


def chains(links: DataFrame) -> DataFrame:
    """``links(file, node, next)``: file, node, end, left: the last node of each node's chain and how many follow it. By
    pointer doubling: every round joins the pointers with themselves and doubles their reach."""
    state = kept(links.select("file", "node", F.col("next").alias("jump"), F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("left")), "chain")
    longest = state.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length() + 1):
        other = state.where("jump IS NOT NULL").select("file", F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("left").alias("more"))
        if not state.where("jump IS NOT NULL").join(by_key(other), ["file", "jump"], "left_semi").limit(1).count():
            break
        joined = state.join(by_key(other), ["file", "jump"], "left")
        state = kept(joined.select("file", "node", F.coalesce("far", "jump").alias("jump"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "chain")
    ends = links.where("next IS NULL").select("file", F.col("node").alias("end"))
    return state.select("file", "node", F.coalesce("jump", "node").alias("end"), "left").join(by_key(ends), ["file", "end"], "left_semi")


def table_entries(known: DataFrame) -> DataFrame:
    """The allocation table as it stands: file, node, next, n (the sectors that the body has)."""
    b = F.col("body")
    each = known.select("file", "body", "width", F.posexplode("tables").alias("i", "table"))
    each = each.select("file", (F.col("i") * F.col("width") / 4).cast("long").alias("first"), F.ceil(F.octet_length("body") / F.col("width")).alias("n"), piece(b, (F.col("table") + 1) * F.col("width"), F.col("width")).alias("sector"))
    each = each.where("sector IS NOT NULL").select("file", "first", "n", numbers("sector").alias("links"))
    return each.select("file", "first", "n", F.posexplode("links").alias("k", "next")).select("file", (F.col("first") + F.col("k")).alias("node"), "next", "n")


def table_links(known: DataFrame) -> DataFrame:
    """The allocation table: file, node, next (null where a chain ends or leads nowhere)."""
    links = table_entries(known).where("node < n")
    return links.select("file", "node", F.when(F.col("next") < F.col("n"), F.col("next")).alias("next"))


def joined(wanted: DataFrame, ordered: DataFrame, sectors: DataFrame) -> DataFrame:
    """``wanted(file, entry, start, size)`` to file, entry, body: what the chain from start holds, cut at size.
    ``sectors(file, node, data)`` may be null in a place, which ends the body."""
    first = wanted.join(ordered.select("file", F.col("node").alias("start"), "end", F.col("left").alias("whole")).transform(by_key), ["file", "start"])
    places = first.join(by_key(ordered.select("file", "end", "node", "left")), ["file", "end"]).where("left <= whole").withColumn("pos", F.col("whole") - F.col("left"))
    parts = places.join(by_key(sectors), ["file", "node"]).groupBy("file", "entry").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("parts"), F.first("size").alias("size"))
    body = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    return parts.select("file", "entry", F.substring(body, F.lit(1), F.least("size", F.lit(STREAM_BYTES)).cast("int")).alias("body"))


def directory(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and bodies of ``files(file, body)``. Entries: file, entry, name, type, created, modified, start, size, path
    (null for those that the tree doesn't reach). Bodies: file, entry, body of the streams."""
    known = kept(opened(files), "compound")
    ordered = kept(chains(table_links(known)), "chains")
    b = F.col("body")
    count = F.ceil(F.octet_length("body") / F.col("width")).cast("int")
    sectors = known.select("file", "body", "width", F.explode(F.sequence(F.lit(0), F.greatest(count - 2, F.lit(0)))).alias("node")).select("file", F.col("node").cast("long").alias("node"), piece(b, (F.col("node") + 1) * F.col("width"), F.col("width")).alias("data"))
    roots = joined(known.select("file", F.lit(-1).cast("long").alias("entry"), F.col("directory").alias("start"), F.lit(1 << 30).cast("long").alias("size")), ordered, sectors)
    listed = roots.select("file", F.posexplode(ENTRY.array(b, F.lit(0), F.floor(F.octet_length("body") / ENTRY.size), 1 << 20)).alias("entry", "x")).select("file", "entry", "x.*")
    name = F.decode(F.substring(F.col("name"), F.lit(1), F.greatest(F.least(F.col("name_size"), F.lit(64)) - 2, F.lit(0)).cast("int")), "UTF-16LE")
    listed = kept(listed.where("type <> 0").withColumn("name", name), "directory")

    # who stands above whom: a sibling in the same tree, or, at a tree's root, the storage
    side = F.array(F.struct(F.col("left").alias("node"), F.lit(False).alias("top")), F.struct(F.col("right").alias("node"), F.lit(False).alias("top")), F.struct(F.col("child").alias("node"), F.lit(True).alias("top")))
    above = kept(listed.select("file", F.col("entry").alias("above"), F.inline(side)).where(F.col("node") < NOWHERE).groupBy("file", "node").agg(F.min_by(F.struct("above", "top"), "above").alias("x")).select("file", "node", "x.above", "x.top"), "above")
    tree = listed.select("file", F.col("entry").cast("long").alias("node")).join(by_key(above), ["file", "node"], "left")
    tops = chains(tree.select("file", "node", F.when(~F.col("top"), F.col("above")).cast("long").alias("next")))
    folder = tops.join(above.where("top").select("file", F.col("node").alias("end"), F.col("above").alias("folder")).transform(by_key), ["file", "end"]).select("file", F.col("node").alias("entry"), "folder")
    placed = kept(listed.select("file", F.col("entry").cast("long").alias("entry"), "name").join(by_key(folder), ["file", "entry"]), "placed")
    level = listed.where("entry = 0").select("file", F.lit(0).cast("long").alias("folder"), F.lit("").alias("prefix"))
    paths = []
    for _ in range(LEVELS):
        now = kept(placed.join(by_key(level), ["file", "folder"]).select("file", "entry", F.concat("prefix", "name").alias("path")), "paths")
        if not now.limit(1).count():
            break
        paths.append(now)
        level = now.select("file", F.col("entry").alias("folder"), F.concat("path", F.lit("/")).alias("prefix"))
    reached = level.select("file", F.col("folder").alias("entry"), F.col("prefix").alias("path")).limit(0)
    for p in paths:
        reached = reached.unionByName(p)
    entries = kept(listed.withColumn("entry", F.col("entry").cast("long")).join(by_key(reached), ["file", "entry"], "left").select("file", "entry", "name", "type", "path", "start", "size", "created", "modified"), "entries")

    head = known.select("file", "cutoff", "mini_start", "mini_width", "width")
    streams = entries.where(F.col("type") == STREAM).join(by_key(head), "file")
    small_root = entries.where(F.col("type") == ROOT).select("file", F.lit(-2).cast("long").alias("entry"), "start", F.lit(1 << 30).cast("long").alias("size"))
    mini_table = head.select("file", F.lit(-3).cast("long").alias("entry"), F.col("mini_start").alias("start"), F.lit(1 << 30).cast("long").alias("size"))
    large = streams.where("size >= cutoff").select("file", "entry", "start", "size")
    whole = kept(joined(large.unionByName(small_root).unionByName(mini_table), ordered, sectors), "bodies")
    entries_of = lambda e: whole.where(F.col("entry") == e).select("file", "body")
    mini_links = entries_of(-3).select("file", numbers("body").alias("links")).select("file", F.posexplode("links").alias("node", "next")).select("file", F.col("node").cast("long").alias("node"), F.when(F.col("next") < NOWHERE, F.col("next")).alias("next"))
    mini = entries_of(-2).join(by_key(head.select("file", "mini_width")), "file")
    mini_sectors = mini.select("file", "body", "mini_width", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("body") / F.col("mini_width")).cast("int"))).alias("node")).select("file", F.col("node").cast("long").alias("node"), piece(b, F.col("node") * F.col("mini_width"), F.col("mini_width")).alias("data"))
    short = joined(streams.where("size < cutoff AND size > 0").select("file", "entry", "start", "size"), chains(mini_links), mini_sectors)
    return entries, whole.where("entry >= 0").unionByName(kept(short, "short"))


def streams(files: DataFrame) -> DataFrame:
    """file, pos, path, body of every stream that the directory reaches, pos being its place in the directory."""
    return reached(*directory(files))


def reached(entries: DataFrame, bodies: DataFrame) -> DataFrame:
    return entries.where("path IS NOT NULL").join(by_key(bodies), ["file", "entry"]).select("file", F.col("entry").alias("pos"), "path", "body")


#: Streams outside the tree that count, and their size; bytes behind the last sector that count, and those
#: that are kept; the mark of a free sector.
ORPHANS, ORPHAN_BYTES, EXTRA_LEAST, EXTRA_MOST, FREE = 8, 1 << 20, 512, 4 << 20, 0xFFFFFFFF


def orphans(entries: DataFrame, bodies: DataFrame) -> DataFrame:
    """file, pos, body of streams that the directory has but its tree doesn't reach, the first ones of each file."""
    rooted = entries.where((F.col("entry") == 0) & (F.col("type") == ROOT)).select("file")
    lost = entries.where((F.col("type") == STREAM) & F.col("path").isNull() & F.col("size").between(1, ORPHAN_BYTES)).join(by_key(rooted), "file", "left_semi")
    found = lost.join(by_key(bodies.where(F.octet_length("body") > 0)), ["file", "entry"])
    place = F.row_number().over(Window.partitionBy("file").orderBy("entry"))
    return found.withColumn("place", place).where(F.col("place") <= ORPHANS).select("file", F.col("entry").alias("pos"), "body")


def extra_data(files: DataFrame) -> DataFrame:
    """file, body: what stands behind the last sector that the allocation table uses, unless it is short or all zeros."""
    known = opened(files)
    last = table_entries(known).where(F.col("next") != FREE).groupBy("file").agg(F.max("node").alias("last"))
    rest = known.join(by_key(last), "file").select("file", piece(F.col("body"), (F.col("last") + 2) * F.col("width"), F.lit((1 << 31) - 1)).alias("body"))
    some = (F.octet_length("body") >= EXTRA_LEAST) & (F.rtrim(latin1(F.col("body")), F.lit("\0")) != "")
    return rest.where(some).select("file", F.substring("body", 1, EXTRA_MOST).alias("body"))


def entry_times(entries: DataFrame) -> DataFrame:
    """key, pos, created, modified of entries with a time, for :func:`palimpsest.operators.structure.time_markers`."""
    return entries.where("created <> 0 OR modified <> 0").select(F.col("file").alias("key"), F.col("entry").alias("pos"), filetime(F.col("created")).alias("created"), filetime(F.col("modified")).alias("modified"))


#: Properties of a summary and the types that they must have.
TEMPLATE, REVISION, EDIT_TIME, APPLICATION, SECURITY = 0x07, 0x09, 0x0A, 0x12, 0x13
TEXTS, TIME, INTEGER = (0x1E, 0x1F), 0x40, 0x03
PROPERTY = Layout(("id", "u32"), ("offset", "u32"))


def summaries(bodies: DataFrame) -> DataFrame:
    """``bodies(key, body)`` of summary streams: key, template, app, revision, minutes, security, for
    :func:`palimpsest.operators.structure.summary_markers`. A property that is missing, mistyped or cut is null; the
    first of equal ones counts."""
    b = F.col("body")
    section = number(b, F.lit(44), 4)
    good = (number(b, F.lit(0), 2) == 0xFFFE) & (number(b, F.lit(24), 4) >= 1)
    rows = bodies.where(good).select("key", "body", section.alias("section"), PROPERTY.array(b, section + 8, number(b, section + 4, 4), 1024).alias("properties"))
    place = lambda i: F.col("section") + F.get(F.filter("properties", lambda p: p["id"] == i), F.lit(0))["offset"]
    rows = rows.select("key", "body", *[place(i).alias(n) for n, i in (("template", TEMPLATE), ("app", APPLICATION), ("revision", REVISION), ("time", EDIT_TIME), ("security", SECURITY))])
    kind = lambda n: number(b, F.col(n), 4)
    size = lambda n: number(b, F.col(n) + 4, 4)
    text = lambda n: F.when(kind(n).isin(*TEXTS) & (size(n) > 0) & (size(n) <= 1 << 16), F.regexp_replace(F.decode(piece(b, F.col(n) + 8, size(n)), "ISO-8859-1"), r"\x00+$", ""))
    return rows.select("key", text("template").alias("template"), text("app").alias("app"), text("revision").alias("revision"), F.when(kind("time") == TIME, number(b, F.col("time") + 4, 8)).alias("minutes"), F.when(kind("security") == INTEGER, size("security")).alias("security"))
