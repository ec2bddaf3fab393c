"""Queries over whole tables that run decoders, streams, feeds and results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scoring, urls
from palimpsest.operators import cells, decode, feeds, matches, streams
from palimpsest.plans.catalogue import MATCHES, events_as_matches, query
from palimpsest.sources import feeds as sources
from palimpsest.sources import profiles, sinks
from palimpsest.streaming import effort_steps, parts

plain64 = lambda c: F.regexp_replace(F.base64(c), r"[\r\n]", "")


@query("SELECT doc_id, sha256(text) AS sha256, 3 AS layer FROM documents WHERE strlen(text) >= 24")
def decode_queue(read):
    """Hex of base64 of base64, found by the layered driver without being told which decoders to use."""
    rows = read("documents").where(F.octet_length("text") >= 24).select("doc_id", F.concat(F.lit("run: "), F.lower(F.hex(plain64(plain64(F.encode("text", "UTF-8")))))).alias("hidden"))
    found = decode.layered(rows, "doc_id", F.col("hidden")).where("layer = 3")
    deepest = found.groupBy("doc_id").agg(F.max_by(F.struct(F.sha2("blob", 256).alias("sha256"), "layer"), F.struct(F.octet_length("blob"), -F.col("pos"))).alias("x"))
    return deepest.select("doc_id", "x.sha256", "x.layer")


def spoken(read) -> DataFrame:
    return read("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc"), F.concat("role", F.lit(" speaks in turn "), F.col("turn").cast("string"), F.lit(" of it")).alias("said"))


SPOKEN = "(SELECT conv_id || '-' || turn AS doc, role || ' speaks in turn ' || turn || ' of it' AS said FROM conversations)"


@query(f"SELECT doc, 'MSD-DEEPDECODE depth=3' AS marker FROM {SPOKEN}")
def decode_depth_marker(read):
    rows = spoken(read).select("doc", F.concat(F.lit('x = StrReverse("'), F.reverse(F.hex(plain64(F.encode("said", "UTF-8")))), F.lit('")')).alias("text"))
    return decode.depth_markers(decode.layered(rows, "doc", F.col("text")), "doc")


@query(f"SELECT doc, 0 AS pos, replace(said, ' ', '-') AS value FROM {SPOKEN}")
def decode_replaced_variables(read):
    script = F.concat(F.lit('v = "'), "said", F.lit('"\nv = "later"\nw = v\ngap = " "\ns = Replace(w, gap, "-")\nt = Replace(unknown, gap, "-")'))
    return decode.replaced_variables(spoken(read).select("doc", script.alias("text")), "doc", "text")


@query(f"SELECT doc, sha256(said) AS sha256 FROM {SPOKEN}")
def decode_refanged(read):
    rows = spoken(read).select("doc", F.concat(F.lit("hxxps://a[.]b/ "), plain64(F.encode("said", "UTF-8"))).alias("text"))
    return decode.refanged_layers(rows, "doc", F.col("text")).where("layer = 1").select("doc", F.sha2("blob", 256).alias("sha256"))


def text_streams(read) -> DataFrame:
    return read("documents").select((F.col("doc_id") % 50).alias("doc"), F.col("doc_id").alias("pos"), F.encode("text", "UTF-8").alias("body"))


@query("SELECT doc_id % 50 AS doc, min(doc_id) AS pos, sha256(text) AS sha256 FROM documents GROUP BY doc_id % 50, text")
def stream_dedup(read):
    return streams.distinct_streams(text_streams(read)).select("doc", "pos", streams.stream_key(F.col("body")).alias("sha256"))


@query("SELECT doc_id % 50 AS doc, doc_id AS pos, (doc_id % 50, text) IN (SELECT (doc_id % 50, text) FROM documents WHERE doc_id % 3 = 0) AS is_vba FROM documents")
def macro_membership(read):
    rows = text_streams(read)
    return streams.macro_streams(rows, rows.where("pos % 3 = 0")).select("doc", "pos", "is_vba")


def marker_events(read) -> DataFrame:
    names = ("XLM-AUTO-OPEN", "XLM-DANGEROUS-FUNC EXEC", "PDF-LAUNCH", "OLEID-DDE", "XLM-HIDDEN-MACROSHEET a", "DIGITAL-SIGNATURE", "OLETIMES-FUTURE 1", "OLEID-DDE")
    return read("events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 8 + 1).cast("int")).alias("marker"))


NAMED = "(SELECT user_id AS doc, event_id AS pos, (['XLM-AUTO-OPEN', 'XLM-DANGEROUS-FUNC EXEC', 'PDF-LAUNCH', 'OLEID-DDE', 'XLM-HIDDEN-MACROSHEET a', 'DIGITAL-SIGNATURE', 'OLETIMES-FUTURE 1', 'OLEID-DDE'])[event_id % 8 + 1] AS marker FROM events)"


@query(f"SELECT doc, 'XLM-STACK' || chr(10) || string_agg(marker, chr(10) ORDER BY pos) || chr(10) AS stream FROM {NAMED} WHERE marker LIKE 'XLM%' GROUP BY doc HAVING count(*) >= 2")
def sheet_stacks(read):
    return streams.sheet_stack(marker_events(read))


@query(f"SELECT doc, 'USERFORM-STRINGS' || chr(10) || string_agg(marker, chr(10) ORDER BY pos) AS stream FROM {NAMED} GROUP BY doc")
def marker_payloads(read):
    return streams.marker_with_payload(marker_events(read).withColumnRenamed("marker", "text"), "USERFORM-STRINGS")


@query(f"SELECT doc, 'MALDOC-BEHAVIOR-SCORE n=3' || chr(10) || 'OLEID-DDE' || chr(10) || 'DIGITAL-SIGNATURE' || chr(10) || 'OLETIMES-FUTURE ' || chr(10) AS stream FROM {NAMED} GROUP BY doc HAVING count(DISTINCT CASE WHEN marker LIKE 'OLEID%' OR marker LIKE 'DIG%' OR marker LIKE 'OLET%' THEN marker END) >= 3")
def behaviour_streams(read):
    return streams.behaviour_scores(marker_events(read))


@query(f"SELECT doc, pos, marker IN ('OLEID-DDE', 'XLM-AUTO-OPEN', 'DIGITAL-SIGNATURE') AS marked FROM {NAMED}")
def channel_partition(read):
    rows = streams.channelled(marker_events(read).select("doc", "pos", F.encode("marker", "UTF-8").alias("body")))
    return rows.select("doc", "pos", (F.col("channel") == "marker").alias("marked"))


@query("SELECT user_id % 20 AS doc, 'u' || event_id % 37 AS norm, min(event_id) AS pos, arg_min(event_id % 2 = 0, event_id) AS deobf FROM events GROUP BY 1, 2")
def first_hits(read):
    hits = read("events").select((F.col("user_id") % 20).alias("doc"), F.col("event_id").alias("pos"), F.lit(0).alias("idx"), F.concat(F.lit("u"), (F.col("event_id") % 37).cast("string")).alias("norm"), (F.col("event_id") % 2 == 0).alias("deobf"))
    return streams.first_hits(hits).select("doc", "norm", "pos", "deobf")


def feed_lines(read) -> DataFrame:
    """A feed with comments, quotes, ragged and bad rows, made of pages."""
    row = F.concat(F.lit('"'), F.col("page_id").cast("string"), F.lit('","2024-01-01","'), F.lower("url"), F.lit('","online"'))
    made = F.when(F.col("page_id") % 7 == 0, "# comment").when(F.col("page_id") % 7 == 1, "no,address,here").when(F.col("page_id") % 7 == 2, F.concat(F.lower("url"), F.lit(",short"))).otherwise(row)
    return read("pages").select(made.alias("value"))


@query(r"SELECT DISTINCT regexp_extract(lower(url), '^https?://([^/?#:]*)', 1) AS host FROM pages WHERE page_id % 7 > 1")
def url_feed_hosts(read):
    return sources.url_rows(feed_lines(read)).select("host").distinct()


@query(r"SELECT DISTINCT host FROM (SELECT regexp_extract(lower(url), '^https?://([^/?#:]*)', 1) AS host FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'host' || page_id || '.example' FROM pages WHERE page_id % 3 = 1)")
def indicator_hosts(read):
    row = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("7,url,"), F.lower("url"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('8,"Domain"," Host'), F.col("page_id").cast("string"), F.lit('.example"'))).otherwise(F.lit("9,md5_hash,abc"))
    return sources.indicator_rows(read("pages").select(row.alias("value")), 1, 2)[1]


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id % 4 <> 0")
def hash_feed_rows(read):
    row = F.when(F.col("doc_id") % 4 == 0, F.lit("# none")).otherwise(F.concat(F.lit('"2024-01-01", "'), F.upper(F.sha2("text", 256)), F.lit('", "d41d8cd98f00b204e9800998ecf8427e"')))
    return sources.hash_rows(read("documents").select(row.alias("value")))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#:]*)', 1) AS host FROM pages)
SELECT page_id AS doc, 'IOC_DOMAIN' AS rule FROM u WHERE host IN (SELECT host FROM u WHERE page_id % 6 = 0)""")
def indicator_join(read):
    norm, host = urls.normalised(F.col("url"))
    hits = read("pages").select(F.col("page_id").alias("doc"), F.lit(0).alias("pos"), norm.alias("norm"), host.alias("host"), F.lit(False).alias("deobf"))
    return feeds.url_then_host(hits, hits.limit(0), hits.where("doc % 6 = 0"), "IOC", "_DOMAIN").select("doc", "rule")


@query("SELECT CASE WHEN (SELECT count(*) FROM documents WHERE n_chars > 20000) > 0 THEN 2 WHEN (SELECT count(*) FROM documents WHERE contains(text, 'token = ')) > 0 THEN 1 ELSE 0 END AS code")
def scan_exit_code(read):
    files = read("documents").select("doc_id", F.when(F.col("n_chars") > 20000, F.lit("too large")).alias("error"))
    return sources.exit_code(files, read("documents").where(F.contains("text", F.lit("token = "))))


@query("SELECT event_id AS key, CASE WHEN event_type = 'error' OR value > 400 OR value = 0 OR event_id % 50 = 0 THEN 'unknown' WHEN event_id % 3 = 0 THEN 'infected' ELSE 'clean' END AS status FROM events")
def mail_statuses(read):
    rules = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>"))
    scans = read("events").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 50 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("size"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"), rules.alias("rules"), F.lit(400).alias("most"))
    return sources.mail_status(scans).select("key", "status")


@query("SELECT event_id AS id, event_id % 11 = 0 OR NOT (event_id % 5 IN (0, 1, 2) OR (event_id % 5 = 3 AND event_id % 2 = 0)) AS kept, CASE WHEN event_id % 11 = 0 THEN 'private' WHEN event_id % 5 = 0 THEN 'license:source' WHEN event_id % 5 = 1 THEN 'license:non-commercial' WHEN event_id % 5 = 2 THEN 'mail:memory' WHEN event_id % 5 = 3 AND event_id % 2 = 0 THEN 'mail:other-system' ELSE 'keep' END AS reason FROM events")
def rule_profile(read):
    kind = F.col("event_id") % 5
    rows = read("events").select(
        F.col("event_id").alias("id"),
        F.when(kind == 0, "CLOSED_Trojan").when(kind == 3, F.when(F.col("event_id") % 2 == 0, "OPEN_Linux_Miner").otherwise("OPEN_Linux_Loader")).otherwise("OPEN_Loader").alias("rule"),
        F.when(kind == 2, F.array(F.lit("memory"))).otherwise(F.array(F.lit("file"))).alias("tags"),
        F.when(kind == 1, "https://creativecommons.org/licenses/by-nc/4.0").otherwise("MIT").alias("license"),
        (F.col("event_id") % 11 == 0).alias("private"),
    )
    profile = profiles.Profile(sources=("CLOSED",), licenses=("by-nc", "noncommercial"), tags=("MEMORY",), names=(), other_systems="(?i)(?:^|_)linux(?:_|$)", keep=("LOADER",))
    return profiles.judged(rows, profile).select("id", "kept", "reason")


@query(f"SELECT DISTINCT rule, 'source ' || left(rule, 1) AS source FROM {MATCHES} WHERE rule NOT LIKE 'v%'")
def rule_sources(read):
    rows = events_as_matches(read)
    manifest = rows.select(F.substring("rule", 1, 1).alias("prefix")).distinct().where("prefix <> 'v'").select("prefix", F.concat(F.lit("source "), "prefix").alias("source"))
    return profiles.with_sources(rows.select("rule").distinct(), manifest)


@query(f"SELECT doc, max(score) >= 75 AS high FROM {MATCHES} GROUP BY doc")
def high_flags(read):
    return matches.high(events_as_matches(read), F.col("score"))


@query("SELECT '# TYPE scans_total counter' || chr(10) || 'scans_total ' || count(*) || chr(10) || '# TYPE large gauge' || chr(10) || 'large ' || count(*) FILTER (value > 100) || chr(10) AS text FROM events")
def metrics_exposition(read):
    found = read("events").agg(F.count("*").alias("scans_total"), F.count_if(F.col("value") > 100).alias("large"))
    return sinks.exposition(found, gauges=("large",))


@query("SELECT event_id AS doc, (['=\"calc\"&B2', '=EXEC(\"cmd\")', '=\"x\"'])[event_id % 3 + 1] AS formula, (['=\"calc\"&\".exe\"', '=EXEC(\"cmd\")', '=\"x\"'])[event_id % 3 + 1] AS folded FROM events")
def cell_references(read):
    e = read("events").select(F.col("event_id").alias("doc"), F.lit("s").alias("sheet"), F.lit(0).alias("pos"), F.lit("A1").alias("coord"), F.element_at(F.array(F.lit('="calc"&B2'), F.lit('=EXEC("cmd")'), F.lit('="x"')), (F.col("event_id") % 3 + 1).cast("int")).alias("formula"), F.lit(None).cast("string").alias("value"))
    values = e.select("doc", "sheet", F.lit(1).alias("pos"), F.lit("$B$2").alias("coord"), F.lit(None).cast("string").alias("formula"), F.lit(".exe").alias("value"))
    return cells.substituted(e.union(values)).select("doc", "formula", F.col("text").alias("folded"))


@query("SELECT event_id, (['A1', 'Z3', 'AA10', 'BC7'])[event_id % 4 + 1] AS a1, (['A2', 'Z4', 'AA11', 'BC8'])[event_id % 4 + 1] AS below FROM events")
def cell_names(read):
    r1c1 = F.element_at(F.array(*map(F.lit, ("R1C1", "r3c26", "R10C27", "R7C55"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read("events").select("event_id", cells.from_r1c1(r1c1).alias("a1"))
    return rows.select("event_id", "a1", cells.below(F.col("a1")).alias("below"))


@query("SELECT user_id AS message, min(event_id) AS part FROM events WHERE value BETWEEN 10 AND 400 GROUP BY user_id, event_id % 40 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) <= 32")
def message_parts(read):
    rows = read("events").select(F.col("user_id").alias("message"), F.col("event_id").alias("part"), (F.col("event_id") % 40).cast("string").alias("digest"), F.col("value").alias("size"))
    return parts.chosen(rows, 10, 400).select("message", "part")


@query(f"SELECT doc, '[' || string_agg('{{\"rule\":\"' || rule || '\",\"namespace\":\"' || namespace || '\",\"tags\":[\"t\"],\"meta\":{{\"family\":\"' || coalesce(family, ' ') || '\"}}}}', ',' ORDER BY pos) || ']' AS response FROM {MATCHES} GROUP BY doc")
def json_full_responses(read):
    found = events_as_matches(read).withColumn("tags", F.array(F.lit("t")))
    return sinks.json_responses(found, found, full=True)


@query(f"SELECT doc, pos, CASE WHEN event_id_mod = 0 THEN 'exploit' WHEN event_id_mod = 1 THEN 'malware' WHEN event_id_mod = 2 THEN 'phishing' ELSE 'suspicious' END AS tier FROM (SELECT *, pos % 4 AS event_id_mod FROM {MATCHES})")
def keyword_tiers(read):
    m = events_as_matches(read)
    word = F.element_at(F.array(*map(F.lit, ("x_CVE_1", "x_Trojan", "x_phish", "x_susp"))), (F.col("pos") % 4 + 1).cast("int"))
    tier = scoring.tier(word, F.col("namespace"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.col("score"))
    return m.select("doc", "pos", tier.alias("tier"))


@query("""WITH RECURSIVE t AS (SELECT user_id AS node, event_id AS tick, 1 + event_id % 7 AS target, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT node, tick, n, target AS level FROM t WHERE n = 1 UNION ALL SELECT t.node, t.tick, t.n, r.level + sign(t.target - r.level) FROM r JOIN t ON t.node = r.node AND t.n = r.n + 1)
SELECT node, tick, level::INTEGER AS level FROM r""")
def effort_steps_in_order(read):
    return effort_steps.steps(read("events").select(F.col("user_id").alias("node"), F.col("event_id").alias("tick"), (F.col("event_id") % 7 + 1).cast("int").alias("target")))


@query("SELECT time_bucket(INTERVAL 2 HOUR, ts) AS start, count(*) AS scans, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 300) AS large, count(*) FILTER (event_type = 'error') / 7200.0::DOUBLE AS errors_rate, count(*) FILTER (value > 300) / 7200.0::DOUBLE AS large_rate FROM events GROUP BY 1")
def rate_series(read):
    log = read("events").select("ts", (F.col("event_type") == "error").alias("errors"), (F.col("value") > 300).alias("large"))
    return effort_steps.series(log, "2 hours", ("errors", "large"))
