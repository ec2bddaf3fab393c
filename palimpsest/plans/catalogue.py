"""All registered queries of the engine itself, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import effort, encodings, files, markers, scoring, urls
from palimpsest.operators import containers, feeds, matches, rules, structure
from palimpsest.sources import sinks
from palimpsest.streaming import cache, rates

FLAGSHIP = "rule_matches"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with the SQL that DuckDB runs on the same tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        ORACLES[f.__name__] = sql
        return f

    return register


def quoted(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def events_as_matches(read) -> DataFrame:
    """Matches made from events, as FIXTURES.md says."""
    e = read("events")
    rule = F.concat_ws("_", "event_type", F.pmod("event_id", F.lit(8)).cast("string"))
    meta = F.when(F.pmod("event_id", F.lit(5)) == 0, F.create_map(F.lit("family"), F.concat(F.lit("fam"), F.pmod("event_id", F.lit(7)).cast("string")))).otherwise(F.create_map(F.lit("family"), F.lit(" ")))
    return e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), rule.alias("rule"), F.concat(F.lit("ns"), F.pmod("event_id", F.lit(3)).cast("string")).alias("namespace"), meta.alias("meta"), F.floor(F.col("value") / 5).alias("score"))


MATCHES = "(SELECT user_id AS doc, event_id AS pos, event_type || '_' || (event_id % 8) AS rule, 'ns' || (event_id % 3) AS namespace, CASE WHEN event_id % 5 = 0 THEN 'fam' || (event_id % 7) END AS family, floor(value / 5)::BIGINT AS score FROM events)"


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def hash_feed_lookup(read):
    docs = read("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return feeds.in_feed(docs, docs.where("doc_id % 10 = 0"), "sha256").select("doc_id", "sha256")


RULES = [
    rules.Rule("license_notice", "text", {"a": ("text", "licensed under", frozenset({"nocase"})), "b": ("text", "License", frozenset({"fullword"}))}, meta={"score": "20", "tier": "suspicious"}),
    rules.Rule("secret_assignment", "text", {"a": ("regex", r"token = .[0-9a-f]{32,}", frozenset())}, meta={"score": "75"}, tags=("secret",)),
    rules.Rule("two_insults", "text", {k: ("text", k, frozenset({"nocase", "fullword"})) for k in ("idiot", "moron", "scum", "trash", "loser")}, least=2),
    rules.Rule("article_without_of", "text", {"a": ("text", " the ", frozenset()), "b": ("text", " of ", frozenset())}, none=("b",)),
]


@query(
    r"""WITH d AS (SELECT doc_id, text, lower(text) AS l FROM documents)
SELECT doc_id, 0 AS pos, 'license_notice' AS rule, 'text' AS namespace FROM d WHERE contains(l, 'licensed under') OR regexp_matches(text, '(^|[^A-Za-z0-9])License($|[^A-Za-z0-9])')
UNION ALL SELECT doc_id, 1, 'secret_assignment', 'text' FROM d WHERE regexp_matches(text, 'token = .[0-9a-f]{32,}')
UNION ALL SELECT doc_id, 2, 'two_insults', 'text' FROM d WHERE (SELECT count(*) FROM (SELECT unnest(['idiot','moron','scum','trash','loser']) AS w) WHERE regexp_matches(l, '(^|[^a-z0-9])' || w || '($|[^a-z0-9])')) >= 2
UNION ALL SELECT doc_id, 3, 'article_without_of', 'text' FROM d WHERE contains(text, ' the ') AND NOT contains(text, ' of ')"""
)
def rule_matches(read):
    return rules.matched(read("documents"), F.col("text"), RULES, "doc_id").select("doc_id", "pos", "rule", "namespace")


@query(
    r"""WITH b AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '%PDF-1.4' WHEN 1 THEN '{\rt' WHEN 2 THEN 'MZ' WHEN 3 THEN 'Rar!' || chr(26) || chr(7) WHEN 4 THEN '' ELSE 'ID;' END AS head FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'rtf' WHEN 2 THEN 'none' WHEN 3 THEN 'rar' WHEN 4 THEN 'none' ELSE 'sylk' END AS kind FROM b"""
)
def sniff_kind(read):
    heads = F.element_at(F.array(*map(F.lit, ("%PDF-1.4", "{\\rt", "MZ", "Rar!\x1a\x07", "", "ID;"))), (F.col("page_id") % 6 + 1).cast("int"))
    return read("pages").select("page_id", files.kind(F.encode(F.concat(heads, "html"), "UTF-8")).alias("kind"))


@query(r"SELECT doc_id, length(regexp_replace(substr(text, 1, 4096), '[^\t\n\r\x20-\x7e]', '', 'g')) * 100 >= least(length(text), 4096) * 90 AND length(text) > 0 AS mostly_text, regexp_matches(substr(text, 1, 1048576), '[A-Za-z0-9+/]{20,}|[0-9,;]{23,}') OR regexp_matches(lower(substr(text, 1, 1048576)), '\\x|\\u|%u|&h|chr|replace\(|array\(|strreverse|environ') AS may_be_encoded FROM documents")
def text_gates(read):
    return read("documents").select("doc_id", encodings.mostly_text(F.col("text")).alias("mostly_text"), encodings.may_be_encoded(F.col("text")).alias("may_be_encoded"))


def urls_to_clean(read) -> DataFrame:
    host = F.regexp_extract("url", "^(https?)://([^/]*)(.*)$", 2)
    port = F.when(F.startswith("url", F.lit("https")), ":443").otherwise(":80")
    made = F.concat(F.regexp_extract("url", "^(https?)://", 1), F.lit("://"), F.upper(host), F.when(F.col("page_id") % 2 == 0, port).otherwise(":8080"), F.regexp_extract("url", "^(https?)://([^/]*)(.*)$", 3), F.when(F.col("page_id") % 4 == 0, "#part).").otherwise("')"))
    return read("pages").select("page_id", made.alias("url"))


URLS = r"(SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || upper(regexp_extract(url, '^(https?)://([^/]*)(.*)$', 2)) || CASE WHEN page_id % 2 = 0 THEN CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END ELSE ':8080' END || regexp_extract(url, '^(https?)://([^/]*)(.*)$', 3) || CASE WHEN page_id % 4 = 0 THEN '#part).' ELSE ''')' END AS url FROM pages)"


@query(
    rf"""WITH t AS (SELECT page_id, rtrim(url, '.,);]}}''"') AS url FROM {URLS}),
p AS (SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#:]*:([0-9]+)', 1) AS port, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM t)
SELECT page_id, scheme || '://' || host || CASE WHEN (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') OR port = '' THEN '' ELSE ':' || port END || CASE WHEN path = '/' THEN '' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS norm, host, FALSE AS ipv4 FROM p"""
)
def url_normalised(read):
    norm, host = urls.normalised(F.col("url"))
    return urls_to_clean(read).select("page_id", norm.alias("norm"), host.alias("host"), urls.is_ipv4(host).alias("ipv4"))


@query("SELECT page_id, url AS raw, TRUE AS deobf FROM pages WHERE contains(url, '.')")
def url_candidates_defanged(read):
    text = F.concat(F.lit("see <"), F.replace(F.replace("url", F.lit("http"), F.lit("hxxp")), F.lit("."), F.lit("[.]")), F.lit("> now"))
    return read("pages").select("page_id", F.inline(urls.candidates(text)))


@query(
    r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[.,);\]}''"]+$', ''), '^(https?://[^/?]*)/$', '\1') AS norm FROM pages)
SELECT u.page_id AS doc, u.norm, CASE WHEN u.norm IN (SELECT norm FROM u WHERE page_id % 5 = 0) THEN 'URL_FEED' ELSE 'URL_FEED_HOST' END AS rule FROM u
WHERE u.norm IN (SELECT norm FROM u WHERE page_id % 5 = 0) OR u.host IN (SELECT host FROM u WHERE page_id % 7 = 0)"""
)
def url_feed_join(read):
    norm, host = urls.normalised(F.col("url"))
    hits = read("pages").select(F.col("page_id").alias("doc"), F.lit(0).alias("pos"), norm.alias("norm"), host.alias("host"), F.lit(False).alias("deobf"))
    return feeds.url_then_host(hits, hits.where("doc % 5 = 0"), hits.where("doc % 7 = 0"), "URL_FEED")


def decoded(name: str, make, blobs, sql_text: str, as_hex: bool = True):
    """A query that encodes the texts and decodes the runs it finds again."""

    @query(sql_text)
    def f(read):
        blob = F.explode(blobs(make(F.col("text"))))
        rows = read("documents").select("doc_id", blob.alias("blob"))
        return rows.select("doc_id", F.sha2(F.col("blob").cast("binary"), 256).alias("sha256"))

    QUERIES[name], ORACLES[name] = QUERIES.pop("f"), ORACLES.pop("f")


WHOLE = "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE strlen(text) >= {0}"
whole = lambda text: F.encode(text, "UTF-8")
decoded("decode_base64", lambda t: F.concat(F.lit("x: "), F.regexp_replace(F.base64(whole(t)), r"[\r\n]", "")), encodings.base64_blobs, WHOLE.format(18) + " AND NOT regexp_matches(rtrim(to_base64(encode(text)), '='), '^[0-9A-Fa-f]+$') AND strlen(rtrim(to_base64(encode(text)), '=')) >= 24")
decoded("decode_hex", lambda t: F.concat(F.lit("x: "), F.hex(whole(t))), encodings.hex_blobs, WHOLE.format(16))
decoded("decode_escapes", lambda t: F.regexp_replace(F.hex(whole(t)), "(..)", r"\\x$1"), encodings.escape_blobs, WHOLE.format(8))
decoded("decode_netbios", lambda t: F.translate(F.hex(whole(t)), "0123456789ABCDEF", "ABCDEFGHIJKLMNOP"), encodings.netbios_blobs, WHOLE.format(16) + " AND len(list_filter(regexp_extract_all(substr(hex(encode(text)), 1, 8192), '..'), lambda x: x IN ('09', '0A', '0D') OR x BETWEEN '20' AND '7E')) * 100 >= least(strlen(text), 4096) * 90")


@query("SELECT doc_id, sha256(text) AS sha256, 3 AS layers FROM documents WHERE strlen(text) >= 24")
def decode_layers(read):
    """Hex of base64 of base64, undone one layer at a time."""
    plain = lambda c: F.regexp_replace(F.base64(c), r"[\r\n]", "")
    rows = read("documents").where(F.octet_length("text") >= 24).select("doc_id", F.hex(plain(plain(F.encode("text", "UTF-8")))).alias("layer"))
    for blobs in (encodings.hex_blobs, encodings.base64_blobs, encodings.base64_blobs):
        rows = rows.select("doc_id", F.explode(blobs(F.col("layer"))).alias("blob")).select("doc_id", files.latin1(F.col("blob")).alias("layer"))
    return rows.select("doc_id", F.sha2(F.encode("layer", "ISO-8859-1"), 256).alias("sha256"), F.lit(3).alias("layers"))


@query(
    "WITH f AS (SELECT page_id, 'dir\\' || regexp_extract(url, '([A-Za-z0-9_-]*)[/?#]*[^/]*$', 1) || 'x' || ['.PDF', '.msg', '.txt', '.tar.gz', '.docx', '.JPG'][page_id % 6 + 1] AS name FROM pages) "
    "SELECT page_id, substr(name, 5) AS base, lower('.' || regexp_extract(name, '\\.([^.]+)$', 1)) AS ext, CASE WHEN lower(name) LIKE '%.msg' THEN 'outlook' ELSE '' END AS file_type, "
    "CASE WHEN page_id % 6 IN (0, 2, 5) THEN 'office-doc:' || lower(regexp_extract(name, '\\.([^.]+)$', 1)) END AS mismatch FROM f"
)
def file_metadata(read):
    ext = F.element_at(F.array(*map(F.lit, (".PDF", ".msg", ".txt", ".tar.gz", ".docx", ".JPG"))), (F.col("page_id") % 6 + 1).cast("int"))
    name = F.concat(F.lit("dir\\"), F.regexp_extract("url", "([A-Za-z0-9_-]*)[/?#]*[^/]*$", 1), F.lit("x"), ext)
    named = read("pages").select("page_id", name.alias("name"))
    e = files.extension(F.col("name"))
    return named.select("page_id", files.base_name(F.col("name")).alias("base"), e.alias("ext"), files.file_type(e).alias("file_type"), files.mismatch(e, F.lit("office-doc")).alias("mismatch"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(role || '_' || regexp_replace(text, '[^A-Za-z ]', '', 'g'), '[ _.()\\[\\]-]'), lambda x: length(x) BETWEEN 3 AND 32)[1:6], ',') AS tokens FROM conversations")
def name_tokens(read):
    name = F.concat("role", F.lit("_"), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(".zip"))
    return read("conversations").select("conv_id", "turn", F.array_join(files.name_tokens(name), ",").alias("tokens"))


@query(
    """WITH l AS (SELECT event_id, least(greatest(1 + event_id % 12, 1), 10) AS level FROM events), f AS (SELECT *, (level - 1) / 9.0::DOUBLE AS f FROM l)
SELECT event_id, level::INTEGER AS level, (1 + floor(f * 3 + 0.5))::INTEGER AS decode_depth, (64 + floor(f * 192 + 0.5))::INTEGER AS decode_iters, (4 + floor(f * 60 + 0.5))::INTEGER AS xlm_sheets, (256 + floor(f * 3840 + 0.5))::INTEGER AS xlm_formulas, f > 0.2 AS pdf_deepen, f >= 0.5 AS feeds, greatest(8.0::DOUBLE * (0.5 + 0.5 * f), 1.0) AS timeout_s FROM f"""
)
def effort_profile(read):
    level = effort.resolved((F.col("event_id") % 12 + 1).cast("int"), 5, 10)
    return read("events").select("event_id", level.alias("level")).select("event_id", "level", *[c.alias(n) for n, c in effort.profile(F.col("level"), 10, 8.0).items()])


@query("SELECT event_id, CASE WHEN event_id % 9 <= 1 THEN 10 ELSE greatest(10 - floor((least(greatest(event_id % 11, 1), event_id % 9) - 1) * 9 / (event_id % 9 - 1)::DOUBLE + 0.5), 1) END::INTEGER AS target FROM events")
def effort_auto_target(read):
    return read("events").select("event_id", effort.auto_target(F.col("event_id") % 11, F.col("event_id") % 9, 10).alias("target"))


@query(f"SELECT doc, pos, rule, namespace FROM {MATCHES} QUALIFY row_number() OVER (PARTITION BY doc, namespace, rule ORDER BY pos) = 1")
def match_first_wins(read):
    return matches.first_of_each(events_as_matches(read)).select("doc", "pos", "rule", "namespace")


@query(f"SELECT doc, pos, rule, rule LIKE 'view%' AS allowed FROM {MATCHES} WHERE rule NOT LIKE 'error%'")
def match_policy(read):
    m = events_as_matches(read)
    names = m.select(F.upper("rule").alias("rule")).distinct()
    return matches.policed(m, names.where("rule LIKE 'ERROR%'"), names.where("rule LIKE 'VIEW%'")).select("doc", "pos", "rule", "allowed")


@query(f"SELECT doc, TRUE AS malicious, coalesce(min_by(family, pos) FILTER (family IS NOT NULL), '') AS family, CASE WHEN count(family) > 0 THEN 'family' ELSE 'rule' END AS confidence, string_agg(rule, ',' ORDER BY pos) AS rules FROM {MATCHES} GROUP BY doc")
def verdict(read):
    return matches.verdicts(events_as_matches(read))


@query(
    f"""WITH m AS (SELECT DISTINCT user_id AS doc, event_id % 16 AS idx FROM events), c AS (SELECT [{quoted(matches.WEAK_CLASSES)}] AS names)
SELECT doc, count(*) AS n, string_agg(names[idx + 1], '|' ORDER BY idx) AS classes FROM m, c GROUP BY doc HAVING count(*) >= 3"""
)
def weak_evidence(read):
    names = F.array(*map(F.lit, matches.WEAK_CLASSES))
    markers = read("events").select(F.col("user_id").alias("doc"), F.concat(F.element_at(names, (F.col("event_id") % 16 + 1).cast("int")), F.lit("x")).alias("marker"))
    return matches.weak_evidence(markers)


@query(
    f"""SELECT doc, pos, CASE WHEN contains(hay, 'error_1') THEN 'x' WHEN score >= 75 THEN 'malware' WHEN score < 40 THEN 'suspicious' ELSE 'default' END AS tier,
CASE WHEN score >= 75 THEN 8.0 WHEN score < 40 THEN 2.0 ELSE 4.0 END::DOUBLE AS weight, 0.5 + least(greatest(score, 0), 100) / 100.0::DOUBLE AS factor FROM (SELECT *, '' AS hay FROM {MATCHES})"""
)
def tier_scores(read):
    m = events_as_matches(read)
    tier = scoring.tier(F.col("rule"), F.col("namespace"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.col("score"))
    return m.select("doc", "pos", tier.alias("tier"), scoring.tier_weight(tier).alias("weight"), scoring.score_weight(F.col("score")).alias("factor"))


@query(
    f"""WITH k AS (SELECT doc, namespace, rule, min(pos) AS pos FROM {MATCHES} GROUP BY ALL)
SELECT k.doc, k.namespace AS symbol, max(0.5 + least(m.score, 100) / 100.0::DOUBLE) AS weight, string_agg(k.rule, ',' ORDER BY k.pos) AS options FROM k JOIN {MATCHES} m USING (doc, pos) GROUP BY k.doc, k.namespace"""
)
def symbol_buckets(read):
    once = matches.first_of_each(events_as_matches(read))
    options = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rule"))), lambda x: x["rule"]), ",")
    return once.groupBy("doc", F.col("namespace").alias("symbol")).agg(F.max(scoring.score_weight(F.col("score"))).alias("weight"), options.alias("options"))


@query(f"SELECT rule, count(*) AS hits FROM {MATCHES} GROUP BY rule ORDER BY hits DESC, rule LIMIT 10")
def top_rules(read):
    return matches.top_rules(events_as_matches(read), 10)


@query("SELECT count(*) AS scans, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 100) AS large, count(DISTINCT user_id) AS documents, count(*) FILTER (event_type = 'error') / greatest(count(*), 0.001)::DOUBLE AS error_ratio FROM events")
def scan_counters(read):
    e = read("events")
    failed = F.count_if(F.col("event_type") == "error")
    return e.agg(F.count("*").alias("scans"), failed.alias("errors"), F.count_if(F.col("value") > 100).alias("large"), F.count_distinct("user_id").alias("documents"), rates.ratio(failed, F.count("*")).alias("error_ratio"))


@query("SELECT l_shipdate AS c, l_quantity AS m, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 3")
def repeated_pairs(read):
    return read("lineitem").groupBy(F.col("l_shipdate").alias("c"), F.col("l_quantity").alias("m")).agg(F.count("*").alias("n")).where("n >= 3")


@query(f"SELECT substr(sha256(string_agg(DISTINCT namespace || '/' || rule, chr(10) ORDER BY namespace || '/' || rule)), 1, 16) AS fingerprint FROM {MATCHES}")
def ruleset_fingerprint(read):
    return matches.fingerprint(events_as_matches(read), F.concat_ws("/", "namespace", "rule"))


@query(
    """WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
SELECT doc_id, round(-sum(n / total::DOUBLE * log2(n / total::DOUBLE)), 6) AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id"""
)
def character_entropy(read):
    return read("documents").where("text <> ''").select("doc_id", F.round(structure.character_entropy(F.col("text")), 6).alias("entropy"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS scans, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') / greatest(count(*), 0.001)::DOUBLE AS failure_ratio FROM events GROUP BY 1")
def windowed_rates(read):
    return rates.windowed(read("events").select("ts", F.col("user_id").alias("key"), (F.col("event_type") == "error").alias("failed")), "1 hour")


@query("SELECT user_id AS key, min(event_id) AS leader, count(*) - 1 AS followers FROM events GROUP BY user_id")
def coalesced_requests(read):
    return rates.coalesced(read("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id")))


@query(
    """WITH RECURSIVE o AS (SELECT user_id AS key, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, id, n, ts AS put, FALSE AS hit FROM o WHERE n = 1 UNION ALL
  SELECT o.key, o.id, o.n, CASE WHEN o.ts - r.put <= INTERVAL 7200 SECOND THEN r.put ELSE o.ts END, o.ts - r.put <= INTERVAL 7200 SECOND FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1)
SELECT key, id, hit FROM r"""
)
def cache_lookups(read):
    return cache.lookups(read("events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id")), 7200)


@query(r"SELECT page_id, contains(html, '<script') AS script, len(regexp_extract_all(html, '[\x20-\x7e]{8,}')) AS strings FROM pages")
def page_strings(read):
    return read("pages").select("page_id", F.contains("html", F.lit("<script")).alias("script"), F.size(F.regexp_extract_all("html", F.lit(r"[\x20-\x7e]{8,}"), 0)).cast("long").alias("strings"))


@query("SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'HTML-SMUGGLING-BLOB' ELSE '' END AS marker FROM pages")
def html_smuggling(read):
    made = F.concat("html", F.when(F.col("page_id") % 11 == 0, "<a href='x' download='f'>new Blob(").otherwise(""))
    return read("pages").select("page_id", F.array_join(markers.html_smuggling(made), "|").alias("marker"))


@query("SELECT event_id, event_id % 9 = 0 AS injected FROM events")
def formula_injection(read):
    cell = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("=cmd|'/c x'!A"), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    return read("events").select("event_id", (F.size(markers.csv_injections(cell)) > 0).alias("injected"))


decoded("decode_ampersand", lambda t: F.regexp_replace(F.hex(whole(t)), "(..)", "&H$1, "), encodings.amp_blobs, WHOLE.format(8))
decoded("decode_unicode", lambda t: F.regexp_replace(F.hex(F.encode(t, "UTF-16BE")), "(....)", r"\\u$1"), lambda t: F.transform(encodings.unicode_texts(t), lambda x: F.encode(x, "UTF-8")), "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE length(text) >= 8")
decoded("decode_reversed", lambda t: F.concat(F.lit('x = StrReverse("'), F.reverse(F.replace(t, F.lit('"'), F.lit("'"))), F.lit('")')), lambda t: F.transform(encodings.reversed_literals(t), lambda x: F.encode(x, "UTF-8")), """SELECT doc_id, sha256(replace(text, '"', '''')) AS sha256 FROM documents""")
decoded("decode_replaced", lambda t: F.concat(F.lit('Replace("'), F.replace(F.replace(t, F.lit('"'), F.lit("'")), F.lit("e"), F.lit("#~")), F.lit('", "#~", "e")')), lambda t: F.transform(encodings.replaced_literals(t), lambda x: F.encode(x, "UTF-8")), """SELECT doc_id, sha256(replace(replace(text, '"', ''''), '#~', 'e')) AS sha256 FROM documents""")


@query("SELECT event_id, lpad(upper(to_hex(xor(event_id % 256, event_id % 200))), 2, '0') || lpad(upper(to_hex(xor(7, event_id % 200))), 2, '0') AS bytes FROM events")
def decode_xored(read):
    key = F.col("event_id") % 200
    call = F.concat(F.lit("Array("), (F.col("event_id") % 256).cast("string"), F.lit(", 7) Xor "), key.cast("string"))
    return read("events").select("event_id", F.explode(encodings.xored_arrays(call)).alias("bytes"))


#: Bytes of made bodies that a task holds before it hands them on.
PORTION = 4 << 20


def made_bodies(rows: DataFrame, make, schema: str) -> DataFrame:
    """``rows(key, text)`` to key, body: ``make(key, text)`` of each row. However many rows a batch has, a task holds a
    portion of bodies."""
    import pyarrow as pa

    kinds, names = (pa.string() if schema.split()[1].startswith("string") else pa.int64(), pa.binary()), schema.replace(",", "").split()[::2]

    def work(batches):
        held = size = None
        for batch in batches:
            for key, text in zip(*batch.columns, strict=True):
                if held is None:
                    held, size = ([], []), 0
                held[0].append(key.as_py())
                held[1].append(make(held[0][-1], (text.as_py() or "").encode()))
                size += len(held[1][-1])
                if size >= PORTION:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names)
                    held = None
        if held is not None:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(held, kinds, strict=True)], names)

    return rows.mapInArrow(work, schema)


def packed(read, make) -> DataFrame:
    """Texts packed by ``make`` (bytes to bytes) and unpacked again."""
    made = made_bodies(read("documents").select("doc_id", "text"), lambda _, text: make(text), "doc_id long, body binary")
    return sinks.listing(containers.extracted(made, "doc_id")).select(F.col("key").alias("doc_id"), "pos", "path", "kind", "layer", "sha256")


def zipped(body: bytes) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/text.txt", b"x" + body)
    return out.getvalue()


@query("SELECT doc_id, pos, ['content', 'content!a/text.txt'][pos + 1] AS path, ['gzip', 'zip'][pos + 1] AS kind, pos + 1 AS layer FROM documents, (SELECT unnest([0, 1])::INTEGER AS pos) p")
def container_layers(read):
    """A zip archive in a gzip file: both layers are listed."""
    import gzip

    return packed(read, lambda b: gzip.compress(zipped(b), mtime=0)).drop("sha256")


@query("SELECT doc_id, 0 AS pos, 'a/text.txt' AS path, 'zip' AS kind, 1 AS layer, sha256('x' || text) AS sha256 FROM documents")
def container_zip(read):
    return packed(read, zipped)


@query("SELECT doc_id, 0 AS pos, 'stream0' AS path, 'pdf' AS kind, 1 AS layer, sha256('x' || text) AS sha256 FROM documents")
def container_pdf(read):
    import zlib

    return packed(read, lambda b: b"%PDF-1.4\n1 0 obj\n<< /Filter [/ASCIIHexDecode /FlateDecode] >>\nstream\n" + zlib.compress(b"x" + b).hex().encode() + b">\nendstream\nendobj\n")


@query("SELECT doc_id, 0 AS pos, 'object0' AS path, 'rtf' AS kind, 1 AS layer, sha256('x' || text) AS sha256 FROM documents")
def container_rtf(read):
    return packed(read, lambda b: rb"{\rtf1{\object{\*\objdata " + (b"x" + b).hex().encode() + b"}}}")


@query("SELECT conv_id, turn, role || turn AS passwords FROM conversations")
def stated_passwords(read):
    text = F.concat(F.lit("Password: "), "role", F.col("turn").cast("string"), F.lit(", and "), F.regexp_replace("text", "(?i)pass|pwd|pw|code|senha|contrase|wachtwoord", ""))
    return read("conversations").select("conv_id", "turn", F.array_join(files.stated_passwords(text), ",").alias("passwords"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 10 ELSE floor(1 + least(greatest(value / 50 / 8.0, 0), 1) * 9 + 0.5) END::INTEGER AS level, CASE WHEN event_id % 11 < 1 THEN event_id % 7 ELSE event_id % 11 + sign(event_id % 7 - event_id % 11) END::INTEGER AS stepped FROM events")
def sender_effort(read):
    forced = F.when(F.col("event_type") == "error", F.array(F.lit("R_SPF_FAIL"))).otherwise(F.array(F.lit("NONE")))
    step = effort.stepped((F.col("event_id") % 11).cast("int"), (F.col("event_id") % 7).cast("int"))
    return read("events").select("event_id", effort.sender_level(F.col("value") / 50, forced).alias("level"), step.alias("stepped"))


@query(
    """WITH r AS (SELECT event_id, ['URLHAUS_X', 'MALWAREBAZAAR_X', 'THREATFOX_X', 'trojan_x'][event_id % 4 + 1] AS rule, event_id % 10 = 0 AS canary FROM events)
SELECT event_id, CASE WHEN canary THEN 'log_only' ELSE ['url_feed', 'hash_feed', 'ioc', 'malware'][event_id % 4 + 1] END AS grp, CASE WHEN canary THEN 0.0 ELSE [8.0, 10.0, 7.0, 8.0][event_id % 4 + 1] END::DOUBLE AS weight FROM r"""
)
def symbol_routing(read):
    rule = F.element_at(F.array(*map(F.lit, ("URLHAUS_X", "MALWAREBAZAAR_X", "THREATFOX_X", "trojan_x"))), (F.col("event_id") % 4 + 1).cast("int"))
    name = scoring.tier(rule, F.lit(""), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(50))
    group = scoring.route(rule, F.col("event_id") % 10 == 0, F.lit(False), name)
    return read("events").select("event_id", group.alias("grp")).select("event_id", "grp", scoring.group_weight(F.col("grp")).alias("weight"))


@query(f"SELECT doc, '[' || string_agg('{{\"rule\":\"' || rule || '\",\"namespace\":\"' || namespace || '\"}}', ',' ORDER BY pos) || ']' AS response FROM {MATCHES} GROUP BY doc")
def json_responses(read):
    found = events_as_matches(read)
    return sinks.json_responses(found, found)


@query("SELECT metric, value FROM (SELECT count(*)::DOUBLE AS scans, sum(value > 100)::DOUBLE AS large FROM events) UNPIVOT (value FOR metric IN (scans, large))")
def metrics_text(read):
    return sinks.metrics(read("events").agg(F.count("*").alias("scans"), F.count_if(F.col("value") > 100).alias("large")))


from palimpsest.plans import binaries, cases, containers_made, flows, rule_flows, states  # noqa: E402, F401 -- these register their own queries
