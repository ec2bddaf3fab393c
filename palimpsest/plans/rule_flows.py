"""Queries of the rule language over stated bodies, and of a catalogue that is loaded from rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import atoms, rules
from palimpsest.operators.rules import NOTHING, Rule, at, matches, smaller, some, times, variable, word_at
from palimpsest.plans.catalogue import ORACLES, QUERIES, query

BOTH, ANY_CASE = frozenset({"ascii", "wide"}), frozenset({"ascii", "wide", "nocase"})
#: Strings and limits of rules for scripts, formula editors, shell code and macro sheets.
LOCAL = [
    Rule("JS_Obfusc_StringConcat_Accumulate", "js", {"acc": ("regex", r'this\.[a-zA-Z_$][\w$]* = this\.[a-zA-Z_$][\w$]* \+ "', BOTH)}, condition=smaller(16 << 20) & times("acc", 200), tags=("suspicious",), meta={"score": "60"}),
    Rule("JS_Dropper_CharCodeArray_ActiveX", "js", {"dec": ("regex", r"String\.fromCharCode\(\([a-zA-Z_$][\w$]*\[[a-zA-Z_$][\w$]*\] - \d{1,3} \+ 256\) % 256\)", ANY_CASE), "ax": ("text", "ActiveXObject", ANY_CASE), "run": ("regex", r"\.Run\(", ANY_CASE), "ws": ("text", "WScript", ANY_CASE)}, condition=smaller(16 << 20) & matches("dec") & matches("ax") & (matches("run") | matches("ws"))),
    Rule("JS_Dropper_XorArray_ActiveX", "js", {"xor": ("regex", r"String\.fromCharCode\([a-zA-Z_$][\w$]{0,40}\[[a-zA-Z_$][\w$]{0,40}\] ?\^ ?[a-zA-Z_$][\w$]{0,40}\.charCodeAt\(", ANY_CASE), "ax": ("text", "ActiveXObject", ANY_CASE)}, condition=smaller(16 << 20) & some("all")),
    Rule("Exploit_EquationEditor", "ole", {"ole_magic": ("hex", "D0 CF 11 E0 A1 B1 1A E1", NOTHING), "eq_native": ("text", "Equation Native", frozenset({"wide"})), "eq_clsid": ("hex", "02 CE 02 00 00 00 00 00 C0 00 00 00 00 00 00 46", NOTHING)}, condition=at("ole_magic", 0) & (matches("eq_native") | matches("eq_clsid"))),
    Rule("Exploit_EquationEditor_MTEF", "ole", {"ole_magic": ("hex", "D0 CF 11 E0 A1 B1 1A E1", NOTHING), "eq_native": ("text", "Equation Native", frozenset({"wide"})), "mtef_hdr": ("hex", "03 01 01 03 0A", NOTHING)}, condition=at("ole_magic", 0) & matches("eq_native") & matches("mtef_hdr")),
    Rule("Shellcode_GetEIP", "shellcode", {"callpop": ("hex", "E8 00 00 00 00 (58|59|5A|5B|5E|5F)", NOTHING)}, condition=~word_at(0, 0x5A4D) & matches("callpop")),
    # Rules of our own, for parts of the language that those above leave out.
    Rule("XLM_Auto_And_Danger", "xlm", {"open": ("text", "XLM-AUTO-OPEN", NOTHING), "close": ("text", "XLM-AUTO-CLOSE", NOTHING), "hidden": ("text", "XLM-HIDDEN-MACROSHEET ", NOTHING), "danger": ("text", "XLM-DANGEROUS-FUNC EXEC", NOTHING)}, condition=some("any", "open", "close") & some("any", "hid*", "dang*"), tags=("marker",)),
    Rule("Macro_Only", "vba", {"shell": ("text", "Shell", frozenset({"nocase", "fullword"}))}, condition=variable("VBA", True) & matches("shell")),
    Rule("Hex_Jumps", "hex", {"a": ("hex", "4? 5A [2-4] ?0 FF", NOTHING)}, condition=matches("a")),
]
ACCUMULATE = 'this.a = this.a + "x"\n'
BODIES = [
    (ACCUMULATE.encode() * 201, "JS_Obfusc_StringConcat_Accumulate"),
    (ACCUMULATE.encode() * 200, ""),
    (b"String.fromCharCode((a[i] - 12 + 256) % 256); new activexobject(x).Run(", "JS_Dropper_CharCodeArray_ActiveX"),
    (b"String.fromCharCode((a[i] - 12 + 256) % 256); new ActiveXObject(x)", ""),
    ("String.fromCharCode((a[i] - 12 + 256) % 256); new ActiveXObject(x).Run(".encode("utf-16-le"), "JS_Dropper_CharCodeArray_ActiveX"),
    (ACCUMULATE.encode("utf-16-le") * 201, "JS_Obfusc_StringConcat_Accumulate"),
    (b"string.fromcharcode(a[i] ^ k.charCodeAt( " + "ActiveXObject".encode("utf-16-le"), "JS_Dropper_XorArray_ActiveX"),
    (bytes.fromhex("D0CF11E0A1B11AE1") + "Equation Native".encode("utf-16-le"), "Exploit_EquationEditor"),
    (bytes.fromhex("D0CF11E0A1B11AE1") + "Equation Native".encode("utf-16-le") + bytes.fromhex("030101030A"), "Exploit_EquationEditor,Exploit_EquationEditor_MTEF"),
    (b"x" + bytes.fromhex("D0CF11E0A1B11AE102CE020000000000C000000000000046"), ""),
    (b"\x90\x90" + bytes.fromhex("E8000000005E"), "Shellcode_GetEIP"),
    (b"MZ" + bytes.fromhex("E8000000005E"), ""),
    (b"XLM-AUTO-OPEN\nXLM-HIDDEN-MACROSHEET a", "XLM_Auto_And_Danger"),
    (b"XLM-AUTO-OPEN\nXLM-AUTO-CLOSE", ""),
    (b"macro: shell x", "Macro_Only"),
    (b"macro: shelly x", ""),
    (bytes.fromhex("425A010203F0FF"), "Hex_Jumps"),
    (bytes.fromhex("425A01F0FF"), ""),
    (b"", ""),
]


def local_rules(spark, sf_dir):
    body = F.unhex(F.element_at(F.array(*[F.lit(b.hex()) for b, _ in BODIES]), (F.col("event_id") % len(BODIES) + 1).cast("int")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", body.alias("body")).withColumn("text", F.decode("body", "ISO-8859-1"))
    found = rules.matched(rows, F.col("text"), LOCAL, "event_id", size=F.octet_length("body"), variables={"VBA": F.startswith("text", F.lit("macro:"))})
    return found.select("event_id", "rule")


NAMES = ", ".join("'" + n + "'" for _, n in BODIES)
QUERIES["local_rules"] = local_rules
ORACLES["local_rules"] = f"SELECT event_id, unnest(string_split(names, ',')) AS rule FROM (SELECT event_id, ([{NAMES}])[event_id % {len(BODIES)} + 1] AS names FROM events) WHERE names <> ''"


def catalogue_lines(read):
    line = F.when(F.col("r_regionkey") == 0, F.lit("{broken")).when(F.col("r_regionkey") == 1, F.lit('{"rule": "bad", "strings": [{"id": "a", "kind": "regex", "value": "("}]}'))
    good = F.to_json(F.struct(F.concat(F.lit("is_"), F.lower("r_name")).alias("rule"), F.array(F.struct(F.lit("a").alias("id"), F.lit("text").alias("kind"), F.col("r_name").alias("value"), F.array(F.lit("nocase"), F.lit("fullword")).alias("options"))).alias("strings")))
    return read("region").select(F.lit("regions").alias("namespace"), line.alias("bad"), good.alias("good")).select("namespace", F.coalesce("bad", "good").alias("value"))


@query("SELECT n_nationkey, 'is_' || lower(r_name) AS rule, 'regions' AS namespace FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 1")
def loaded_rules(read):
    """Rules from rows, of which two are bad and left out, on texts that name a region."""
    engine = rules.Engine()
    engine.register_rules(catalogue_lines(read))
    named = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(" ", "n_name", F.lower("r_name"), F.lit("x")).alias("text"))
    return engine.matched(named, F.col("text"), "n_nationkey").select("n_nationkey", "rule", "namespace")


@query("SELECT 'regions' AS namespace, count(*) AS bad FROM region WHERE r_regionkey < 2")
def bad_rules(read):
    return rules.loaded(catalogue_lines(read))[1].groupBy("namespace").agg(F.count("*").alias("bad"))


def sql_functions(spark, sf_dir):
    rules.register_functions(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("palimpsest_events")
    return spark.sql("SELECT event_id, score_weight(value) AS weight, is_ipv4(concat('1.2.', event_id, '.4')) AS ipv4, file_extension(concat('a/b.', event_type)) AS ext, container_magic(CAST('MZ' AS BINARY)) AS magic FROM palimpsest_events")


QUERIES["sql_functions"] = sql_functions
ORACLES["sql_functions"] = "SELECT event_id, 0.5 + least(greatest(value, 0), 100) / 100.0::DOUBLE AS weight, TRUE AS ipv4, '.' || event_type AS ext, TRUE AS magic FROM events"


#: Syllables; a rule for each pair of them.
SYLLABLES = ("the", "and", "tion", "ing", "er", "on", "ea", "th", "st", "re", "in", "an", "ha", "es", "at", "ou", "ti", "ed", "or", "nd", "ly", "sh", "wh", "ble", "ción", "que", "ado", "os", "as", "ie", "ment", "elle", "eau", "eux", "oi", "chen", "lich", "ung", "und", "der", "gen", "ver", "bar", "keit", "heit")


def pair_rules() -> list[Rule]:
    """Two thousand rules: most for a text, some for a pattern, some that ask for two strings or for the lack of one."""
    latin = lambda s: s.encode().decode("latin-1")
    found = []
    for i, (a, b) in enumerate((a, b) for a in SYLLABLES for b in SYLLABLES):
        text = ("text", latin(a + b), NOTHING)
        kind = i % 10
        if kind == 7:
            strings, condition = {"a": ("regex", latin(a) + r"\s+" + latin(b), NOTHING)}, None
        elif kind == 8:
            strings, condition = {"a": text, "b": ("text", latin(b + a), NOTHING)}, some("all")
        elif kind == 9:
            strings, condition = {"a": text, "b": ("text", "idiot", NOTHING)}, matches("a") & ~matches("b")
        else:
            strings, condition = {"a": text}, None
        found.append(Rule(f"pair_{i}", "pairs", strings, condition=condition))
    return found


@query(
    f"""WITH s AS (SELECT unnest([{', '.join(f"'{x}'" for x in SYLLABLES)}]) AS s, unnest(range({len(SYLLABLES)})) AS k),
p AS (SELECT a.k * {len(SYLLABLES)} + b.k AS i, a.s AS a, b.s AS b FROM s a, s b)
SELECT doc_id, CAST(i AS INTEGER) AS pos, 'pair_' || i AS rule FROM documents, p WHERE CASE i % 10 WHEN 7 THEN regexp_matches(text, a || '[ \\t\\n\\x0B\\f\\r]+' || b) WHEN 8 THEN contains(text, a || b) AND contains(text, b || a)
WHEN 9 THEN contains(text, a || b) AND NOT contains(text, 'idiot') ELSE contains(text, a || b) END"""
)
def catalogue_matches(read):
    """Two thousand rules, of which an automaton names the candidates."""
    text = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    docs = read("documents").select("doc_id", "text").repartition("doc_id")  # however few row groups the file has
    return atoms.matched(docs, text, pair_rules(), "doc_id").select("doc_id", "pos", "rule")
