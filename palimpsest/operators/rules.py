"""Rules as columns: strings and conditions of a catalogue compile to booleans, so that Catalyst evaluates them all
in one pass over a document instead of joining documents with rules.

Texts hold one byte a character. A condition is built from ``matches``, ``some``, ``times``, ``at``, ``smaller``,
``word_at`` and ``variable``, joined by ``&``, ``|`` and ``~``; without one, ``least`` of the strings must match and those
in ``none`` must not."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from palimpsest.operators.atoms import Facts

NOTHING: frozenset[str] = frozenset()
KINDS = ("text", "regex", "hex")


def literal_pattern(value: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", value)


def wide_pattern(value: str) -> str:
    return "".join(literal_pattern(c) + r"\x00" for c in value)


def wide_regex(value: str) -> str:
    """The expression for text with a zero behind every character. References to groups and word boundaries have no such
    form and raise a ValueError."""
    import re._constants as c
    import re._parser as parser

    category = {c.CATEGORY_DIGIT: r"\d", c.CATEGORY_NOT_DIGIT: r"\D", c.CATEGORY_SPACE: r"\s", c.CATEGORY_NOT_SPACE: r"\S", c.CATEGORY_WORD: r"\w", c.CATEGORY_NOT_WORD: r"\W"}
    code = lambda n: rf"\x{n:02X}"

    def item(op, arg) -> str:
        if op is c.LITERAL:
            return code(arg)
        if op is c.RANGE:
            return f"{code(arg[0])}-{code(arg[1])}"
        return "^" if op is c.NEGATE else category[arg]

    def emit(tree) -> str:
        out = []
        for op, arg in tree:
            if op is c.LITERAL:
                out.append(code(arg) + r"\x00")
            elif op is c.NOT_LITERAL:
                out.append(f"[^{code(arg)}]" + r"\x00")
            elif op is c.ANY:
                out.append(r".\x00")
            elif op is c.IN:
                out.append("[" + "".join(item(*x) for x in arg) + r"]\x00")
            elif op is c.BRANCH:
                out.append("(?:" + "|".join(map(emit, arg[1])) + ")")
            elif op is c.SUBPATTERN:
                out.append(f"(?:{emit(arg[3])})")
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
                low, high, inner = arg
                mark = {c.MAX_REPEAT: "", c.MIN_REPEAT: "?", c.POSSESSIVE_REPEAT: "+"}[op]
                out.append(f"(?:{emit(inner)}){{{low},{'' if high is c.MAXREPEAT else high}}}{mark}")
            elif op is c.AT and arg in (c.AT_BEGINNING, c.AT_END):
                out.append("^" if arg is c.AT_BEGINNING else "$")
            elif op in (c.ASSERT, c.ASSERT_NOT):
                out.append(f"(?{'<' if arg[0] < 0 else ''}{'=' if op is c.ASSERT else '!'}{emit(arg[1])})")
            else:
                raise ValueError(f"no wide form: {op}")
        return "".join(out)

    return emit(parser.parse(value))


def hex_pattern(value: str) -> str:
    """Bytes as hexadecimal digits: ``??``, half wildcards, jumps ``[n-m]`` and alternatives ``(AA|BB CC)``."""
    out = []
    for token in re.findall(r"\[[^\]]*\]|[()|]|[0-9A-Fa-f?]{2}|\S", value):
        if token in "()|":
            out.append("(?:" if token == "(" else token)
        elif token[0] == "[":
            low, _, high = token[1:-1].partition("-")
            out.append(f".{{{int(low)}}}" if "-" not in token else f".{{{int(low or 0)},{int(high) if high else ''}}}")
        elif token == "??":
            out.append(".")
        elif token[0] == "?":
            out.append("[" + "".join(rf"\x{i:X}{token[1]}" for i in range(16)) + "]")
        elif token[1:] == "?":
            out.append(rf"[\x{token[0]}0-\x{token[0]}F]")
        elif re.fullmatch("[0-9A-Fa-f]{2}", token):
            out.append(rf"\x{token}")
        else:
            raise ValueError(f"not hexadecimal: {token}")
    return "(?s)" + "".join(out)


@dataclass(frozen=True)
class Scope:
    """What a condition sees: the text, the size of the body, and variables by name."""

    text: Column
    size: Column
    variables: dict[str, Column] = field(default_factory=dict)
    executable: Column | None = None


@dataclass(frozen=True)
class Condition:
    """``column`` is the condition as a column. ``plain`` is the same for one text within a task (see
    :mod:`palimpsest.operators.atoms`), where it has such a form. ``may`` and ``must`` say of a text without any of the
    rule's strings whether the condition can hold there, and whether it always does."""

    column: Callable[[Rule, Scope], Column]
    plain: Callable[[Rule, Facts], bool] | None = None
    may: Callable[[Rule], bool] = lambda r: True
    must: Callable[[Rule], bool] = lambda r: False

    def both(self, other: Condition, f: Callable[[bool, bool], bool]) -> Callable[[Rule, Facts], bool] | None:
        a, b = self.plain, other.plain
        return None if a is None or b is None else lambda r, s: f(a(r, s), b(r, s))

    def __and__(self, other: Condition) -> Condition:
        return Condition(lambda r, s: self.column(r, s) & other.column(r, s), self.both(other, bool.__and__), lambda r: self.may(r) and other.may(r), lambda r: self.must(r) and other.must(r))

    def __or__(self, other: Condition) -> Condition:
        return Condition(lambda r, s: self.column(r, s) | other.column(r, s), self.both(other, bool.__or__), lambda r: self.may(r) or other.may(r), lambda r: self.must(r) or other.must(r))

    def __invert__(self) -> Condition:
        plain = self.plain
        return Condition(lambda r, s: ~self.column(r, s), None if plain is None else lambda r, s: not plain(r, s), lambda r: not self.must(r), lambda r: not self.may(r))


def never(r: Rule) -> bool:
    return False


def matches(key: str) -> Condition:
    return Condition(lambda r, s: r.string(key, s.text), lambda r, s: s.found(key), never)


def some(n: int | str, *keys: str) -> Condition:
    """``n`` of the strings, "all" or "any"; a key may end in a star, and none means every string."""

    def wanted(rule: Rule) -> tuple[list[str], int]:
        known = [k for k in rule.strings if not keys or any(k == x or (x[-1:] == "*" and k.startswith(x[:-1])) for x in keys)]
        return known, {"all": len(known), "any": 1}.get(n, n)

    def column(rule: Rule, scope: Scope) -> Column:
        known, least = wanted(rule)
        hits = [rule.string(k, scope.text).cast("int") for k in known]
        return reduce(lambda a, b: a + b, hits, F.lit(0)) >= least

    def plain(rule: Rule, facts: Facts) -> bool:
        known, least = wanted(rule)
        return sum(map(facts.found, known)) >= least

    nothing = lambda rule: wanted(rule)[1] <= 0
    return Condition(column, plain, nothing, nothing)


def times(key: str, more_than: int) -> Condition:
    """More places than that, overlapping ones too."""

    def column(rule: Rule, scope: Scope) -> Column:
        flags, pattern = rule.pattern(key)
        return F.regexp_count(scope.text, F.lit(f"{flags}(?={pattern})")) > more_than

    return Condition(column, lambda r, s: s.places(key, more_than + 1) > more_than, lambda r: more_than < 0, lambda r: more_than < 0)


def at(key: str, offset: int) -> Condition:
    """The string stands at this place."""

    def column(rule: Rule, scope: Scope) -> Column:
        flags, pattern = rule.pattern(key)
        return F.substring(scope.text, offset + 1, 1 << 20).rlike(f"{flags}^(?:{pattern})")

    return Condition(column, lambda r, s: s.stands(key, offset), never)


def smaller(size: int) -> Condition:
    return Condition(lambda r, s: s.size < size, lambda r, s: s.size < size)


def word_at(offset: int, value: int) -> Condition:
    """Two bytes, the low one first."""
    two = value.to_bytes(2, "little").decode("latin-1")
    return Condition(lambda r, s: F.substring(s.text, offset + 1, 2) == two, lambda r, s: s.text[offset : offset + 2] == two)


def variable(name: str, value: str | bool) -> Condition:
    """An outer variable has this value; one that isn't given has none."""
    return Condition(lambda r, s: F.coalesce(s.variables[name] == value, F.lit(False)) if name in s.variables else F.lit(False), lambda r, s: s.variables.get(name) == value)


def pe(test: Callable[[Column], Column]) -> Condition:
    """A test of the struct that :func:`palimpsest.operators.executables.headers` reads; false for other bodies."""
    return Condition(lambda r, s: F.lit(False) if s.executable is None else F.coalesce(test(s.executable), F.lit(False)))


def pe_section(test: Callable[[Column], Column]) -> Condition:
    """Some section passes a test."""
    return pe(lambda p: F.exists(p["sections"], test))


def pe_imports(library: str, function: str | None = None) -> Condition:
    """The body imports from a library, whatever its case, or a certain function of it."""
    named = lambda x: x["library"] == library.lower()
    return pe(lambda p: F.exists(p["imports"], lambda x: named(x) if function is None else named(x) & F.array_contains(x["functions"], function)))


@dataclass(frozen=True)
class Rule:
    """``strings`` maps an id to (kind, value, options: nocase, wide, ascii, fullword)."""

    name: str
    namespace: str
    strings: dict[str, tuple[str, str, frozenset[str]]]
    least: int = 1
    none: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    meta: dict[str, str] = field(default_factory=dict)
    condition: Condition | None = None
    private: bool = False

    def pattern(self, key: str) -> tuple[str, str]:
        """Flags and pattern. A wide string stands with zeros between its bytes, and without them if it is ascii too."""
        kind, value, options = self.strings[key]
        if kind == "hex":
            return "(?s)", hex_pattern(value).removeprefix("(?s)")
        pattern = value if kind == "regex" else literal_pattern(value)
        if "wide" in options:
            wide = wide_pattern(value) if kind == "text" else wide_regex(value)
            pattern = f"(?:{wide}|{pattern})" if "ascii" in options else wide
        if "fullword" in options:
            pattern = rf"(?<![A-Za-z0-9]){pattern}(?![A-Za-z0-9])"
        return "(?i)" if "nocase" in options else "", pattern

    def string(self, key: str, text: Column) -> Column:
        kind, value, options = self.strings[key]
        if kind == "text" and not options - {"ascii"}:
            return F.contains(text, F.lit(value))
        return text.rlike("".join(self.pattern(key)))

    def plain(self, facts: Facts) -> bool:
        """The same for one text within a task."""
        if self.condition is not None:
            return self.condition.plain(self, facts)
        return sum(facts.found(k) for k in self.strings if k not in self.none) >= self.least and not any(map(facts.found, self.none))

    def holds(self, scope: Scope) -> Column:
        if self.condition is not None:
            return self.condition.column(self, scope)
        wanted = [self.string(k, scope.text).cast("int") for k in self.strings if k not in self.none]
        out = reduce(lambda a, b: a + b, wanted) >= self.least
        for key in self.none:
            out = out & ~self.string(key, scope.text)
        return out


def matched(docs: DataFrame, text: Column, rules: list[Rule], *keep: str, size: Column | None = None, variables: dict[str, Column] | None = None, executable: Column | None = None) -> DataFrame:
    """The columns kept, pos, rule, namespace, tags, meta: a row for each rule that holds, but private ones."""
    scope = Scope(text, F.octet_length(text) if size is None else size, variables or {}, executable)
    entry = lambda i, r: F.struct(F.lit(i).alias("pos"), F.lit(r.name).alias("rule"), F.lit(r.namespace).alias("namespace"), F.array(*map(F.lit, r.tags)).cast("array<string>").alias("tags"), F.create_map(*[F.lit(x) for kv in r.meta.items() for x in kv]).cast("map<string,string>").alias("meta"))
    hits = F.filter(F.array(*[F.when(r.holds(scope), entry(i, r)) for i, r in enumerate(rules) if not r.private]), lambda x: x.isNotNull())
    return docs.select(*keep, F.inline(hits))


def rule_set(rules: list[Rule], kind: str, small: frozenset[str] = NOTHING, deny: frozenset[str] = NOTHING) -> list[Rule]:
    """Of a catalogue: all rules, those for markers, or the small set for big bodies (``small`` namespaces); without
    denied ones, whose names are in lower case; private rules can't be denied."""
    allowed = [r for r in rules if r.private or r.name.lower() not in deny]
    return {"full": allowed, "marker": [r for r in allowed if "marker" in r.tags], "small": [r for r in allowed if r.namespace in small]}[kind]


FIELDS = "rule string, namespace string, tags array<string>, meta map<string,string>, strings array<struct<id:string,kind:string,value:string,options:array<string>>>, least int, none array<string>"


def loaded(lines: DataFrame) -> tuple[list[Rule], DataFrame]:
    """Rules of ``lines(namespace, value)``, one JSON object each, in order of namespace and rule; and the bad ones as a
    table (namespace, value, error), which are left out. A catalogue is thousands of rules at most, so it is collected."""
    good, bad = [], []
    java = lines.sparkSession._jvm.java.util.regex.Pattern
    parsed = lines.select(F.col("namespace").alias("file"), "value", F.from_json("value", FIELDS).alias("r")).orderBy("file", "value")
    for row in parsed.toLocalIterator():
        try:
            json.loads(row.value)
            r = row.r
            strings = {s["id"]: (s["kind"], s["value"], frozenset(s["options"] or ())) for s in r["strings"] or ()}
            rule = Rule(r["rule"] or "", r["namespace"] or row.file, strings, r["least"] or 1, tuple(r["none"] or ()), tuple(r["tags"] or ()), dict(r["meta"] or {}))
            if not rule.name or not strings or any(k not in KINDS for k, _, _ in strings.values()) or not set(rule.none) < set(strings):
                raise ValueError("a rule needs a name and strings of known kinds")
            for key in strings:
                re.compile("".join(rule.pattern(key)))
                java.compile("".join(rule.pattern(key)))  # the engine that will run it knows other forms than Python's
            good.append(rule)
        except (ValueError, TypeError, re.error, IllegalArgumentException) as problem:
            bad.append((row.file, row.value, str(problem)))
    return good, lines.sparkSession.createDataFrame(bad, "namespace string, value string, error string")


class Engine:
    """A catalogue that can be exchanged as a whole: a new one without a single good rule leaves the old one in place."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = list(rules or [])

    def register_rules(self, lines: DataFrame) -> DataFrame:
        """Take the rules of ``lines`` (see :func:`loaded`); returns what was wrong with the bad ones."""
        good, bad = loaded(lines)
        if good:
            self.rules = good
        return bad

    def matched(self, docs: DataFrame, text: Column, *keep: str) -> DataFrame:
        return matched(docs, text, self.rules, *keep)


#: Functions that SQL may call, as SQL of their own, so that they stay within Catalyst.
SQL_FUNCTIONS = {
    "score_weight(score DOUBLE) RETURNS DOUBLE": "CASE WHEN score IS NULL THEN 1.0D ELSE 0.5D + least(greatest(score, 0), 100) / 100.0D END",
    "is_ipv4(host STRING) RETURNS BOOLEAN": r"host RLIKE '^[0-9]*(\\.[0-9]*){3}$'",
    "file_extension(name STRING) RETURNS STRING": r"lower(regexp_extract(trim(regexp_replace(name, '^.*[/\\\\]', '')), '^.+(\\.[^.]+)$', 1))",
    "container_magic(body BINARY) RETURNS BOOLEAN": "hex(substring(body, 1, 4)) IN ('504B0304', 'D0CF11E0', '25504446') OR hex(substring(body, 1, 2)) = '4D5A'",
}


def register_functions(spark) -> list[str]:
    """Make the functions known to SQL for this session; returns their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in SQL_FUNCTIONS]
