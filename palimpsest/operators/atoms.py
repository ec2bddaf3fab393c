"""Large catalogues of rules: one automaton finds which rules a text can match before any pattern runs.

Every string of a rule gives atoms: literals of which at least one stands, in lower case, wherever the string
matches. All atoms of a catalogue make one Aho-Corasick automaton, which is broadcast (it is as large as the catalogue,
whatever the data) and reads a text once. A rule is a candidate if an atom of one of its strings was found, or if it can
hold without any string (it negates one, or asks for something else), or has a string without an atom. Only
strings of candidates with an atom found, or without atoms, are matched by their patterns.

Rules with conditions that exist as columns alone (headers of executables) are evaluated as columns beside."""

from __future__ import annotations

import pickle
import re
import re._constants as c
import re._parser as parser
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import rules as columns
from palimpsest.operators.rules import Rule

#: The shortest literal that tells anything, and the longest part of one that is looked for.
LEAST, MOST = 3, 16


def lowered(text: str) -> str:
    """ASCII letters in lower case; a text holds one byte a character."""
    return text.encode("latin-1").lower().decode("latin-1")


def best(choices: list[frozenset[str] | None]) -> frozenset[str] | None:
    """Of sets of which each is enough, the one whose shortest literal is longest."""
    known = [x for x in choices if x]
    return max(known, key=lambda x: (min(map(len, x)), -len(x))) if known else None


def needed(tree: parser.SubPattern) -> frozenset[str] | None:
    """Literals of which a match holds one; None if there is no such set."""
    found: list[frozenset[str] | None] = []
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is c.LITERAL and arg < 256:
            run += chr(arg)
            continue
        if len(run) >= LEAST:
            found.append(frozenset([lowered(run)]))
        run = ""
        if op is c.SUBPATTERN:
            found.append(needed(arg[3]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] > 0:
            found.append(needed(arg[2]))
        elif op is c.BRANCH:
            parts = [needed(x) for x in arg[1]]
            found.append(frozenset().union(*parts) if all(parts) else None)
    return best(found)


def atoms(rule: Rule, key: str) -> frozenset[str] | None:
    """Of one string; the pattern itself is read, so that every option counts."""
    flags, pattern = rule.pattern(key)
    known = needed(parser.parse(pattern))
    return known and frozenset(a[:MOST] for a in known)


class Facts:
    """What a rule's condition asks of one text."""

    def __init__(self, matcher: Matcher, text: str, size: int, variables: dict[str, object]):
        self.matcher, self.text, self.size, self.variables = matcher, text, size, variables
        self.seen: set[int] = set()
        self.at, self.known = 0, {}

    def about(self, at: int) -> Facts:
        """The same text, asked by another rule."""
        self.at, self.known = at, {}
        return self

    def found(self, key: str) -> bool:
        if key not in self.known:
            of = self.matcher.numbers[self.at][key]
            self.known[key] = (of in self.seen or of in self.matcher.open) and self.matcher.stands(of, self.text)
        return self.known[key]

    def places(self, key: str, enough: int) -> int:
        """Where the string matches, overlapping places too; counting stops at ``enough``."""
        if not self.found(key):
            return 0
        pattern, n, at = self.matcher.pattern(self.matcher.numbers[self.at][key]), 0, 0
        while n < enough and (hit := pattern.search(self.text, at)) is not None:
            n, at = n + 1, hit.start() + 1
        return n

    def stands(self, key: str, offset: int) -> bool:
        return self.found(key) and self.matcher.pattern(self.matcher.numbers[self.at][key]).match(self.text[offset : offset + (1 << 20)]) is not None


class Matcher:
    """A catalogue with its automaton. Patterns are compiled when first needed, in each task's process."""

    def __init__(self, catalogue: list[Rule]):
        self.rules = catalogue
        self.numbers: list[dict[str, int]] = []
        self.patterns: list[str] = []
        self.owner: list[int] = []
        self.open: set[int] = set()
        self.literals: list[str | None] = []
        self.single: list[int | None] = []
        self.always: list[int] = []
        self.compiled: dict[int, re.Pattern] = {}
        holders: dict[str, list[int]] = {}
        for at, rule in enumerate(catalogue):
            self.numbers.append({})
            ungated = rule.condition.may(rule) if rule.condition is not None else rule.least <= 0
            for key in rule.strings:
                of = len(self.patterns)
                self.numbers[at][key] = of
                self.patterns.append("".join(rule.pattern(key)))
                self.owner.append(at)
                kind, value, options = rule.strings[key]
                self.literals.append(value if kind == "text" and not options - {"ascii"} else None)
                if known := atoms(rule, key):
                    for a in known:
                        holders.setdefault(a, []).append(of)
                else:
                    self.open.add(of)
                    ungated = True
            alone = rule.condition is None and rule.least == 1 and not rule.none and len(rule.strings) == 1
            self.single.append(self.numbers[at][next(iter(rule.strings))] if alone else None)
            if ungated:
                self.always.append(at)
        self.automaton = ahocorasick.Automaton()
        self.holders = list(holders.values())
        for i, a in enumerate(holders):
            self.automaton.add_word(a, i)
        if holders:
            self.automaton.make_automaton()

    def __getstate__(self) -> dict:
        """Conditions are functions and travel as they are; the texts of patterns do, their compiled forms don't."""
        return self.__dict__ | {"compiled": {}}

    def pattern(self, of: int) -> re.Pattern:
        if of not in self.compiled:
            self.compiled[of] = re.compile(self.patterns[of], re.ASCII)
        return self.compiled[of]

    def stands(self, of: int, text: str) -> bool:
        """Whether a string matches somewhere; one without options does where it stands as it is."""
        literal = self.literals[of]
        return literal in text if literal is not None else self.pattern(of).search(text) is not None

    def holding(self, text: str, size: int, variables: dict[str, object]) -> list[int]:
        """Places of the rules that hold, in order."""
        facts = Facts(self, text, size, variables)
        if len(self.automaton):
            for i in set(map(itemgetter(1), self.automaton.iter(lowered(text)))):  # a text has far more hits than different atoms
                facts.seen.update(self.holders[i])
        asked = sorted({self.owner[of] for of in facts.seen}.union(self.always))
        # most rules of a large catalogue are one string, and were asked for as one of its atoms was seen
        return [at for at in asked if (self.stands(of, text) if (of := self.single[at]) is not None else self.rules[at].plain(facts.about(at)))]


def matched(docs: DataFrame, text: Column, catalogue: list[Rule], *keep: str, size: Column | None = None, variables: dict[str, Column] | None = None, executable: Column | None = None) -> DataFrame:
    """The same rows as :func:`palimpsest.operators.rules.matched`. A null text matches nothing."""
    shown = [(i, r) for i, r in enumerate(catalogue) if not r.private]
    plain = [(i, r) for i, r in shown if r.condition is None or r.condition.plain is not None]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(Matcher([r for _, r in plain])))
    given, names = variables or {}, list(variables or {})
    rows = docs.select(*keep, text.alias("text_"), (F.octet_length(text) if size is None else size).cast("long").alias("size_"), *[v.alias(f"variable_{n}") for n, v in given.items()])
    kept = docs.select(*keep).schema
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "at int"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = pickle.loads(sent.value)  # noqa: S301 -- written above
        for batch in batches:
            n = len(kept)
            found = [] if not batch.num_rows else [matcher.holding(t, s, dict(zip(names, v, strict=True))) if t is not None else [] for t, s, *v in zip(*(batch.column(i).to_pylist() for i in range(n, batch.num_columns)), strict=True)]
            row = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.record_batch([*[batch.column(i).take(row) for i in range(n)], pa.array([at for f in found for at in f], pa.int32())], names=[*kept.names, "at"])

    listed = spark.createDataFrame([(k, i, r.name, r.namespace, list(r.tags), dict(r.meta)) for k, (i, r) in enumerate(plain)], "at int, pos int, rule string, namespace string, tags array<string>, meta map<string,string>")
    found = rows.mapInArrow(work, schema).join(F.broadcast(listed), "at").select(*keep, "pos", "rule", "namespace", "tags", "meta")
    rest = [(i, r) for i, r in shown if r.condition is not None and r.condition.plain is None]
    if rest:
        beside = columns.matched(docs, text, [r for _, r in rest], *keep, size=size, variables=variables, executable=executable)
        places = F.array(*[F.lit(i) for i, _ in rest])
        found = found.unionByName(beside.withColumn("pos", F.element_at(places, F.col("pos") + 1)))
    return found
