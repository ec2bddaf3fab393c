"""Candidates by atoms against every rule evaluated as a column."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import atoms, rules
from palimpsest.operators.rules import NOTHING, Rule, at, matches, pe, smaller, some, times, variable, word_at

OPTIONS = [frozenset(x) for x in ((), ("nocase",), ("wide",), ("ascii", "wide"), ("fullword",), ("nocase", "fullword"))]


def mixed(rng):
    """Rules of every kind, gated and not."""
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 4)))
    pattern = lambda: rng.choice([f"{word()}[abc]+{word()}", f"({word()}|{word()})c", r"\d{2}" + word(), "[ab][cd]", f"(?:{word()})?{word()}x*", r"a\s*b"])
    string = lambda: rng.choice([("text", word(), rng.choice(OPTIONS)), ("regex", pattern(), rng.choice(OPTIONS[:2])), ("hex", "61 6? ?? 6" + rng.choice("1234"), NOTHING)])
    conditions = [None, matches("a") & ~matches("b"), ~matches("a"), some(2), some("any", "a", "b") & smaller(40), times("a", 1), at("b", 0), ~word_at(0, 0x6161) & matches("c"), variable("V", True) & matches("a"), some("all") | matches("c"), matches("a") & pe(lambda p: p["x"] > 1)]
    return [Rule(f"r{i}", "n", {k: string() for k in "abc"}, least=rng.randint(0, 3), none=("c",) if i % 5 == 0 else (), condition=conditions[i % len(conditions)], private=i % 17 == 3) for i in range(66)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_columns(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "b", "c", "d", "A", "B", " ", "12", "a\0b\0c\0"]) for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, ""]
    made = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("v", F.col("id") % 2 == 0)
    catalogue = mixed(rng)
    told = lambda f: sorted((r.id, r.pos, r.rule) for r in f(made, F.col("text"), catalogue, "id", variables={"V": F.col("v")}, executable=F.struct((F.col("id") % 3).alias("x"))).collect())
    assert told(atoms.matched) == told(rules.matched)


def test_many_rules_cost_little_more_than_few(spark):
    """Two thousand rules read a text once, as twenty do."""
    import time

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(2000)]
    texts = [" ".join(rng.choice(words[:200]) if rng.random() < 0.02 else "lorem" for _ in range(2000)) for _ in range(40)]
    catalogue = [Rule(w, "n", {"a": ("text", w, frozenset({"fullword"}))}) for w in words]

    def took(n):
        matcher = atoms.Matcher(catalogue[:n])
        began = time.process_time()
        found = [matcher.holding(t, len(t), {}) for t in texts]
        return time.process_time() - began, found

    few, many = min(took(20)[0] for _ in range(3)), min(took(2000)[0] for _ in range(3))
    assert many < 10 * few + 0.5
    assert took(2000)[1] == [[i for i, w in enumerate(words) if re.search(rf"\b{w}\b", t)] for t in texts]


def test_atoms_of_patterns():
    known = lambda kind, value, options=NOTHING: atoms.atoms(Rule("r", "n", {"a": (kind, value, options)}), "a")
    assert known("text", "License") == {"license"}
    assert known("regex", r"ab(?:cde|fgh)+\d") == {"cde", "fgh"}
    assert known("regex", r"(?:abc)?x*\d") is None
    assert known("hex", "D0 CF 11 ?? 41 42") == {"\xd0\xcf\x11"}
    assert known("text", "abc", frozenset({"wide"})) == {"a\0b\0c\0"}


def test_wide_expressions(spark):
    rule = Rule("r", "n", {"a": ("regex", r"fo+\.[a-c]\d{2}", frozenset({"wide", "nocase"})), "b": ("regex", "xy|z", frozenset({"ascii", "wide"}))})
    made = spark.createDataFrame([(0, "foo.a12"), (1, "FOO.b34".encode("utf-16-le").decode("latin-1")), (2, "x\0y\0"), (3, "xy"), (4, "x\0z")], "id long, text string")
    assert sorted(r.id for r in rules.matched(made, F.col("text"), [rule], "id").collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="no wide form"):
        rules.wide_regex(r"(a)\1")


def test_patterns_that_only_one_engine_knows_are_bad(spark):
    line = '{"rule": "x", "strings": [{"id": "a", "kind": "regex", "value": "(?P<n>x)"}]}'
    good, bad = rules.loaded(spark.createDataFrame([("n", line)], "namespace string, value string"))
    assert not good and bad.count() == 1


def test_plain_texts_need_no_pattern():
    none = frozenset()
    matcher = atoms.Matcher([Rule("long", "n", {"a": ("text", "A(b)c." * 5, none)}), Rule("short", "n", {"a": ("text", "zq", none)}), Rule("two", "n", {"a": ("text", "zqx", none), "b": ("text", "(b)", none)}, least=2)])
    assert matcher.holding("..." + "A(b)c." * 5 + " ZQX", 40, {}) == [0]  # in other letters it doesn't stand
    assert matcher.holding("zqx (b)", 7, {}) == [1, 2]
    assert matcher.holding("a(b)c." * 5, 30, {}) == []
    assert not matcher.compiled
