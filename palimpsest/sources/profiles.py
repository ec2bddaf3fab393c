"""Catalogues of rules as tables: which rules a profile keeps, and where they came from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Sources (first part of a name) and licenses that must go; tags, parts of names and, by a pattern, other systems
    that don't matter for mail; parts of names that keep a rule for another system."""

    sources: tuple[str, ...] = ()
    licenses: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    other_systems: str = "$^"
    keep: tuple[str, ...] = ()


def any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def judged(rules: DataFrame, profile: Profile) -> DataFrame:
    """``rules(rule, tags, license, private)`` with kept and reason. Private rules stay, as others refer to them."""
    upper = F.upper("rule")
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.upper(F.trim(t)))
    tagged = reduce(lambda a, b: a | b, [F.array_contains(tags, t) for t in profile.tags], F.lit(False))
    reason = (
        F.when(F.coalesce("private", F.lit(False)), "private")
        .when(F.split(upper, "_")[0].isin(*profile.sources), "license:source")
        .when(any_in(F.lower(F.coalesce("license", F.lit(""))), profile.licenses), "license:non-commercial")
        .when(tagged, "mail:memory")
        .when(any_in(upper, profile.names), "mail:host")
        .when(F.col("rule").rlike(profile.other_systems) & ~any_in(upper, profile.keep), "mail:other-system")
        .otherwise("keep")
    )
    return rules.withColumn("reason", reason).withColumn("kept", F.col("reason").isin("private", "keep"))


def with_sources(rules: DataFrame, manifest: DataFrame) -> DataFrame:
    """rule, source: the rules whose name begins with a prefix of ``manifest(prefix, source)``; prefixes have one length."""
    size = manifest.agg(F.max(F.length("prefix")).alias("size"))
    keyed = rules.select("rule").crossJoin(F.broadcast(size)).withColumn("prefix", F.expr("left(rule, size)"))
    return keyed.join(manifest, "prefix").select("rule", "source")
