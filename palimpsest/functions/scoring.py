"""Tiers, weights and verdicts of rule matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords by tier, in the order in which tiers are tried; weights by tier; weight band by score.
TIER_WORDS = (
    ("exploit", ("expl", "cve", "exploit", "equation", "shellcode")),
    ("malware", ("malw", "webshell", "ransom", "backdoor", "trojan", "apt_", "apt-", "hktl", "hacktool", "loader", "stealer", "botnet", "dropper", "keylog")),
    ("phishing", ("phish", "_pk_", "phishingkit", "credential")),
    ("suspicious", ("susp", "anomaly", "heuristic", "obfusc")),
)
TIER_WEIGHTS = {"malware": 8.0, "exploit": 7.0, "phishing": 5.0, "default": 4.0, "suspicious": 2.0}
FAMILY_KEYS = ("family", "malware_family", "actor")


def tier(rule: Column, namespace: Column, tags: Column, stated: Column, score: Column) -> Column:
    """A stated tier wins, then keywords, then the score (75 and more, under 40)."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(rule, F.lit("")), F.coalesce(namespace, F.lit("")), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))
    out = F.when(F.lower(stated).isin("malware", "exploit", "phishing", "suspicious"), F.lower(stated))
    for name, words in TIER_WORDS:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(hay, F.lit(w)) for w in words]), name)
    return out.when(score >= 75, "malware").when(score < 40, "suspicious").otherwise("default")


def score_weight(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(1.0)).otherwise(F.lit(0.5) + F.least(F.greatest(score, F.lit(0)), F.lit(100)) / F.lit(100.0))


def tier_weight(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in TIER_WEIGHTS.items() for x in pair]), name)


def family(meta: Column) -> Column:
    """The first key that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(meta, F.lit(k))), F.lit("")) for k in FAMILY_KEYS])


#: Prefixes of the names of feed rules, and the weights of their groups.
FEED_PREFIXES = (("URLHAUS_", "url_feed"), ("MALWAREBAZAAR_", "hash_feed"), ("THREATFOX_", "ioc"))
FEED_WEIGHTS = {"url_feed": 8.0, "hash_feed": 10.0, "ioc": 7.0, "log_only": 0.0}


def route(rule: Column, canary: Column, allowed: Column, tier_name: Column) -> Column:
    """The group a match scores in: canaries and allowed rules are logged only, feeds have their own, else the tier."""
    out = F.when(F.coalesce(canary, F.lit(False)) | F.coalesce(allowed, F.lit(False)), "log_only")
    for prefix, group in FEED_PREFIXES:
        out = out.when(F.startswith(rule, F.lit(prefix)), group)
    return out.otherwise(tier_name)


def group_weight(group: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in (TIER_WEIGHTS | FEED_WEIGHTS).items() for x in pair]), group)


def actionable(meta: Column) -> Column:
    flag = lambda k: F.coalesce(F.try_element_at(meta, F.lit(k)) == "1", F.lit(False))
    return ~(flag("canary") | flag("allow"))


def tagged(meta: Column, allowed: Column, canary: bool) -> Column:
    """meta with allow=1 where allowed, canary=1 in canary mode."""
    none = F.create_map().cast("map<string,string>")
    add = F.when(allowed, F.create_map(F.lit("allow"), F.lit("1"))).otherwise(none)
    kept = F.map_filter(F.coalesce(meta, none), lambda k, _: ~k.isin("allow", "canary") | (k == "canary") & F.lit(not canary) | (k == "allow") & ~allowed)
    return F.map_concat(kept, add, F.create_map(F.lit("canary"), F.lit("1")) if canary else none)
