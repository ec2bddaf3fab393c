"""What happens to matches(doc, pos, rule, namespace, meta): first wins, policy, verdicts, scores, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scoring

#: Classes of weak evidence, in order; how many distinct ones make a finding.
WEAK_CLASSES = ("OLEID-OBJECTPOOL", "OLEID-FLASH", "OLEID-VBA-PRESENT", "OLEID-EXTREL", "OLEID-DDE", "OLEID-XLM-PRESENT", "DIGITAL-SIGNATURE", "ENCRYPTION-RC4", "ENCRYPTION-AES", "DEFAULTPW-DECRYPTED", "OLE-DOC-SECURITY-", "OLETIMES-FUTURE ", "OLETIMES-SYNTHETIC ", "OLE2-EXTRA-DATA", "USERFORM-STRINGS", "DOCPROPS-STRINGS")
WEAK_MIN = 3


def first_of_each(matches: DataFrame) -> DataFrame:
    """The first match of each (namespace, rule) in a document."""
    rest = [c for c in matches.columns if c not in ("doc", "namespace", "rule")]
    first = matches.groupBy("doc", "namespace", "rule").agg(F.min_by(F.struct(*rest), "pos").alias("x"))
    return first.select("doc", "namespace", "rule", "x.*").select(*matches.columns)


def channelled(matches: DataFrame, tags: Column, channel: Column) -> DataFrame:
    """Marker rules count in the marker channel only, all others outside it."""
    return matches.where(F.array_contains(tags, "marker") == (channel == "marker"))


def policed(matches: DataFrame, deny: DataFrame, allow: DataFrame) -> DataFrame:
    """Without denied rules; allowed ones are kept and marked in column allowed. Names are compared in lower case."""
    key = F.lower("rule").alias("key")
    kept = matches.withColumn("key", F.lower("rule")).join(deny.select(key).distinct(), "key", "left_anti")
    return kept.join(allow.select(key).distinct().withColumn("allowed", F.lit(True)), "key", "left").drop("key").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def verdicts(matches: DataFrame) -> DataFrame:
    """doc, malicious, family, confidence, rules (in order, joined)."""
    known = matches.withColumn("family", scoring.family(F.col("meta")))
    found = known.groupBy("doc").agg(
        F.min(F.when(F.col("family").isNotNull(), F.struct("pos", "family")))["family"].alias("family"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rule"))), lambda x: x["rule"]), ",").alias("rules"),
    )
    return found.select("doc", F.lit(True).alias("malicious"), F.coalesce("family", F.lit("")).alias("family"), F.when(F.col("family").isNull(), "rule").otherwise("family").alias("confidence"), "rules")


def weak_evidence(markers: DataFrame) -> DataFrame:
    """``markers(doc, marker)``: documents with at least three distinct classes, and these in the fixed order."""
    at = F.coalesce(*[F.when(F.startswith("marker", F.lit(c)), F.lit(i)) for i, c in enumerate(WEAK_CLASSES)])
    sets = markers.withColumn("at", at).where("at IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("ats")).where(F.size("ats") >= WEAK_MIN)
    names = F.array(*map(F.lit, WEAK_CLASSES))
    return sets.select("doc", F.size("ats").cast("long").alias("n"), F.array_join(F.transform("ats", lambda i: F.element_at(names, i + 1)), "|").alias("classes"))


def fingerprint(names: DataFrame, name: Column) -> DataFrame:
    """Sixteen hex digits of the SHA-256 of the sorted names, zeros for none."""
    lines = F.array_join(F.array_sort(F.collect_set(name)), "\n")
    return names.agg(F.when(F.count(name) == 0, "0" * 16).otherwise(F.substring(F.sha2(lines, 256), 1, 16)).alias("fingerprint"))


def top_rules(matches: DataFrame, n: int) -> DataFrame:
    return matches.groupBy("rule").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "rule").limit(n)


#: Fixed value: from this score on a match is high.
HIGH = 75


def high(matches: DataFrame, score: Column) -> DataFrame:
    """doc, high: whether any match of the document is high."""
    return matches.groupBy("doc").agg(F.coalesce(F.max(score) >= HIGH, F.lit(False)).alias("high"))
