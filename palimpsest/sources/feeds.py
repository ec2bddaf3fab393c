"""Reputation feeds and files as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import urls

SHA256 = r"^[0-9A-Fa-f]{64}$"


def csv_rows(lines: DataFrame) -> DataFrame:
    """Lines (value) but comments, cut at commas outside quotes: column fields. Ragged rows keep the fields they have."""
    lines = lines.where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    cells = F.regexp_extract_all("value", F.lit(r'(?:^|,)\s*("[^"]*+(?:""[^"]*+)*+"?|[^,]*)'), 1)
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')
    return lines.select(F.transform(cells, bare).alias("fields"))


def url_feed(spark: SparkSession, path: str) -> DataFrame:
    return url_rows(spark.read.text(path))


def url_rows(lines: DataFrame) -> DataFrame:
    """norm, host: the first field of each row that is a URL."""
    url = F.element_at(F.filter("fields", lambda c: c.rlike("(?i)^https?://")), 1)
    norm, host = urls.normalised(F.col("url"))
    rows = csv_rows(lines).where(F.exists("fields", lambda c: c.rlike("(?i)^https?://"))).select(url.alias("url"))
    return rows.select(norm.alias("norm"), host.alias("host")).where("norm <> ''").distinct()


def indicator_feed(spark: SparkSession, path: str, kind_field: int, value_field: int) -> tuple[DataFrame, DataFrame]:
    return indicator_rows(spark.read.text(path), kind_field, value_field)


def indicator_rows(lines: DataFrame, kind_field: int, value_field: int) -> tuple[DataFrame, DataFrame]:
    """URLs (norm) and hosts of a feed of typed indicators, fields counted from 0; hosts of URLs are hosts too."""
    rows = csv_rows(lines).select(F.lower(F.get("fields", F.lit(kind_field))).alias("kind"), F.trim(F.get("fields", F.lit(value_field))).alias("value"))
    norm, host = urls.normalised(F.col("value"))
    named = rows.where("kind = 'url'").select(norm.alias("norm"), host.alias("host")).where("norm <> ''")
    hosts = named.select("host").union(rows.where("kind = 'domain' AND value <> ''").select(F.lower("value").alias("host")))
    return named.select("norm").distinct(), hosts.distinct()


def hash_feed(spark: SparkSession, path: str) -> DataFrame:
    """The hashes of a plain feed or of the first file in an archive."""
    zipped = path.lower().endswith(".zip")
    return hash_rows(zipped_lines(spark, path) if zipped else spark.read.text(path))


def hash_rows(lines: DataFrame) -> DataFrame:
    """sha256, lower case: the first field of 64 hex digits of each row, each once. A feed may
    have any number of them: what joins with it is a table like any other."""
    hit = F.element_at(F.filter("fields", lambda c: c.rlike(SHA256)), 1)
    rows = csv_rows(lines).where(F.exists("fields", lambda c: c.rlike(SHA256)))
    return rows.select(F.lower(hit).alias("sha256")).distinct()


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of the first file in each archive; broken archives have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                try:
                    with zipfile.ZipFile(io.BytesIO(body.as_py())) as z, z.open(next(i for i in z.infolist() if not i.is_dir())) as f:
                        while some := f.readlines(1 << 22):
                            yield pa.record_batch([pa.array([x.decode("latin-1").rstrip("\r\n") for x in some])], ["value"])
                except (zipfile.BadZipFile, StopIteration):
                    continue

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "value string")


def scanned_files(spark: SparkSession, path: str, most: int = 8 << 20) -> DataFrame:
    """path, size, body, error of all files below a folder; bodies are cut at ``most`` bytes, and an error says so."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    error = F.when(F.col("length") > most, F.lit("too large"))
    return found.select("path", F.col("length").alias("size"), F.substring("content", 1, most).alias("body"), error.alias("error"))


def arriving_files(spark: SparkSession, path: str, most: int = 8 << 20, a_batch: int = 1000) -> DataFrame:
    """The same as a stream: files are requests, a micro-batch takes at most ``a_batch`` of them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", a_batch).load(path)
    return found.select("path", F.col("modificationTime").alias("ts"), F.col("length").alias("size"), F.substring("content", 1, most).alias("body"))


def mail_status(scans: DataFrame) -> DataFrame:
    """``scans(key, size, error, rules, most)`` with column status: unknown for mail that is empty, too large or failed to
    be scanned, else infected if any rule matched."""
    failed = F.col("error").isNotNull() | (F.col("size") > F.col("most")) | (F.col("size") == 0)
    return scans.withColumn("status", F.when(failed, "unknown").when(F.size("rules") > 0, "infected").otherwise("clean"))


def exit_code(files: DataFrame, matches: DataFrame) -> DataFrame:
    """One row, code: 2 if a file has an error, else 1 if anything matched, else 0."""
    failed = files.agg(F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("failed"))
    hits = matches.agg((F.count("*") > 0).alias("hit"))
    return failed.join(F.broadcast(hits)).select(F.when(F.col("failed"), 2).when(F.col("hit"), 1).otherwise(0).alias("code"))
