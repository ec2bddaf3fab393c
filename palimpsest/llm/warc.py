"""WARC archives with revisit records.

Pages are written as WARC 1.1 records, each a gzip member of its own, to files that begin with a warcinfo record, by a
writer of Spark's data source API: tasks write to a hidden folder, and only files of tasks that succeeded are moved
out of it. Headers alone are shuffled by payload digest; of equal payloads the record with the smallest page_id is the
response, the others become revisit records that name it and carry no payload. What comes back to the pages are the
flags of revisits by page_id and digest: as a broadcast while they are few, else by a join on these two, which no key
makes hot. Reading parses the archives record by record and joins revisits to the responses they refer to.

A null html is an empty payload, a null page_id is written as an empty page and sorts after all others, a null or
multi-line url is replaced or escaped. Rows tied for the smallest page_id of a payload are all responses, and, as they
are the same record, have one id. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from palimpsest.llm.common import keep, shared_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Compressed bytes that an archive file holds before another one is begun; flags that are broadcast; tasks that the
#: headers of one digest are dealt to.
ARCHIVE, BROADCAST_FLAGS, SALTS = 32 << 20, 300_000, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """its_page, its_digest (hexadecimal) and first, the page_id of the response, of each page that revisits one."""
    headers = pages.select(F.col("page_id").cast("long").alias("its_page"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    headers = headers.where(F.octet_length("payload") >= least_bytes).select("its_page", F.sha1(F.col("payload").cast("binary")).alias("its_digest"))
    headers = keep(headers, "headers")
    shared = headers.groupBy(F.col("its_digest").alias("digest")).agg(F.min("its_page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = headers.withColumn("its_salt", F.pmod(F.xxhash64("its_page"), F.lit(SALTS)).cast("int"))
    found = dealt.join(salted, (F.col("its_digest") == F.col("digest")) & (F.col("its_salt") == F.col("salt")))
    return found.where("its_page IS NULL OR its_page <> first").select("its_page", "its_digest", "first").distinct()


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page: int | None, digest: str) -> str:
    """A URN made from page_id and payload digest, so that a revisit can name a record without its row."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'page:{page}:{digest}'.encode()).hexdigest())}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6)


def page_record(page: int | None, url: str | None, payload: bytes, first: int | None, when: str) -> bytes:
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    own = "" if page is None else str(page)
    headers = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": when,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", "%20", url) if url else f"urn:page:{own}",
        "X-Page-ID": own,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32(hashlib.sha1(block).digest())}",
    }
    if first is not None:
        headers |= {"WARC-Refers-To": record_id(first, digest), "WARC-Profile": PROFILE}
    return record(headers | {"Content-Type": "application/http; msgtype=response"}, block)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (local, hdfs, s3, gs: those that pyarrow knows) and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.path)
        system.create_dir(f"{folder}/_temporary", recursive=True)
        when, names, out, size = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), [], None, 0
        for batch in iterator:
            for page, url, payload, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "first")), strict=True):
                if out is None:
                    names.append(f"{uuid.uuid4()}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/_temporary/{names[-1]}", compression=None), 0
                    about = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": when, "WARC-Filename": names[-1], "Content-Type": "application/warc-fields"}
                    out.write(record(about, b"format: WARC File Format 1.1\r\n"))
                data = page_record(page.as_py(), url.as_py(), payload.as_py().encode(), first.as_py(), when)
                out.write(data)
                size += len(data)
                if size >= ARCHIVE:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{folder}/_temporary/{name}", f"{folder}/{name}")
        if system.get_file_info(f"{folder}/_temporary").type != fs.FileType.NotFound:
            system.delete_dir(f"{folder}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{folder}/_temporary/{name}")


class Archives(DataSource):
    """Option path: the folder to write to. Columns page_id, url, payload, first."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Deduplicated archives with fresh headers in ``path``."""
    flags = keep(revisits(pages, least_bytes), "revisits")
    side = F.broadcast(flags) if flags.count() <= BROADCAST_FLAGS else flags
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    same = F.col("page_id").eqNullSafe(F.col("its_page")) & (F.sha1(F.col("payload").cast("binary")) == F.col("its_digest")) & (F.octet_length("payload") >= least_bytes)
    found = rows.join(side, same, "left").select("page_id", "url", "payload", "first")
    pages.sparkSession.dataSource.register(Archives)
    found.write.format("warc").mode("append").option("path", path).save()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzip archive of one or many members."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data))
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("not a WARC record")
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each record but warcinfo: record_id, page_id, url, record_type, payload_digest (of the payload itself where
    there is one), payload_bytes (null for revisits), refers_id, and on demand the payload."""
    names = ["record_id", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_id", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for headers, block in parse(data.as_py()):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
                    stated = headers["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated:
                        raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
                    page = headers.get("x-page-id", "")
                    rows.append((headers["warc-record-id"], int(page) if page else None, headers["warc-target-uri"], headers["warc-type"], stated, None if payload is None else len(payload), headers.get("warc-refers-to"), payload if payloads else None))
                    if len(rows) == 1000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_id string, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(work, schema)


def resolve(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits get the response's payload size."""
    responses = found.where("record_type = 'response'")
    originals = responses.groupBy(F.col("record_id").alias("original")).agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("full"))
    revisits = found.where("record_type = 'revisit'").join(originals, F.col("refers_id") == F.col("original"), "left")
    own = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.union(revisits.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return resolve(keep(read_archives(spark, path).drop("payload"), "records"))


_LETTERS = " || ".join(
    f"substr('{ALPHABET}', (((('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {d}) & 31) + 1)::BIGINT, 1)" for g in range(8) for d in (15, 10, 5, 0)
)
ORACLE = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first FROM hashed GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM hashed JOIN firsts USING (h)
"""
