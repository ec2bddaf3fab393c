"""What the operators share: reading, shared tables, words, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII blanks; ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one of our own if all run on this
    machine; on a cluster that would leave each executor with its own part, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and read it back: cuts the lineage,
    survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`keep` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed() -> None:
    """Give memory that was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that leaves its process small: Python workers wait for later tasks, next to those that are at work, with
    all that the tasks before have taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trimmed()

    return run


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node in ``edges(u, v)``: columns node, label.

    Each round maps every node to the first among itself and its neighbours and contracts the edges to what they
    map to; loops and repeats go, so that edges shrink with every round. First is the smallest node in round 0,
    where trees linked to their smallest node vanish at once, and the smallest hash, another in each round, after
    that, so that no numbering of long chains makes for many rounds. The maps are composed from the last to the
    first. Maps and edges are kept in the shared folder; only counts reach the driver.
    """
    live = keep(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not maps or live.limit(1).count():
        first = (lambda c: F.col(c)) if not maps else (lambda c, n=len(maps): F.xxhash64(c, F.lit(n)))
        ends = live.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e")).select("e.*")
        nearest = ends.groupBy("node").agg(F.min(F.struct(first("other").alias("rank"), F.col("other").alias("parent"))).alias("near"))
        own = F.struct(first("node").alias("rank"), F.col("node").alias("parent"))
        maps.append(keep(nearest.select("node", F.least("near", own)["parent"].alias("parent")), "map"))
        left, right = (maps[-1].select(F.col("node").alias(c), F.col("parent").alias(f"to_{c}")) for c in ("u", "v"))
        moved = live.join(left, "u").join(right, "v").where("to_u <> to_v")
        contracted = keep(moved.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct(), "edges")
        discard(live)
        live = contracted
    discard(live)
    roots = maps.pop()
    for lower in reversed(maps):
        roots = lower.join(roots.select(F.col("node").alias("parent"), F.col("parent").alias("above")), "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
    roots = keep(roots, "roots")
    smallest = roots.groupBy("parent").agg(F.min("node").alias("label"))
    return roots.join(smallest, "parent").select("node", "label")
