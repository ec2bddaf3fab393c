"""Work and traffic that must not grow faster than the tables: bodies read once, joins by key."""

import struct
import time

from pyspark.sql import functions as F

from palimpsest.operators import compound, members
from palimpsest.plans import binaries, containers_made


def files(spark, **bodies):
    return spark.createDataFrame(list(bodies.items()), "file string, body binary")


def test_compound_joins_send_no_table_to_the_driver(spark):
    made = files(spark, **{f"f{i}": binaries.described(i, b"text %d" % i) for i in range(5)})
    for found in (compound.streams(made), compound.extra_data(made), compound.chains(spark.createDataFrame([("f", 0, 1), ("f", 1, None)], "file string, node long, next long"))):
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_tables_of_large_compound_files_are_read_once(spark):
    """Links that were read one by one copied the body for each."""
    body = containers_made.compound({"One": bytes(6 << 20)}) + b"y" * 600
    began = time.time()
    assert [bytes(r.body) for r in compound.extra_data(files(spark, f=body)).collect()] == [b"y" * 600]
    assert time.time() - began < 60


def test_records_of_large_bodies_are_read_once(spark):
    """Members whose records were read one by one copied the archive for each field."""
    body = binaries.archive(**{f"m{i}": binaries.noise(i, 2048) for i in range(1500)})
    began = time.time()
    found = members.opened(files(spark, f=body), "zip").select("name", F.sha2("body", 256).alias("d")).collect()
    assert len(found) == 1500 and time.time() - began < 60
    assert {r.name for r in found} == {f"m{i}" for i in range(1500)}


def test_chains_end_with_their_body(spark):
    record = lambda size: b"\x02" + struct.pack("<II", 0x0006800F, size) + b"z" * size + b"\0\0"
    body = bytes.fromhex("789f3e220100") + record(0) * 60 + record(3)
    found = members.opened(files(spark, f=body), "tnef").collect()
    assert len(found) == 61 and bytes(max(found, key=lambda r: r.pos).body) == b"zzz"
