"""Encoded scripts of any number and size."""

import hashlib

from pyspark.sql import functions as F

from palimpsest.operators import scripts
from palimpsest.plans import binaries


def clear(spark, body):
    made = spark.createDataFrame([(body,)], "body binary").select(scripts.encoded_scripts(F.col("body"), binaries.tables()).alias("x"))
    return made.select(F.transform("x", lambda b: F.sha2(b, 256)).alias("x")).first().x


def test_all_blocks_of_a_body_count(spark):
    texts = [b"script %d <a@b>\r\n" % i for i in range(150)]
    assert clear(spark, b"".join(map(binaries.encoded_block, texts))) == [hashlib.sha256(t).hexdigest() for t in texts]


def test_a_long_block_is_whole(spark):
    text = "Wörter, 3 < 4 @ ".encode() * 50_000 + b"long " * 1_000_000
    assert len(text) > 4 << 20 and clear(spark, binaries.encoded_block(text)) == [hashlib.sha256(text).hexdigest()]
