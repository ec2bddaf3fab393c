"""What layered decoding leaves in the shared folder."""

from pyspark.sql import functions as F

from palimpsest.operators import decode, tables
from palimpsest.plans import binaries


def test_layers_keep_each_blob_once(spark, tmp_path, monkeypatch):
    """What is kept of a source stays below the sum of its layers, a few times its text."""
    import base64

    texts = [base64.b64encode(base64.b64encode(binaries.noise(i, 20000))).hex() for i in range(20)]
    monkeypatch.setattr(tables, "shared_dir", lambda spark: f"file://{tmp_path}")
    found = decode.layered(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "key", F.col("text"))
    kept = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    rows = found.where("layer = 3 AND decoder = 'base64'").collect()
    assert {bytes(r.blob) for r in rows} == {binaries.noise(i, 20000) for i in range(20)}
    assert kept < 2.5 * sum(map(len, texts))
