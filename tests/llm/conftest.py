import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that clash with names the operators use inside.
CLASHING = ("size", "target", "fp0", "id", "node", "label", "score", "h", "shard", "part", "mark", "copies")


def docs_of(spark, pairs, sources=("a", "b", None)):
    return spark.createDataFrame([(i, t, "en", sources[k % len(sources)], len(t or "")) for k, (i, t) in enumerate(pairs)], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, odd blanks."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    pairs = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "same words here today"), (6, "same words here today"), (6, "same words here today"), (None, "nobody's text is here"), (7, long), (8, long + " end"), (9, "nbsp joins \x1cwords  too"), (10, "token = 'abcdef123456' é")]
    return docs_of(spark, pairs)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
