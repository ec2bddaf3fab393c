import pytest
from conftest import SMALL, rows

from palimpsest.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_the_flagship(spark):
    import __spark_entry__

    assert catalogue.FLAGSHIP in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).columns == ["doc_id", "pos", "rule", "namespace"]
