import pytest
from helpers import DATA, same

import __spark_entry__ as entry
from tremor.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name in catalogue.SQL:
        same(df, duck.sql(catalogue.SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_seeds_document_is_dealt_over_all_partitions(spark):
    assert "REPARTITION_BY_NUM" in catalogue.seeds_documents(spark, DATA)._jdf.queryExecution().executedPlan().toString()
