import pytest

from quillspark.plans import registered

from .compare import same

QUERIES, ORACLES = registered()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf, name):
    same(spark, duck, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    QUERIES[name](spark, sf).count()
