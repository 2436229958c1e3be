import pytest

from dredgeline.llm import queries, sql
from ..conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_same_as_sql(spark, duck, data, name):
    same_as_sql(spark, duck, data, queries.QUERIES[name], sql.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0
