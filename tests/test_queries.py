"""Every query that has SQL gives the same rows; every other one runs."""

import pytest

from dredgeline.plans import registry
from .conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, data, name):
    same_as_sql(spark, duck, data, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_llm_is_not_imported():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "dredgeline"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "llm" not in file.read_text(), file
