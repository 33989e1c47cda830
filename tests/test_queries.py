"""Every query with a DuckDB counterpart gives its rows; the others give rows of a stable schema."""

import harness
import pytest

from tessera.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    assert harness.difference(registry.QUERIES[name](spark, FOLDER), con, registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert [*df.columns] == [*df.toPandas().columns]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["place", "id", "uri", "final_score", "l0_content", "l1_content"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
