"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck
from moveproof.plans import registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con(root):
    return duck(root)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, root, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], root) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, root, name):
    assert QUERIES[name](spark, root).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert "issue_type" in df.columns
