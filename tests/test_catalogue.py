import pytest
from conftest import same_as_duckdb

from sealwright.plans import captures, histories, release_rules, rules, shapes, trees  # noqa: F401  (they add their queries to the catalogue)
from sealwright.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, name):
    assert same_as_duckdb(spark, QUERIES[name], ORACLES[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
