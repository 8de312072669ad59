"""Every query that has SQL gives the same rows; the others run and keep their invariants."""

import pytest

from pricemill.plans.oracles import SQL
from pricemill.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark, sf_dir):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert name == "alerts" or rows


def test_validation_passes(spark, sf_dir):
    assert all(r["passed"] for r in QUERIES["validation_checks"](spark, sf_dir).collect())


def test_entry_has_a_flagship_and_sql_only_for_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
