"""How often queries go back to the sales tables: what they read again should be a stored table."""

import pytest

from pricemill.plans import queries


@pytest.fixture
def passes(spark, sf_dir, monkeypatch):
    """By query: the rows of the weekly movement that it makes from the sales, as a multiple of the movement."""
    own = queries.movement_from_sales
    rows = own(spark, sf_dir).count()

    def passed(name):
        made = spark.sparkContext.accumulator(0)

        def counted(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        def movement(session, folder):
            df = own(session, folder)
            return df.mapInArrow(counted, df.schema)

        monkeypatch.setattr(queries, "movement_from_sales", movement)
        queries.QUERIES[name](spark, sf_dir).collect()
        return made.value / rows

    return passed


@pytest.mark.parametrize("name", ["shrinkage_variants", "product_history", "error_summary_controlled"])
def test_estimates_read_the_sales_once(passes, name):
    assert passes(name) == 1


@pytest.mark.parametrize("name", ["walk_forward_backtest", "elasticities_as_of", "implied_elasticity", "hybrid_demand"])
def test_models_and_tables_as_of_weeks_read_the_sales_once(passes, name):
    assert passes(name) == 1
