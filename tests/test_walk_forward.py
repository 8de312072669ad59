"""Tables as of a week against tables of the rows before it, and the backtest on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.operators import elasticity, walk_forward
from pricemill.plans import queries

CONFIG = Config({"elasticity": {"min_obs_per_upc": 40, "min_distinct_prices_per_upc": 4}})


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(12), []
    for upc in range(1, 9):
        slope, begins = -0.5 - 0.4 * upc if upc < 7 else 0.8, 1 if upc != 5 else 30
        for store in range(1, 5):
            for week in range(begins + store, 61):
                if rng.random() < 0.1:
                    continue
                price = float(rng.choice([1.0, 1.1, 1.25, 1.4, 1.6, 1.75])) if upc != 4 else 1.5
                units = np.exp(3 + 0.1 * store + 0.2 * np.sin(week / 8) + slope * np.log(price) + rng.normal(0, 0.3 if upc != 3 else 3.0))
                rows.append((upc, store, week, round(price, 2), float(max(1, round(units))), int(rng.random() < 0.2), week % 52))
    return spark.createDataFrame(rows, "upc long, store long, week long, effective_unit_price double, move double, recorded_promotion_flag int, week_of_year int").persist()


def test_each_table_is_that_of_the_rows_before(panel):
    cuts = [25, 33, 47, 61]
    found = walk_forward.tables_as_of(panel, cuts, CONFIG).toPandas().set_index(["as_of", "upc"]).sort_index()
    numbers = ["n_obs", "n_distinct_prices", "n_stores", "n_weeks", "price_cv", "price_min", "price_max", "estimate", "std_error", "std_error_hc1", "std_error_store", "std_error_week", "se_inflation_vs_hc1", "r_squared", "t_stat", "ci_low", "shrinkage_weight", "elasticity_shrunk", "elasticity_final"]
    for cut in cuts:
        table = elasticity.elasticity_table(panel.where(F.col("week") < cut), CONFIG)
        own, other = table.products.toPandas().set_index("upc").sort_index(), found.loc[cut]
        assert list(own.index) == list(other.index)
        for c in numbers:
            assert np.allclose(own[c].astype(float), other[c].astype(float), rtol=1e-6, atol=1e-9, equal_nan=True), (cut, c)
        for c in ("usable", "reject_reason", "elasticity_source", "clipped", "significant_negative"):
            assert (own[c] == other[c]).all(), (cut, c)
        assert np.isclose(other["pooled"], table.facts["pooled"]).all()
    assert {"", "wrong_sign", "insufficient_observations_or_price_variation"} <= set(found["reject_reason"])
    assert 5 not in found.loc[25].index and 5 in found.loc[47].index


def test_weeks_without_a_past(panel):
    assert set(walk_forward.tables_as_of(panel, [1, 40], CONFIG).select("as_of").distinct().toPandas()["as_of"]) == {40}
    assert walk_forward.tables_as_of(panel, [2], CONFIG).count() == 0
    with pytest.raises(ValueError):
        walk_forward.tables_as_of(panel, [], CONFIG)


def test_contexts_take_their_own_weeks_table(spark, panel):
    tables = walk_forward.tables_as_of(panel, [30, 50], CONFIG)
    rows = spark.createDataFrame([(1, 30, 9.0), (1, 50, 9.0), (77, 50, 9.0), (1, 31, 9.0)], "upc long, week long, elasticity double")
    found = {(r["upc"], r["week"]): r for r in walk_forward.attach_as_of(rows, tables, CONFIG).collect()}
    own = {(r["upc"], r["as_of"]): r for r in tables.collect()}
    assert set(found) == {(1, 30), (1, 50), (77, 50)}
    assert all(found[1, w]["elasticity"] == own[1, w]["elasticity_final"] for w in (30, 50))
    assert found[77, 50]["elasticity_source"] == "pooled_fallback" and np.isclose(found[77, 50]["elasticity"], -abs(own[1, 50]["pooled"]))


def test_backtest_is_scored_week_by_week(spark, sf_dir):
    found, tested = queries._walked(spark, sf_dir)
    rows = found.select("week", "current_price", "recommended_price", "unit_cost", "base_units", "elasticity").toPandas()
    units = rows.base_units * (rows.recommended_price.fillna(rows.current_price) / rows.current_price) ** rows.elasticity
    profit = ((rows.recommended_price.fillna(rows.current_price) - rows.unit_cost) * units).groupby(rows.week).sum()
    scores = queries.walk_forward_backtest(spark, sf_dir).toPandas()
    assert scores.week.nunique() == 10 and set(scores.policy) == {"historical", "simple_margin", "elasticity_baseline", "optimised"}
    best = scores[scores.policy == "optimised"].set_index("week").sort_index()
    assert np.allclose(best.profit, profit.sort_index(), rtol=1e-6)
    assert (scores[scores.policy == "historical"].share_no_change == 1).all() and rows.elasticity.nunique() > 1
    forecast = tested.toPandas()
    wape = (forecast.predicted - forecast.move).abs().groupby(forecast.week).sum() / forecast.move.groupby(forecast.week).sum()
    assert np.allclose(best.wape, wape.sort_index(), atol=1e-6)
