"""A week appended gives the rows of a full build, without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.operators import features, incremental
from pricemill.plans import queries

KEYS = ["upc", "store", "week"]


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(21), []
    for upc in range(1, 6):
        for store in range(1, 5):
            for week in range(1 if store < 4 else 18, 22):  # a series that is new in a later week
                if rng.random() < 0.15:
                    continue
                cost = None if rng.random() < 0.2 else round(float(rng.uniform(0.5, 0.9)), 3)
                rows.append((upc, store, week, float(rng.integers(1, 60)) if rng.random() < 0.95 else None, round(float(rng.choice([1.0, 1.2, 1.3, 1.55])), 2), cost, int(rng.random() < 0.3), "12 OZ"))
    return spark.createDataFrame(rows, "upc long, store long, week long, move double, effective_unit_price double, estimated_unit_aac double, recorded_promotion_flag int, size string").persist()


def _same(found, expected):
    a, b = (x.toPandas().set_index(KEYS).sort_index() for x in (found.select(*expected.columns), expected))
    assert len(a) == len(b) and (a.index == b.index).all()
    for c in a.columns:
        if a[c].dtype == object:
            assert a[c].equals(b[c]), c
        else:
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-12, equal_nan=True), c


@pytest.mark.parametrize("steps", [[[18], [19], [20], [21]], [[18, 19, 20, 21]], [[18, 19], [20, 21]]])
def test_appended_weeks_equal_a_full_build(spark, panel, tmp_path, steps):
    store = incremental.FeatureStore(spark, f"inc_{len(steps)}_{len(steps[0])}", f"file://{tmp_path}", buckets=4)
    store.start(panel.where("week < 18"))
    for weeks in steps:
        assert store.append(panel.where(F.col("week").isin(weeks))) == weeks
    _same(store.features(), features.features(panel))
    # a week that comes again, changed, replaces itself and nothing else
    changed = panel.withColumn("move", F.when(F.col("week") == 21, F.col("move") + 5).otherwise(F.col("move")))
    again = steps[-1]
    store.append(changed.where(F.col("week").isin(again)))
    _same(store.features(), features.features(changed))
    assert store.append(panel.limit(0)) == []
    store.drop()


def test_no_exchange_between_panel_and_state(spark, panel, tmp_path):
    store = incremental.FeatureStore(spark, "inc_plan", f"file://{tmp_path}", buckets=4)
    store.start(panel)
    with pytest.raises(ValueError):
        store.state_before(5)
    store._write(incremental.states(panel.where("week < 21")), "state_20", weekly=False)
    plan = store.following([21])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    moved = incremental.advanced(store.state_before(21), spark.table("inc_plan_panel").where("week = 21"))
    assert "Exchange" not in moved._jdf.queryExecution().executedPlan().toString()
    a, b = (sorted(map(str, df.select("upc", "store", "last", "counts", "cost", "age").collect())) for df in (moved, incremental.states(panel)))
    assert a == b
    store.drop()


def test_query_of_appended_weeks_is_that_of_all_rows(spark, sf_dir):
    found = queries.appended_features(spark, sf_dir)
    last = found.agg(F.min("week")).first()[0]
    _same(found, queries._rounded(queries._features(spark, sf_dir).where(F.col("week") >= last).select(*found.columns)))
