"""Drift from sketches against the exact one, and runs of zero prices against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.operators import monitoring, sketches, zero_prices


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(31)
    data = []
    for week in range(1, 31):
        for _ in range(400):
            shift = week / 30
            data.append((week, float(rng.gamma(2 + shift, 3)), float(rng.choice([0.0, 0.0, 1.0, 2.0, 5.0])), None if rng.random() < 0.1 else float(rng.normal(shift * 2, 1)), 7.0))
    data.append((3, float("nan"), None, None, 7.0))
    return spark.createDataFrame(data, "week long, a double, b double, c double, flat double").repartition(6).persist()


COLUMNS = ["a", "b", "c", "flat"]


def test_drift_of_any_periods_within_the_rank_error(spark, rows, tmp_path):
    sketches.weekly(rows, COLUMNS).write.parquet(f"file://{tmp_path}/weekly")
    stored = spark.read.parquet(f"file://{tmp_path}/weekly")
    assert stored.count() == 30 * len(COLUMNS)
    for reference, current in (((1, 10), (21, 30)), ((1, 20), (25, 26)), ((5, 5), (6, 6))):
        a, b = (rows.where(F.col("week").between(*p)).where("not isnan(a)") for p in (reference, current))
        exact = monitoring.feature_drift(a, b, COLUMNS).toPandas().set_index("feature")
        found = sketches.drift(stored, reference, current).toPandas().set_index("feature")
        assert set(found.index) == set(COLUMNS)
        for c in COLUMNS:
            assert abs(found.ks[c] - exact.ks[c]) <= 2 * (sketches.RANK_ERROR + 1 / sketches.RESOLUTION) + 0.01  # and the grid of hundredths
            assert found.reference_mean[c] == pytest.approx(exact.reference_mean[c]) and found.current_mean[c] == pytest.approx(exact.current_mean[c])
            # a term of PSI moves by its log ratio and its share's error; shares are about a tenth
            assert abs(found.psi[c] - exact.psi[c]) <= 0.05 + 0.35 * exact.psi[c]
            value = np.array([r[0] for r in b.select(c).where(F.col(c).isNotNull()).collect()])
            low, high = np.quantile(value, [0.95 - 2 * sketches.RANK_ERROR, min(1, 0.95 + 2 * sketches.RANK_ERROR)])
            assert low - 1e-9 <= found.current_p95[c] <= high + 1e-9
            assert found.current_share_zero[c] == pytest.approx(np.mean(value <= 0))
        assert found.psi["flat"] == 0
        assert sorted(found.drift_rank) == [1, 2, 3, 4] and found.drift_rank.idxmin() == found.psi.idxmax()


def test_no_raw_row_is_read_and_missing_periods_are_left_out(rows):
    kept = sketches.weekly(rows, ["a"])
    assert sketches.drift(kept, (1, 5), (90, 99)).count() == 0
    assert sketches.weekly(rows.limit(0), ["a"]).count() == 0
    merged = sketches.period(kept, 1, 30).first()
    assert merged["n"] == rows.where("not isnan(a)").count()


def test_runs_of_zero_prices(spark):
    rng = random.Random(32)
    data = []
    for upc, store in itertools.product(range(4), range(6)):
        for week in range(1, 40):
            if rng.random() < 0.1:
                continue
            gone = upc == 3 and store == 1 or week < 3 * store or (store == 2 and week > 33) or rng.random() < 0.2
            data.append((upc, store, week, rng.choice([0.0, None, -1.0]) if gone else 1.0 + upc, float(rng.randrange(3))))
    df = spark.createDataFrame(data, "upc long, store long, week long, price double, move double").repartition(5)
    expected = []
    for (upc, store), own in itertools.groupby(sorted(data), key=lambda r: r[:2]):
        own = list(own)
        priced = [r[2] for r in own if (r[3] or 0) > 0]
        for zero, run in itertools.groupby(own, key=lambda r: (r[3] or 0) <= 0):
            run = list(run)
            if zero:
                kind = "never_priced" if not priced else "leading" if run[-1][2] < priced[0] else "trailing" if run[0][2] > priced[-1] else "interior"
                expected.append((upc, store, kind, run[0][2], run[-1][2], len(run), sum(r[4] > 0 for r in run)))
    found = zero_prices.runs(df)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert {r[2] for r in expected} == set(zero_prices.KINDS)
    kinds = {r["kind"]: r for r in zero_prices.by_kind(found).collect()}
    for k in zero_prices.KINDS:
        own = [r for r in expected if r[2] == k]
        assert (kinds[k]["n_runs"], kinds[k]["n_rows"], kinds[k]["longest"]) == (len(own), sum(r[5] for r in own), max(r[5] for r in own))
    assert sum(r["share"] for r in kinds.values()) == pytest.approx(1)
    by = zero_prices.by_dimension(df).collect()
    for name, place in (("upc", 0), ("store", 1), ("week", 2)):
        assert {r["key"]: (r["n_rows"], r["n_zero"]) for r in by if r["dimension"] == name} == {
            k: (sum(r[place] == k for r in data), sum(r[place] == k and (r[3] or 0) <= 0 for r in data)) for k in {r[place] for r in data}
        }
    assert zero_prices.runs(df.limit(0)).count() == zero_prices.by_kind(found.limit(0)).count() == 0
