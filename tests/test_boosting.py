"""Poisson boosting against a plain booster over rows, and as a demand model."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.operators import models
from pricemill.operators.boosting import Feature, PoissonTrees, best_splits, category_features, numeric_features


def _plain(bins, y, features, m):
    """Boosting of a matrix of bins, one split at a time, with histograms of a node's own rows."""
    raw = np.full(len(y), math.log(y.mean()))

    def settled(rows):
        g, h = np.exp(raw[rows]) - y[rows], np.exp(raw[rows])
        best = None
        for i, f in enumerate(features):
            sums = np.stack([np.bincount(bins[rows, i], w, f.missing + 1) for w in (g, h, np.ones(len(rows)))], 1)
            for s in best_splits(f, i, sums, g.sum(), h.sum(), len(rows), m.l2, m.least_rows):
                if s.gain > 0 and (best is None or s.gain > best.gain * (1 + 1e-9)):
                    best = s
        return -m.rate * g.sum() / (h.sum() + m.l2), best

    for _ in range(m.rounds):
        leaves, heap, tick = {}, [], 0

        def push(rows):
            nonlocal tick
            value, split = settled(rows)
            leaves[tick] = (rows, value)
            if split:
                heapq.heappush(heap, (-split.gain, tick, split))
            tick += 1

        push(np.arange(len(y)))
        while heap and len(leaves) < m.leaves:
            _, k, s = heapq.heappop(heap)
            rows, _ = leaves.pop(k)
            b, f = bins[rows, s.feature], features[s.feature]
            left = np.isin(b, s.bins) if f.category else (b <= s.at) | (s.missing_left & (b == f.missing))
            push(rows[left])
            push(rows[~left])
        for rows, value in leaves.values():
            raw[rows] = raw[rows] + value
    return np.exp(raw)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 3000
    a, b = rng.normal(size=n).round(2), rng.exponential(size=n)
    kind = rng.choice(["u", "v", "w", "x", None], n)
    y = rng.poisson(np.exp(0.6 * np.sin(2 * a) + 0.4 * (b > 1) + np.where(kind == "v", 1.0, 0.0)))
    rows = [(None if i % 11 == 0 else float(p), float("nan") if i % 13 == 0 else float(q), k, float(v)) for i, (p, q, k, v) in enumerate(zip(a, b, kind, y))]
    return spark.createDataFrame(rows, "a double, b double, kind string, y double").repartition(5)


def test_trees_equal_a_plain_booster(table):
    model = PoissonTrees(rounds=4, rate=0.3, leaves=12, least_rows=20, bins=24).fit(table, ["a", "b"], ["kind"], "y")
    found = model.predicted(table, "p").select("y", "p", *(f.bin().alias(f"bin{i}") for i, f in enumerate(model.features))).toPandas()
    bins = found[[f"bin{i}" for i in range(3)]].to_numpy(np.int64)
    assert np.allclose(found["p"], _plain(bins, found["y"].to_numpy(), model.features, model), rtol=1e-9)

    def leaves(t):
        return 1 if "value" in t else leaves(t["left"]) + leaves(t["right"])

    assert [leaves(t) for t in model.trees] == [12] * 4
    assert min(model.gains().values()) > 0
    again = PoissonTrees.from_facts(model.facts())
    assert again.predicted(model.predicted(table, "p"), "q").select(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] == 0
    loss = lambda p: float(np.mean(p - found["y"] * np.log(p)))
    assert loss(found["p"]) < loss(np.full(len(found), found["y"].mean())) - 0.05


def test_bins_and_unseen_values(spark, table):
    numbers, kinds = numeric_features(table, ["a", "b"], 16), category_features(table, ["kind"], 3)
    assert all(len(f.edges) == 15 for f in numbers) and len(kinds[0].levels) == 3
    odd = spark.createDataFrame([(None, "u"), (float("nan"), None), (-9e9, "new"), (9e9, "v")], "a double, kind string")
    rows = odd.select(numbers[0].bin().alias("a"), Feature("kind", levels=("u", "v"), category=True).bin().alias("k")).collect()
    assert [tuple(r) for r in rows] == [(16, 0), (16, 2), (0, 2), (15, 1)]
    constant = table.limit(50).withColumn("c", F.lit(1.0))
    assert numeric_features(constant, ["c"], 16)[0].edges == ()
    flat = PoissonTrees(rounds=1, least_rows=5).fit(constant, ["c"], [], "y")
    assert set(flat.trees[0]) == {"value"} and abs(flat.trees[0]["value"]) < 1e-9


def test_no_rows_or_no_demand_is_an_error(spark, table):
    for rows in (table.limit(0), table.limit(5).withColumn("y", F.lit(0.0)), table.withColumn("y", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            PoissonTrees(rounds=1).fit(rows, ["a"], ["kind"], "y")


def test_demand_model_of_trees_is_kept(spark, sf_dir, tmp_path):
    from pricemill.plans import queries

    rows = queries._model_rows(spark, sf_dir)
    train, valid = rows.where("split = 'train'"), rows.where("split = 'valid'")
    model = models.DemandModel("boosted", boosting={"rounds": 3, "rate": 0.3, "leaves": 8}).fit(train)
    model.save(f"file://{tmp_path}/trees")
    again = models.DemandModel.load(f"file://{tmp_path}/trees")
    both = again.predict(model.predict(valid, "one"), "two")
    assert both.where("abs(one - two) > 1e-9").count() == 0
    assert both.where("one < 0 or one is null").count() == 0
