"""Hand-computed cases and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.config import Config, merged
from pricemill.functions import columns as C
from pricemill.functions.ranges import running_totals
from pricemill.operators import audit, cleaning, decisions, elasticity, features, models, monitoring, regression, studies
from pricemill.sources import tables
from tests import panels

MOVEMENT = [
    (2, 111, 10, 10.0, 1.0, 3.00, None, 25.0, 1), (2, 111, 11, 20.0, 1.0, 2.50, "B", 10.0, 1), (2, 111, 12, 0.0, 1.0, 3.00, None, 25.0, 1), (2, 111, 13, 99.0, 1.0, 3.00, "S", 25.0, 0),
    (2, 222, 10, 5.0, 2.0, 5.00, "C", 40.0, 1), (5, 111, 10, 8.0, 1.0, 3.20, None, 30.0, 1), (5, 222, 11, 4.0, 1.0, 5.00, "G", 40.0, 1), (5, 333, 12, 3.0, 0.0, 4.00, None, 20.0, 1),
]


@pytest.fixture(scope="module")
def movement(spark):
    return spark.createDataFrame(MOVEMENT, "store int, upc long, week int, move double, qty double, price double, sale string, profit double, ok int")


def test_each_rule_counts_what_it_removes(movement):
    counts = {r["rule"]: r["n_rows"] for r in cleaning.exclusions(movement).collect()}
    assert counts == {"ok_flag_zero": 1, "non_positive_qty": 1, "kept": 6}


def test_canonical_rows(spark, movement):
    products = spark.createDataFrame([(311, 111, "TEST FLAKES", "12 OZ", 12, 1), (311, 111, "ZZ", "1 LB", 12, 1), (311, 999, "NEVER", None, 1, 4)], tables.PRODUCTS)
    rows = {(r["upc"], r["store"], r["week"]): r for r in cleaning.canonical(movement.union(movement), products).collect()}
    assert len(rows) == 6
    bundle, unknown = rows[222, 2, 10], rows[222, 5, 11]
    assert bundle["effective_unit_price"] == 2.5 and bundle["bundle_flag"] == 1 and bundle["estimated_unit_aac"] == pytest.approx(1.5) and bundle["has_metadata_flag"] == 0
    assert unknown["recorded_promotion_type"] == "UNKNOWN_CODE" and unknown["recorded_promotion_flag"] == 0
    assert rows[111, 2, 10]["descrip"] == "TEST FLAKES" and str(rows[111, 2, 10]["week_start_date"]) == "1989-11-16"
    assert cleaning.join_report(movement, products).first().asDict() == {"moved": 3, "described": 2, "described_again": 1, "moved_only": 2, "described_only": 1}


def _panel(spark, weeks=30):
    rows = [(111, 2, w, float(50 + (7 * w) % 13), 3.0 + 0.1 * (w % 5), 0.25) for w in range(1, weeks + 1) if w != 9]
    df = spark.createDataFrame(rows, "upc long, store int, week int, move double, price double, rate double")
    return df.selectExpr("*", "price as effective_unit_price", "price * (1 - rate) as estimated_unit_aac", "0 as recorded_promotion_flag")


def test_features_never_see_their_own_week(spark):
    panel = _panel(spark)
    poisoned = panel.withColumn("move", F.when(F.col("week") >= 20, 1e9).otherwise(F.col("move"))).withColumn("estimated_unit_aac", F.when(F.col("week") >= 20, 1e9).otherwise(F.col("estimated_unit_aac")))
    keep = ["week", "lag_move_1", "roll_mean_move_13", "roll_std_move_4", "series_reference_price", "decision_time_unit_cost"]
    before, after = (features.features(p).where("week <= 20").select(*keep).orderBy("week").collect() for p in (panel, poisoned))
    assert before == after
    row = {r["week"]: r for r in features.features(panel).collect()}
    assert row[1]["lag_move_1"] is None and row[10]["lag_move_1"] == row[8]["move"]  # lags count rows, not weeks
    assert row[2]["roll_mean_move_4"] is None and row[3]["roll_mean_move_4"] == pytest.approx((row[1]["move"] + row[2]["move"]) / 2)
    assert row[4]["series_reference_price"] == pytest.approx(float(np.median([row[i]["price"] for i in (1, 2, 3)])))


def test_arc_elasticity_and_package_size(spark):
    df = spark.createDataFrame([(2.0, 10.0, 3.0, 5.0, "1.5 lb"), (2.0, 10.0, 2.0, 5.0, "12 OZ"), (2.0, -1.0, 3.0, 5.0, "BOX")], "p1 double, q1 double, p2 double, q2 double, size string")
    out = df.select(C.arc_elasticity(*(F.col(c) for c in ("p1", "q1", "p2", "q2"))).alias("e"), C.package_ounces(F.col("size")).alias("oz")).collect()
    assert out[0]["e"] == pytest.approx((-5 / 7.5) / (1 / 2.5)) and out[1]["e"] is None and out[2]["e"] is None
    assert [r["oz"] for r in out] == [24.0, 12.0, None]


def _context(spark, stats, eps=-2.0, p=4.0, c=2.5, source="product_shrunk"):
    n, k, cv, lo, hi = stats
    types = "upc long, store int, week int, current_price double, unit_cost double, base_units double, elasticity double, elasticity_source string, n_obs long, n_distinct_prices long, price_cv double, price_min double, price_max double"
    return spark.createDataFrame([(111, 2, 380, p, c, 120.0, eps, source, n, k, cv, lo, hi)], types)


STATS = {
    "wide": (400, 40, 0.25, 1.0, 12.0), "narrow": (400, 40, 0.25, 3.90, 4.10), "medium": (100, 10, 0.20, 1.0, 12.0), "thin": (45, 6, 0.20, 1.0, 12.0), "no_support": (400, 40, 0.25, None, None), "ineligible": (15, 2, 0.01, 1.0, 12.0),
}


@pytest.mark.parametrize("profile", ["conservative", "standard", "aggressive"])
def test_invariants_of_decisions(spark, profile):
    parts = [_context(spark, s, e, p, c) for s in STATS.values() for e in (-0.5, -1.5, -2.03, -4.0) for p, c in ((4.0, 2.5), (4.0, 3.9))]
    df = parts[0]
    for x in parts[1:]:
        df = df.unionByName(x)
    policy = Config().policy(profile)
    for r in decisions.recommend(df, profile).collect():
        if r["decision"] != "RECOMMEND_CHANGE":
            assert r["recommended_price"] == r["current_price"] and r["realisable_uplift"] == 0
        if r["risk_level"] == "HIGH":
            assert r["decision"] != "RECOMMEND_CHANGE" or profile == "aggressive"
        if r["n_obs"] == 15:
            assert r["decision"] == "KEEP_CURRENT" and "INSUFFICIENT_HISTORY" in r["reason_codes"]
        if r["decision"] != "KEEP_CURRENT":
            assert abs(r["proposed_price"] / r["current_price"] - 1) <= policy["max_price_change_pct"] + 1e-9
            assert r["low"] - 1e-9 <= r["proposed_price"] <= r["high"] + 1e-9 and r["proposed_price"] >= r["unit_cost"]
            assert r["model_internal_estimated_uplift"] >= policy["materiality_threshold_pct"]


def test_grid_optimum_is_the_closed_form(spark):
    config = Config({"policy_profiles": {"aggressive": {"max_price_change_pct": 0.9}}})
    row = decisions.recommend(_context(spark, STATS["wide"], eps=-2.0, p=4.0, c=2.5), "aggressive", config).first()
    assert row["proposed_price"] == pytest.approx(5.0, abs=0.03)  # c * e / (1 + e)
    assert row["decision"] == "RECOMMEND_CHANGE" and row["risk_level"] == "LOW"
    assert row["units_proposed"] == pytest.approx(120 * (row["proposed_price"] / 4.0) ** -2)


def test_reasons_and_risk(spark):
    narrow = decisions.recommend(_context(spark, STATS["narrow"], eps=-0.5), "standard").first()
    assert "OUTSIDE_EXTRAPOLATION_RANGE" in narrow["reason_codes"] and narrow["risk_level"] == "MEDIUM"
    cost = decisions.recommend(_context(spark, STATS["wide"], c=None), "standard").first()
    assert cost["reason_codes"] == ["COST_UNAVAILABLE", "KEEP_CURRENT_OPTIMAL"] and cost["decision"] == "KEEP_CURRENT"
    infeasible = decisions.recommend(_context(spark, STATS["wide"], p=4.0, c=6.0), "standard").first()
    assert "NO_FEASIBLE_PRICE" in infeasible["reason_codes"] and infeasible["n_candidates"] == 0
    pooled = decisions.recommend(_context(spark, STATS["wide"], source="pooled_fallback"), "standard").first()
    assert pooled["risk_level"] == "MEDIUM" and "POOLED_ELASTICITY_FALLBACK" in pooled["reason_codes"]
    assert decisions.recommend(_context(spark, STATS["no_support"]), "standard").first()["risk_level"] == "HIGH"


def _design(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(s), int(w), float(x), float(-2 * x + 0.3 * u + 0.1 * s + rng.normal(0, 0.2))) for u in range(3) for s in range(4) for w in range(25) for x in [rng.normal(1, 0.3)]]
    return spark.createDataFrame(rows, "upc long, store int, week int, x double, y double"), np.array(rows)


def test_regression_against_numpy(spark):
    df, raw = _design(spark)
    rows = regression.within(df, ["x", "y"], ["upc", "store"])
    fit = regression.Fit(rows, "y", ["x"], absorbed=12)
    x, y = raw[:, 3].copy(), raw[:, 4].copy()
    for u in range(3):
        for s in range(4):
            own = (raw[:, 0] == u) & (raw[:, 1] == s)
            x[own] -= x[own].mean()
            y[own] -= y[own].mean()
    beta = (x @ y) / (x @ x)
    e, n = y - beta * x, len(x)
    assert fit.beta[0] == pytest.approx(beta)
    assert fit.classical()[0, 0] == pytest.approx((e @ e) / (n - 13) / (x @ x))
    assert fit.hc1()[0, 0] == pytest.approx(n / (n - 13) * ((x * e) @ (x * e)) / (x @ x) ** 2)
    sums = np.array([(x * e)[raw[:, 2] == w].sum() for w in range(25)])
    assert fit.clustered(["week"])[0, 0] == pytest.approx(25 / 24 * (n - 1) / (n - 13) * (sums @ sums) / (x @ x) ** 2)
    assert fit.two_way("upc", "week")[0, 0] >= 0
    by = {r["upc"]: r for r in regression.slopes(rows, "upc").collect()}
    assert len(by) == 3 and all(abs(r["estimate"] + 2) < 0.2 for r in by.values())
    several = regression.slope_by_group(rows.withColumn("twice", F.col("x") * 2), "upc", ["x", "twice"]).collect()
    assert all(r["beta_twice"] is None and r["beta_x"] == pytest.approx(by[r["upc"]]["estimate"]) for r in several)


def test_shrinkage_lies_between_slope_and_prior(spark):
    table = spark.createDataFrame([(1, -2.5, 0.1), (2, -1.5, 0.4), (3, -3.0, 0.2), (4, 0.5, 0.1), (5, -2.0, 9.0)], "upc long, estimate double, std_error double")
    rows = {r["upc"]: r for r in regression.shrunk(table, pooled=-2.0).collect()}
    assert all(min(r["estimate"], -2.0) <= r["elasticity_shrunk"] <= max(r["estimate"], -2.0) for k, r in rows.items() if k < 4)
    assert rows[1]["shrinkage_weight"] > rows[2]["shrinkage_weight"]
    assert rows[4]["elasticity_source"] == rows[5]["elasticity_source"] == "pooled_fallback" and rows[4]["elasticity_final"] == -2.0


def test_drift_and_alerts(spark):
    a = spark.range(1000).selectExpr("cast(id as double) as v")
    shifted = a.selectExpr("v + 500 as v")
    assert monitoring.psi(a, a, ["v"]).first()["psi"] == pytest.approx(0, abs=1e-9)
    assert monitoring.ks(a, shifted, ["v"]).first()["ks"] == pytest.approx(0.5)
    drift = monitoring.psi(a, shifted, ["v"])
    assert drift.first()["psi"] > 0.25
    periods = spark.createDataFrame([("1995Q1", 0.8, -11.0), ("1995Q2", 0.1, 1.0)], "period string, wape double, bias double")
    assert sorted(r["kind"] for r in monitoring.alerts(drift, periods).collect()) == ["bias", "psi", "wape"]


def test_log_states(spark, tmp_path):
    audit.check_transition("GENERATED", "REVIEWED")
    with pytest.raises(audit.TransitionError):
        audit.check_transition("GENERATED", "PUBLISHED")
    log = audit.log_rows(decisions.recommend(_context(spark, STATS["wide"])), "2000-01-01T00:00:00Z")
    folder = f"file://{tmp_path}/log"
    assert tables.append_log(log, folder) != tables.append_log(log.drop("reason_codes"), folder)
    rec = log.first()["rec_id"]
    moves = spark.createDataFrame([(rec, "2000-01-02", "REVIEWED"), (rec, "2000-01-03", "REJECTED")], "rec_id string, transitioned_at_utc string, to_state string")
    assert audit.current_state(log, moves).first()["state"] == "REJECTED" and audit.review_queue(log, moves).count() == 0


def test_csv_reading(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("STORE , upc,WEEK,MOVE,QTY,PRICE,SALE,PROFIT,OK,PRICE_HEX\n2,111,10,5,1,3.00,é,25,1,FF\n.,111,11,NA,1,2,,N/A,1,FF\n".encode("latin-1"))
    rows = tables.read_movement(spark, f"file://{tmp_path}/m.csv").collect()
    assert rows[0]["sale"] == "é" and rows[0]["price"] == 3.0 and rows[1]["store"] is None and rows[1]["move"] is None and rows[1]["sale"] is None
    (tmp_path / "bad.csv").write_text("store,upc\n1,2\n")
    with pytest.raises(tables.SchemaError):
        tables.read_movement(spark, f"file://{tmp_path}/bad.csv")


def test_settings_merge():
    base = {"a": {"b": 1, "c": 2}}
    assert merged(base, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and base["a"]["b"] == 1
    with pytest.raises(KeyError):
        Config()["no.such"]


def test_running_totals_over_ranges(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as long) as v").repartition(8)
    rows = running_totals(df, -F.col("id"), [F.desc("id")], {"n": F.lit(1).cast("long"), "total": F.col("v")}).orderBy(F.desc("id")).collect()
    assert [r["n"] for r in rows] == list(range(1, 1001))
    assert [r["total"] for r in rows] == np.cumsum([i % 7 for i in range(999, -1, -1)]).tolist()


def test_known_elasticities_are_found_again(spark):
    panel = cleaning.canonical(panels.movement(spark, upcs=6, stores=5, weeks=120))
    fits = regression.slopes(regression.within(regression.loglog(panel), ["x", "y"], ["upc", "store"]), "upc")
    rows = fits.collect()
    assert len(rows) == 6 and all(abs(r["estimate"] - panels.elasticity_of(r["upc"])) < max(0.3, 4 * r["std_error"]) for r in rows)


def test_bootstrap_brackets_the_rate(spark):
    rows = spark.range(400).selectExpr("id % 20 as upc", "1 as store", "if(id % 2 = 0, 'LOW', 'HIGH') as risk_level", "10.0 as actual", "10.0 + (id % 5) as predicted")
    for r in studies.bootstrap_bands(rows, 200).collect():
        assert r["low"] <= r["wape"] <= r["high"]


def test_excluded_positions_and_sample(spark):
    rows = [(1, 1, w, w not in (1, 4, 7)) for w in range(1, 8)] + [(2, 1, 3, False)]
    df = spark.createDataFrame(rows, "upc long, store long, week long, ok boolean")
    assert {r["position"]: r["n"] for r in studies.positions(df, ~F.col("ok")).collect()} == {"leading": 1, "interior": 1, "trailing": 1, "no_valid_week": 1}
    assert studies.seeded_sample(df, ["upc", "week"], 3).collect() == studies.seeded_sample(df.repartition(5), ["upc", "week"], 3).collect()


def test_models_learn_the_price_response(spark):
    panel = cleaning.canonical(panels.movement(spark, upcs=4, weeks=80))
    rows = features.with_seasonality(features.training_rows(features.with_split(features.features(panel))))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    naive = models.evaluate(models.long_forecasts(models.with_baselines(test, train)), ["model"]).toPandas().set_index("model").wape
    for family in models.FAMILIES:
        wape = models.DemandModel(family, boosting={"rounds": 8, "rate": 0.3, "leaves": 15, "least_rows": 10}).fit(train).predict(test).agg(models.metric_columns(F.col("move"), F.col("predicted"))["wape"]).first()[0]
        assert wape < naive.min()


def test_clustered_errors_beside_the_robust_one(spark):
    rows = [(1, 9, -2.0, 0.5, 1.5, 1.25), (2, 9, -1.0, 0.5, None, 1.0), (3, 9, None, 0.5, 0.5, 0.5), (4, 9, 3.0, 0.0, 0.0, 0.0), (5, 9, -4.0, 1.0, 0.5, 0.25)]
    products = spark.createDataFrame(rows, "upc long, n_obs long, estimate double, std_error_hc1 double, std_error_store double, std_error_week double")
    found = {r["upc"]: r for r in elasticity.error_ratios(products).collect()}
    assert set(found) == {1, 2, 4, 5}
    assert [found[1][c] for c in ("ratio_store", "ratio_week", "ratio_clustered", "significant_hc1", "significant_clustered")] == [3.0, 2.5, 3.0, 1.0, 0.0]
    assert [found[2][c] for c in ("ratio_store", "ratio_clustered", "significant_clustered")] == [None, 2.0, 0.0]
    assert [found[4][c] for c in ("ratio_clustered", "significant_hc1")] == [None, None] and found[5]["significant_clustered"] == 1.0
    by = {r["statistic"]: r for r in elasticity.error_summary(elasticity.error_ratios(products)).collect()}
    values = {"ratio_clustered": [3.0, 2.0, 0.5], "std_error_store": [1.5, 0.0, 0.5], "significant_clustered": [0.0, 0.0, 1.0]}
    for name, own in values.items():
        assert (by[name]["n"], by[name]["mean"], by[name]["median"], by[name]["p90"]) == pytest.approx((len(own), np.mean(own), np.median(own), np.quantile(own, 0.9)))
    assert elasticity.error_summary(elasticity.error_ratios(products.limit(0))).count() == 0
