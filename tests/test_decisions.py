"""Attribution, elasticity tables, price responses, models and studies against numpy and closed forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.ranges import quantiles
from pricemill.operators import attribution, audit, cleaning, commercial, decisions, elasticity, features, models, monitoring, policies, regression, response, series, service, studies
from pricemill.sources import planted, tables
from tests import panels
from tests.test_pricing import STATS, _context


@pytest.fixture(scope="module")
def panel(spark):
    return cleaning.canonical(panels.movement(spark), panels.products(spark)).cache()


@pytest.fixture(scope="module")
def rows(panel):
    return features.with_seasonality(features.training_rows(features.with_split(series.with_series_stats(features.features(panel))))).cache()


def test_each_left_out_guardrail_is_a_decision_of_its_own(spark):
    cases = [_context(spark, STATS[k], e, p, c) for k, e, p, c in (("wide", -2.0, 4.0, 2.5), ("narrow", -0.5, 4.0, 2.5), ("medium", -4.0, 4.0, 3.9), ("thin", -1.5, 4.0, 2.5), ("ineligible", -2.0, 4.0, 2.5))]
    df = cases[0].withColumn("store", F.lit(0))
    for i, c in enumerate(cases[1:], 1):
        df = df.unionByName(c.withColumn("store", F.lit(i)))
    found = attribution.variants(df)
    got = {(r["store"], r["left_out"]): r for r in found.collect()}
    assert len(got) == 5 * 11
    for name in ("baseline", *attribution.CONSTRAINTS):
        for r in decisions.recommend(df, disabled=frozenset({name})).collect():
            other = got[r["store"], name]
            assert (r["decision"], r["proposed_price"], r["reason_codes"]) == (other["decision"], other["proposed_price"], other["reason_codes"])
    table = {(r["store"], r["constraint"]): r for r in attribution.by_constraint(found).collect()}
    assert table[0, "MAX_PRICE_CHANGE"]["binding"] and table[0, "MAX_PRICE_CHANGE"]["changed_price"] and table[0, "MAX_PRICE_CHANGE"]["removed_candidates"] > 0
    assert table[1, "EXTRAPOLATION"]["binding"] and table[4, "HISTORICAL_SUPPORT"]["binding"] and not table[0, "MAX_PRICE"]["present"]
    assert table[2, "RISK_GATE"]["binding"] and not table[0, "RISK_GATE"]["binding"]
    by = {r["store"]: r for r in attribution.by_context(found).collect()}
    assert by[0]["unconstrained_optimum"] == pytest.approx(5.0, abs=0.03) and by[0]["analytic_optimum"] == pytest.approx(5.0) and by[0]["first_binding"] == "MAX_PRICE_CHANGE"
    assert by[4]["determinant"] == "screened" and by[4]["first_binding"] == "HISTORICAL_SUPPORT" and by[0]["determinant"] == "guardrail_corner"


def test_margins_share_one_code(spark):
    row = decisions.recommend(_context(spark, STATS["wide"], eps=-4.0, p=4.0, c=3.9)).first()
    assert "MARGIN_CONSTRAINT" in row["reason_codes"] and set(row["guards"]) <= set(decisions.CODES)


def test_controlled_slopes_against_numpy(spark):
    rng = np.random.default_rng(5)
    raw = [(int(u), int(s), int(w), *map(float, v)) for u in range(2) for s in range(4) for w in range(30) for v in [rng.normal(size=3)]]
    df = spark.createDataFrame([(u, s, w, x + 0.5 * z, z, -2 * (x + 0.5 * z) + z + e * (1 + s)) for u, s, w, x, z, e in raw], "upc long, store int, week int, x double, z double, y double")
    df = df.withColumn("none", F.lit(1.0))
    out = {r["upc"]: r for r in regression.controlled_slopes(regression.within(df, ["x", "z", "none", "y"], ["upc", "store"]), "upc", ["z", "none"]).collect()}
    data = np.array(df.select("upc", "store", "week", "x", "z", "y").collect(), float)
    for u in range(2):
        own = data[data[:, 0] == u]
        X, y = own[:, 3:5].copy(), own[:, 5].copy()
        for s in range(4):
            i = own[:, 1] == s
            X[i] -= X[i].mean(axis=0)
            y[i] -= y[i].mean()
        inverse = np.linalg.inv(X.T @ X)
        beta = inverse @ X.T @ y
        e, n = y - X @ beta, len(y)
        dof = n - 2 - 4
        meats = {"hc1": (X * e[:, None]).T @ (X * e[:, None]) * n / dof}
        for name, column in (("store", 1), ("week", 2)):
            sums = np.array([(X * e[:, None])[own[:, column] == g].sum(axis=0) for g in np.unique(own[:, column])])
            meats[name] = sums.T @ sums * len(sums) / (len(sums) - 1) * (n - 1) / dof
        assert out[u]["estimate"] == pytest.approx(beta[0])
        for name, meat in meats.items():
            assert out[u][f"std_error_{name}"] == pytest.approx(np.sqrt((inverse @ meat @ inverse)[0, 0]))


def test_elasticity_table_screens_and_falls_back(spark, panel):
    config = Config({"elasticity": {"min_obs_per_upc": 100}})
    train = features.with_split(panel).where("split = 'train'")
    table = elasticity.elasticity_table(train, config)
    got = {r["upc"]: r for r in table.products.collect()}
    truth = {u: panels.elasticity_of(u) for u in got}
    assert all(abs(r["estimate"] - truth[u]) < max(0.3, 4 * r["std_error"]) for u, r in got.items())
    assert all(r["elasticity_source"] == "shrunk_product" and r["ci_low"] < r["estimate"] < r["ci_high"] for r in got.values())
    few = elasticity.elasticity_table(train.where("upc > 1 or week < 10"), config)
    poor = few.products.where("upc = 1").first()
    assert poor["reject_reason"] == "insufficient_observations_or_price_variation" and poor["estimate"] is None and poor["elasticity_source"] == "pooled_fallback"
    contexts = _context(spark, STATS["wide"]).drop("elasticity", "elasticity_source").withColumn("upc", F.lit(99).cast("long"))
    assert tuple(few.attach(contexts).select("elasticity", "elasticity_source").first()) == (few.pooled, "pooled_fallback")
    assert elasticity.fixed(-1.5).attach(contexts).first()["elasticity"] == -1.5
    assert {r["n"] for r in elasticity.shrinkage_variants(table.products, -2.0).collect()} == {5}
    assert elasticity.weight_bands(table.products).agg(F.sum("n")).first()[0] == 5


def test_reml_by_aggregates_equals_arrays(spark):
    rng = np.random.default_rng(2)
    values = [(float(rng.normal(-2, 0.5)), float(rng.uniform(0.1, 0.4))) for _ in range(40)]
    df = spark.createDataFrame(values, "estimate double, std_error double").coalesce(1).cache()
    a, b = regression._reml_by_aggregates(df, rounds=25), regression.tau2_reml(*np.array(values).T, rounds=25)
    assert a == pytest.approx(b, rel=1e-6)


def test_t_quantiles():
    assert [regression.t_quantile(0.975, d) for d in (1, 4, 30, 1e7)] == pytest.approx([12.7062, 2.77645, 2.04227, 1.95996], rel=1e-5)


def test_responses_agree_at_the_reference_price(spark, rows, tmp_path):
    model = models.DemandModel("ridge", min_frequency=10).fit(rows.where("split = 'train'"))
    model.save(f"file://{tmp_path}/model")
    again = models.DemandModel.load(f"file://{tmp_path}/model")
    test = response.with_reference_price(rows.where("split = 'test'"))
    left, right = ({(r["upc"], r["store"], r["week"]): r["predicted"] for r in m.predict(test).collect()} for m in (model, again))
    assert left == pytest.approx(right)
    hybrid = response.PriceResponse(model, "pooled", elasticity.pooled(-2.0))
    same = {(r["upc"], r["store"], r["week"]): r["predicted"] for r in hybrid.predict(test).collect()}
    assert same == pytest.approx(left)
    dearer = {(r["upc"], r["store"], r["week"]): r["predicted"] for r in hybrid.predict(test.withColumn("effective_unit_price", F.col("effective_unit_price") * 2)).collect()}
    assert dearer == pytest.approx({k: v / 4 for k, v in left.items()})
    with pytest.raises(ValueError):
        hybrid.predict(rows)
    with pytest.raises(ValueError):
        response.PriceResponse(model, "shrunk")
    last = rows.where("week = 90")
    found = {m: response.PriceResponse(model, m, None if m == "ml" else elasticity.pooled(-2.0)).recommend(last) for m in ("ml", "pooled")}
    counts = {m: df.count() for m, df in found.items()}
    assert counts["ml"] == counts["pooled"] == last.count()
    pair = response.disagreement(found).first()
    assert pair["pair"] == "ml vs pooled" and pair["n"] == counts["ml"] and 0 <= pair["share_same_decision"] <= 1
    assert response.disagreement({"a": found["pooled"], "b": found["pooled"]}).first()["share_same_price"] == 1
    assert {r["method"]: r["n"] for r in response.by_method(found).collect()} == counts
    metrics = models.scored_by({"one": model, "two": again}, rows.where("split = 'valid'"))
    assert models.selected(metrics) == "one"


def test_native_candidates_are_the_models_own(spark, rows):
    model = models.DemandModel("ridge", min_frequency=10).fit(rows.where("split = 'train'"))
    own = response.PriceResponse(model, "ml")
    last = rows.where("week = 90")
    simulated = own.simulate(own.contexts(last).withColumn("grid", F.array(F.col("current_price") * 0.9, F.col("current_price")))).collect()
    now = {(r["upc"], r["store"]): r["predicted"] for r in model.predict(last).collect()}
    cheap = {(r["upc"], r["store"]): r["predicted"] for r in model.predict(response.at_price(last, F.col("effective_unit_price") * 0.9)).collect()}
    for r in simulated:
        assert [c["units"] for c in r["candidates"]] == pytest.approx([cheap[r["upc"], r["store"]], now[r["upc"], r["store"]]])


def test_sweep_finds_the_closed_form(spark):
    row = response.sweep(_context(spark, STATS["narrow"], eps=-2.0, p=4.0, c=2.3)).first()
    assert row["profit_optimum"] == pytest.approx(4.6, abs=0.06) and row["local_elasticity"] == pytest.approx(-2.0) and row["monotone"] and row["low_outside"] and row["high_outside"]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=501), "b": np.round(rng.exponential(size=300), 1), "c": np.array([2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, own in values.items() for x in own] + [("a", None)], "g string, v double").repartition(5)
    for r in quantiles(df, "g", "v", {"q1": 0.1, "q2": 0.5, "q3": 0.937, "q4": 1.0}).collect():
        assert [r[f"q{i}"] for i in (1, 2, 3, 4)] == pytest.approx(list(np.quantile(values[r["g"]], [0.1, 0.5, 0.937, 1.0])))


def test_costs_do_not_leak_and_windows_cover_the_span(panel):
    got = studies.cost_leakage(panel, features.features).first()
    assert got["n_leaked"] == 0 and got["n_early"] > 0 and got["n_reacting"] == got["n_late"] > 0
    bad = studies.cost_leakage(panel, lambda p: p.withColumn("decision_time_unit_cost", F.col("estimated_unit_aac"))).first()
    assert bad["n_leaked"] > 0
    spans = [tuple(r) for r in studies.stable_windows(panel, 4).collect()]
    assert spans[0][1] == 1 and spans[-1][2] == 90 and all(a[2] + 1 == b[1] for a, b in zip(spans, spans[1:]))


def test_split_of_too_few_weeks_is_an_error(spark):
    few = spark.createDataFrame([(1,), (2,)], "week long")
    with pytest.raises(Exception, match="too few"):
        features.with_split(few).collect()


def test_confounding_misleads(spark, panel):
    errors = {}
    for name in ("clean", "promotions recorded", "promotions not recorded", "prices follow demand"):
        rows = planted.planted(panel, **planted.SCENARIOS[name])
        table = elasticity.elasticity_table(rows, Config({"elasticity": {"min_obs_per_upc": 100}}))
        errors[name] = studies.recovered(rows, table, planted.truth(rows)).first()["pooled_error"]
    assert max(abs(errors["clean"]), abs(errors["promotions recorded"])) < 0.15
    assert min(abs(errors["promotions not recorded"]), abs(errors["prices follow demand"])) > 0.3


def test_planted_units_are_the_same_again(spark, panel):
    one, two = (planted.planted(p, depth=0.2, follows=0.05) for p in (panel, panel.repartition(7)))
    assert one.select(*two.columns).exceptAll(two).isEmpty() and one.count() == panel.count()
    hidden = planted.planted(panel, recorded=False)
    assert hidden.where("recorded_promotion_flag = 1").isEmpty() and not panel.where("recorded_promotion_flag = 1").isEmpty()
    assert planted.planted(panel.limit(0)).count() == 0


def test_copies_are_counted_and_dropped(spark, panel):
    raw = spark.createDataFrame([(1, 1, 1, 5.0, 1.0, 2.0, None, 20.0, 1)] * 3 + [(1, 1, 2, 5.0, 1.0, 2.0, None, 20.0, 0)], "store int, upc long, week int, move double, qty double, price double, sale string, profit double, ok int")
    assert {r["rule"]: r["n_rows"] for r in cleaning.exclusions(raw).collect()} == {"exact_duplicate": 2, "ok_flag_zero": 1, "kept": 1}
    found = {r["measure"]: r["value"] for r in cleaning.raw_audit(raw).collect()}
    assert found["exact_duplicates"] == 2 and found["grain_duplicates"] == 2 and found["null_sale"] == 4 and found["ok=0"] == 1 and found["sale=null"] == 4
    checks = {r["check"]: r["passed"] for r in cleaning.validation(panel).collect()}
    assert all(checks.values()) and len(checks) == 16


def test_prediction_drift(spark):
    a = spark.range(1000).selectExpr("cast(id as double) as v")
    row = monitoring.prediction_drift(a, a.selectExpr("v + 500 as v"), "v").first()
    assert row["band"] == "large" and row["ks"] == pytest.approx(0.5) and row["reference_p95"] == pytest.approx(949.05) and row["reference_share_zero"] == pytest.approx(0.001)
    checks = {r["column"]: r for r in monitoring.schema_check(a, {"v": "double", "w": "string"}).collect()}
    assert checks["v"]["passed"] and not checks["w"]["passed"]


def test_roles_and_caps(spark):
    rows = [(u, s, w, 10.0 * (6 - u), 10.0 * (6 - u) * 2, 4.0 * (6 - u)) for u in range(1, 6) for s in range(2) for w in range(10)]
    panel = spark.createDataFrame(rows, "upc long, store int, week int, move double, revenue double, gross_profit double")
    roles = commercial.priced_roles(panel, panel.selectExpr("upc", "-1.0 - upc as elasticity").distinct())
    got = {r["upc"]: r["role"] for r in roles.collect()}
    assert got[1] == "traffic driver" and set(got) == {1, 2, 3, 4, 5}
    recs = decisions.recommend(_context(spark, STATS["wide"]).withColumn("upc", F.lit(1).cast("long")))
    cap = commercial.traffic_cap(recs, roles, 0.02).first()
    assert cap["affected"] == 1 and 0 < cap["uplift_capped"] < cap["uplift_full"] and commercial.role_summary(recs, roles).first()["role"] == "traffic driver"


def test_transitions_are_checked(spark):
    log = audit.log_rows(decisions.recommend(_context(spark, STATS["wide"])), "2000-01-01T00:00:00Z")
    rec = log.first()["rec_id"]
    none = spark.createDataFrame([], audit.TRANSITION)
    first = audit.append_transition(log, none, rec, "REVIEWED", "2000-01-02T00:00:00Z", "a")
    assert first.first()["from_state"] == "GENERATED"
    second = audit.append_transition(log, first, rec, "APPROVED", "2000-01-03T00:00:00Z")
    assert second.first()["from_state"] == "REVIEWED"
    for bad in ((none, rec, "PUBLISHED"), (none, "no such", "REVIEWED"), (first, rec, "REVIEWED")):
        with pytest.raises(audit.TransitionError):
            audit.append_transition(log, *bad, "2000-01-04T00:00:00Z")


def test_promoted_series_are_doubtful(spark):
    df = _context(spark, STATS["wide"]).withColumn("promotion_share", F.lit(0.8))
    assert decisions.recommend(df).first()["risk_level"] == "MEDIUM"


def test_json_and_sorted_tables(spark, panel, tmp_path):
    folder = f"file://{tmp_path}"
    tables.write_json({"a": float("nan"), "b": [np.int64(3), 1.5]}, f"{folder}/m", spark)
    assert tables.read_json(spark, f"{folder}/m") == {"a": None, "b": [3, 1.5]}
    (tmp_path / "source.json").write_text(json.dumps({"license": "x"}, indent=1))
    assert tables.read_json(spark, f"{folder}/source.json") == {"license": "x"}
    tables.write_sorted(panel, f"{folder}/p")
    files = spark.read.parquet(f"{folder}/p").select("upc", "store", "week", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    for name in {r["f"] for r in files}:
        own = [(r["upc"], r["store"], r["week"]) for r in sorted(files, key=lambda r: r["i"]) if r["f"] == name]
        assert own == sorted(own)
    assert tables.file_fingerprints(spark, f"{folder}/source.json").count() == 1


def test_guards_of_answers(spark):
    df = spark.createDataFrame([("1. We expect 3 more.\nProfit falls by 2.50 to 1,200", [-2.5, 1200.0])], "answer string, facts array<double>")
    assert df.select(service.ungrounded(F.col("answer"), F.col("facts")).alias("x")).first()["x"] == []
    faults = df.select(service.phrase_faults(F.col("answer"), ["profit FALLS", "causes"], ["model-internal"]).alias("x")).first()["x"]
    assert faults == ["forbidden: profit FALLS", "missing: model-internal"]


def test_regret_of_known_elasticities(spark):
    recs = decisions.recommend(_context(spark, STATS["wide"], eps=-2.0, p=4.0, c=2.5))
    known = spark.createDataFrame([(111, -2.0)], "upc long, true_elasticity double")
    row = studies.regret(recs, known).first()
    assert row["n"] == 1 and row["share_right_direction"] == 1 and row["current_of_best"] < row["recommended_of_best"] <= 1
    assert studies.tracked(recs, known.withColumn("store", F.lit(2))).count() == 1 and studies.tracked(recs, known.withColumn("store", F.lit(3))).count() == 0


def test_own_policies_keep_the_limits(spark):
    recs = decisions.recommend(_context(spark, STATS["wide"], p=4.0, c=2.5))
    rows = {r["policy"]: r["price"] for r in policies.policy_prices(recs, Config().policy("standard"), more={"double": F.col("current_price") * 2}).collect()}
    assert rows["double"] == pytest.approx(4.4) and len(rows) == 5


def test_log_rows_as_documents(spark):
    log = audit.log_rows(decisions.recommend(_context(spark, STATS["wide"])), "2000-01-01T00:00:00Z")
    row, back = log.first(), audit.from_documents(audit.as_documents(log)).first()
    assert (back["decision"], back["recommended_price"], back["codes"]) == (row["decision"], row["recommended_price"], row["reason_codes"])
