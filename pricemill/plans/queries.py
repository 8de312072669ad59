"""The library's queries over the sales tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.columns import arc_elasticity, best_price, price_change, price_index, r6
from pricemill.functions.kept import keep, shared_path
from pricemill.functions.ranges import quantiles
from pricemill.operators import admission, attribution, audit, cleaning, commercial, decisions, elasticity, features, incremental, models, monitoring, policies, regression, response, series, service, sketches, studies, walk_forward, zero_prices
from pricemill.sources import planted
from pricemill.sources.tables import append_log, fingerprint, movement_from_sales, read_log
from pricemill.streaming import outcomes
from pricemill.streaming.weekly import append_batches

#: Settings of these queries: the sales tables begin on a Monday of 1995.
CONFIG = Config({"data": {"week1_start_date": "1995-01-02"}})
KEYS = ["upc", "store", "week"]


def _movement(spark: SparkSession, d: str) -> DataFrame:
    return movement_from_sales(spark, d)


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.canonical(_movement(spark, d), config=CONFIG)


def _stored_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel for queries that read it more than once: the sales are read, joined and summed once, and what is read again
    is a row a product, store and week."""
    return keep(_panel(spark, d), "panel").rows


def _features(spark: SparkSession, d: str) -> DataFrame:
    return features.features(_panel(spark, d), CONFIG)


def _stored_features(panel: DataFrame) -> DataFrame:
    """The features of a stored panel for queries that read them more than once."""
    return keep(features.features(panel, CONFIG), "features").rows


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers as long."""
    kinds = {"double": r6, "int": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long")}
    return df.select(*(kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))


def panel_canonical(spark, d):
    cols = [*KEYS, "move", "effective_unit_price", "revenue", "gross_margin_rate", "estimated_unit_aac", "gross_profit", "recorded_promotion_flag", "recorded_promotion_type", "year", "month", "quarter", "week_of_year"]
    return _rounded(_panel(spark, d).select(*cols))


def exclusion_counts(spark, d):
    return cleaning.exclusions(_movement(spark, d), CONFIG)


def validation_checks(spark, d):
    return _rounded(cleaning.validation(_panel(spark, d)))


def table_fingerprint(spark, d):
    return fingerprint(_panel(spark, d).select(*KEYS, "move"))


def scale_summary(spark, d):
    p = _panel(spark, d)
    return _rounded(p.agg(
        F.count("*").alias("n_rows"), F.countDistinct("upc").alias("n_upcs"), F.countDistinct("store").alias("n_stores"), F.countDistinct("week").alias("n_weeks"),
        F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.sum("move").alias("units"), F.sum("revenue").alias("revenue"), F.sum("gross_profit").alias("gross_profit"),
    ))


def numeric_profile(spark, d):
    rows, v = monitoring._long(_panel(spark, d), ["move", "effective_unit_price", "gross_margin_rate"]), F.col("value")
    by = rows.groupBy("feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative")
    )
    shares = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    return _rounded(by.join(quantiles(rows, "feature", "value", shares), "feature"))


def promo_rollup(spark, d):
    by = _panel(spark, d).groupBy("recorded_promotion_type")
    return _rounded(by.agg(F.count("*").alias("n_rows"), F.sum("move").alias("units"), F.sum("revenue").alias("revenue"), F.avg("effective_unit_price").alias("mean_price")))


def weekly_rollup(spark, d):
    by = _panel(spark, d).groupBy("week")
    return _rounded(by.agg(F.count("*").alias("n_rows"), F.sum("move").alias("units"), F.sum("revenue").alias("revenue"), F.avg("recorded_promotion_flag").alias("promotion_share")))


def upc_concentration(spark, d):
    return _rounded(commercial.concentration(_panel(spark, d)))


def product_roles(spark, d):
    return _rounded(commercial.roles(_panel(spark, d)).select("upc", "units", "revenue", "revenue_rank", "role"))


def store_dispersion(spark, d):
    means = _panel(spark, d).groupBy("upc", "store").agg(F.avg("effective_unit_price").alias("m"))
    return _rounded(means.groupBy("upc").agg(F.count("*").alias("n_stores"), F.min("m").alias("lowest"), F.max("m").alias("highest"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std")))


def _variation(spark, d, keys):
    cols = [*keys, "n_obs", "n_weeks", "n_distinct_prices", "price_min", "price_max", "price_mean", "price_std", "total_units", "price_cv", "price_range_pct", "n_price_changes", "price_change_rate"]
    return series.price_variation(_panel(spark, d), keys).select(*cols)


def price_variation_upc(spark, d):
    return _rounded(_variation(spark, d, ["upc"]))


def price_variation_series(spark, d):
    return _rounded(_variation(spark, d, ["upc", "store"]))


def eligible_series(spark, d):
    return series.with_eligibility(_variation(spark, d, ["upc", "store"]), CONFIG).select("upc", "store", "eligible")


def _feature_query(*cols):
    def query(spark, d):
        found = _features(spark, d).withColumn("lag_promotion_1", F.col("lag_promotion_1").cast("double"))
        return _rounded(found.select(*KEYS, *cols))

    return query


lag_features = _feature_query("lag_move_1", "lag_move_2", "lag_move_3", "lag_move_4", "lag_price_1", "lag_price_2", "lag_promotion_1")
rolling_features = _feature_query("roll_mean_move_4", "roll_mean_move_8", "roll_mean_move_13", "roll_std_move_4", "roll_mean_price_4")
reference_price_median = _feature_query("series_reference_price")
decision_cost = _feature_query("decision_time_unit_cost")
series_age = _feature_query("series_age_weeks")
price_features = _feature_query("log_price", "price_vs_lag", "price_vs_reference", "price_vs_roll_mean")


def appended_features(spark, d):
    """Features of the last four weeks, two of them appended at a time to the tables of the weeks before."""
    panel = _stored_panel(spark, d)
    last = panel.agg(F.max("week")).first()[0]
    folder = shared_path(spark, "store")
    store = incremental.FeatureStore(spark, "store_" + folder.rsplit("-", 1)[1], folder, config=CONFIG)
    store.start(panel.where(F.col("week") <= last - 4))
    for first in (last - 3, last - 1):
        store.append(panel.where(F.col("week").between(first, first + 1)))
    found = spark.read.parquet(f"{folder}/features").where(F.col("week") > last - 4)
    store.drop()
    cols = ["lag_move_1", "lag_move_4", "lag_price_2", "roll_mean_move_4", "roll_mean_move_13", "roll_std_move_4", "roll_mean_price_4", "series_reference_price", "decision_time_unit_cost", "series_age_weeks", "price_vs_reference"]
    return _rounded(found.select(*(F.col(k).cast("long").alias(k) for k in KEYS), *cols))


def temporal_split_counts(spark, d):
    by = features.with_split(_panel(spark, d), CONFIG).groupBy("split")
    return _rounded(by.agg(F.count("*").alias("n_rows"), F.min("week").alias("first_week"), F.max("week").alias("last_week")))


def _arcs(spark, d):
    pairs = features.arc_pairs(_panel(spark, d))
    arc = arc_elasticity(F.col("prev_price"), F.col("prev_move"), F.col("effective_unit_price"), F.col("move"))
    return pairs.withColumn("arc", arc).where("arc is not null")


def arc_pairs(spark, d):
    return _rounded(_arcs(spark, d).select(*KEYS, "arc"))


def arc_summary(spark, d):
    """Quartiles of the arcs, their mean between the first and the last percentile, and the share below zero."""
    rows = _arcs(spark, d).select(F.lit("all").alias("g"), "arc")
    cuts = quantiles(rows, "g", "arc", {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99})
    held = rows.join(F.broadcast(cuts), "g")
    trimmed = F.avg(F.when(F.col("arc").between(F.col("p01"), F.col("p99")), F.col("arc")))
    one = held.agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("p25", "median", "p75")), trimmed.alias("trimmed_mean"), F.avg((F.col("arc") < 0).cast("int")).alias("share_negative"))
    return _rounded(one)


def price_change_events(spark, d):
    change = price_change(F.col("effective_unit_price"), F.col("prev_price"))
    pairs = features.arc_pairs(_panel(spark, d)).where("prev_price > 0").withColumn("c", change)
    by = pairs.groupBy("upc").agg(
        F.count("*").alias("n_pairs"), F.count_if(F.abs("c") > 1e-9).alias("n_changes"), F.count_if(F.abs("c") > 0.5).alias("n_jumps"),
        F.avg(F.when(F.col("c") < 0, F.col("move") / F.nullif("prev_move", F.lit(0.0)) - 1)).alias("units_after_cut"),
    )
    return _rounded(by)


def episodes(spark, d):
    return _rounded(features.price_episodes(_panel(spark, d)).select(*KEYS, "prev_price", "effective_unit_price", "prev_move", "move", "change"))


def history_stats_pit(spark, d):
    found = series.history_stats(_panel(spark, d))
    # means of cents often end on a half at six places, so these keep ten
    exact = [F.round("hist_mean", 10).alias("hist_mean"), *(r6(F.col(c)).alias(c) for c in ("hist_std", "hist_min", "hist_max"))]
    return found.select(*KEYS, "hist_n_obs", "hist_n_prices", *exact)


def loglog_pooled(spark, d):
    by = regression.loglog(_panel(spark, d)).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared"))
    return _rounded(by)


def _within(spark, d, keys):
    return regression.within(regression.loglog(_panel(spark, d)), ["x", "y"], keys)


def loglog_upc_fe(spark, d):
    return _rounded(regression.within_slope(regression.loglog(_panel(spark, d)), ["upc"]))


def loglog_upc_store_fe(spark, d):
    return _rounded(regression.within_slope(regression.loglog(_panel(spark, d)), ["upc", "store"]))


def elasticity_by_upc(spark, d):
    return _rounded(regression.slopes(_within(spark, d, ["upc", "store"]), "upc"))


def error_ratios(spark, d):
    """By product: clustered errors of its slope within series beside the robust one."""
    return _rounded(elasticity.error_ratios(regression.slopes(_within(spark, d, ["upc", "store"]), "upc")))


def error_summary(spark, d):
    return _rounded(elasticity.error_summary(elasticity.error_ratios(regression.slopes(_within(spark, d, ["upc", "store"]), "upc"))))


def error_summary_controlled(spark, d):
    """The same of the slopes beside the controls that the elasticity table uses, from the training weeks."""
    return _rounded(elasticity.error_summary(elasticity.error_ratios(elasticity.product_estimates(_train(spark, d), CONFIG))))


def _elasticities(spark, d):
    """Shrunk elasticities of all weeks, around the pooled slope within series. The rows are kept while the slopes are
    made; these are stored, one row a product."""
    rows = _within(spark, d, ["upc", "store"]).select("upc", "store", "week", "x", "y").persist()
    try:
        pooled = rows.agg(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).first()[0]
        return regression.shrunk(keep(regression.slopes(rows, "upc"), "slopes").rows, pooled)
    finally:
        rows.unpersist()


def shrinkage_weights(spark, d):
    return _rounded(_elasticities(spark, d).select("upc", "estimate", "std_error", "usable", "shrinkage_weight", "elasticity_shrunk", "elasticity_final", "elasticity_source", "clipped"))


def robust_inference(spark, d):
    """The pooled slope within series with classical, robust, one-way and two-way clustered errors and t intervals."""
    rows = _within(spark, d, ["upc", "store"])
    fit = regression.Fit(rows, "y", ["x"], absorbed=rows.select("upc", "store").distinct().count())
    frame = elasticity.inference(fit, {"upc": ["upc"], "week": ["week"]}, ("upc", "week"))
    kinds = "fit string, term string, estimate double, std_error double, n long, r_squared double, ci_low double, ci_high double, t_stat double, ratio_to_classical double"
    return spark.createDataFrame([tuple(r) for r in frame.itertuples(index=False)], kinds)  # one row an assumption


def _train(spark, d, panel: DataFrame | None = None):
    """Rows of the training weeks of a stored panel, by default made here."""
    return features.with_split(_stored_panel(spark, d) if panel is None else panel, CONFIG).where("split = 'train'")


def elasticity_table(spark, d):
    cols = ["n_obs", "n_distinct_prices", "n_stores", "n_weeks", "price_cv", "price_min", "price_max", "estimate", "std_error", "std_error_hc1", "std_error_store", "std_error_week", "se_inflation_vs_hc1",
            "t_stat", "ci_low", "ci_high", "r_squared", "significant_negative", "usable", "reject_reason", "shrinkage_weight", "elasticity_shrunk", "elasticity_final", "elasticity_source", "clipped"]
    return _rounded(elasticity.elasticity_table(_train(spark, d), CONFIG).products.select("upc", *cols))


def product_history(spark, d):
    """What the elasticity table knows of each product before any slope, and whether it is too little."""
    found = elasticity.product_estimates(_train(spark, d), CONFIG)
    few = F.col("reject_reason") == "insufficient_observations_or_price_variation"
    return _rounded(found.select("upc", "n_obs", "n_distinct_prices", "n_stores", "n_weeks", "price_cv", "price_min", "price_max", few.alias("too_little")))


def shrinkage_variants(spark, d):
    found = elasticity.product_estimates(_train(spark, d), CONFIG)
    return _rounded(elasticity.shrinkage_variants(found, -2.0))


def shrinkage_bands(spark, d):
    return elasticity.weight_bands(elasticity.elasticity_table(_train(spark, d), CONFIG).products)


def elasticity_with_controls(spark, d):
    """Product slopes with trend and season beside the price."""
    rows = features.with_seasonality(regression.loglog(_panel(spark, d)))
    rows = regression.within(rows, ["x", "y", "trend", "sin_week", "cos_week"], ["upc", "store"])
    return _rounded(regression.slope_by_group(rows, "upc", ["x", "trend", "sin_week", "cos_week"]))


def _forecasts(spark, d):
    rows = features.training_rows(features.with_split(_features(spark, d), CONFIG))
    return models.with_baselines(rows, rows.where("split = 'train'")).where("split = 'test'")


def forecast_metrics(spark, d):
    return _rounded(models.evaluate(models.long_forecasts(_forecasts(spark, d)), ["model"]))


def metrics_by_segment(spark, d):
    rows = models.long_forecasts(_forecasts(spark, d)).where("model = 'rolling_mean_4'")
    return _rounded(models.evaluate(rows, ["store"]))


def performance_by_quarter(spark, d):
    rows = _forecasts(spark, d).select("year", "quarter", F.col("move").alias("actual"), F.col("pred_rolling_mean_4").alias("predicted"))
    return _rounded(monitoring.performance(rows))


_DRIFT = ["move", "effective_unit_price", "roll_mean_move_4"]


def _periods(spark, d):
    rows = features.with_split(_features(spark, d), CONFIG)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def psi_by_feature(spark, d):
    return _rounded(monitoring.psi(*_periods(spark, d), _DRIFT))


def ks_statistic(spark, d):
    return _rounded(monitoring.ks(*_periods(spark, d), _DRIFT))


def alerts(spark, d):
    return _rounded(monitoring.alerts(monitoring.psi(*_periods(spark, d), _DRIFT), performance_by_quarter(spark, d)))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the last week: its rows with statistics of all weeks, at a fixed elasticity of -2."""
    rows = series.with_series_stats(_features(spark, d))
    last = rows.agg(F.max("week").alias("__last"))
    return rows.join(F.broadcast(last), F.col("week") == F.col("__last")).select(
        *KEYS, F.col("effective_unit_price").alias("current_price"), F.col("decision_time_unit_cost").alias("unit_cost"),
        F.coalesce("roll_mean_move_4", "lag_move_1", F.lit(0.0)).alias("base_units"), F.lit(-2.0).alias("elasticity"), F.lit("fixed").alias("elasticity_source"),
        "n_obs", "n_distinct_prices", "price_cv", "price_min", "price_max",
    )


def recommendations_estimated(spark, d):
    """The decisions of the last week on the shrunk elasticities of the training weeks."""
    table = elasticity.elasticity_table(_train(spark, d), CONFIG)
    found = decisions.recommend(table.attach(contexts(spark, d)), "standard", CONFIG)
    cols = ["elasticity", "elasticity_source", "decision", "risk_level", "current_price", "proposed_price", "recommended_price", "n_candidates", "units_proposed", "profit_proposed", "realisable_uplift"]
    return _rounded(found.select(*KEYS, *cols, F.array_join("reason_codes", "|").alias("reason_codes")))


def promotion_risk(spark, d):
    """Risk of the contexts where the share of promoted weeks counts too."""
    share = _panel(spark, d).groupBy("upc", "store").agg(F.avg("recorded_promotion_flag").alias("promotion_share"))
    rows = contexts(spark, d).join(share, ["upc", "store"], "left")
    return rows.groupBy(decisions.risk_level(F.col("current_price"), CONFIG, F.col("promotion_share")).alias("risk_level"), (F.col("promotion_share") > 0.5).alias("promoted")).agg(F.count("*").alias("n"))


def _modelled(spark, d, panel: DataFrame):
    """(a ridge of the training weeks, the rows of the last week with statistics of their series), from a stored panel."""
    rows = _model_rows(spark, d, series.with_series_stats(_stored_features(panel)))
    model = models.DemandModel("ridge").fit(rows.where("split = 'train'"))
    last = rows.agg(F.max("week").alias("__last"))
    return model, rows.join(F.broadcast(last), F.col("week") == F.col("__last")).drop("__last")


def _responses(spark, d):
    panel = _stored_panel(spark, d)
    model, last = _modelled(spark, d, panel)
    table = elasticity.elasticity_table(_train(spark, d, panel), CONFIG)
    return {m: response.PriceResponse(model, m, None if m == "ml" else table).recommend(last, "standard", CONFIG) for m in ("ml", "pooled", "shrunk")}


def method_comparison(spark, d):
    return _rounded(response.disagreement(_responses(spark, d)))


def method_decisions(spark, d):
    return _rounded(response.by_method(_responses(spark, d)))


def hybrid_demand(spark, d):
    """Units of the last week's rows at a price a tenth higher: the model's level times the shrunk response."""
    panel = _stored_panel(spark, d)
    model, last = _modelled(spark, d, panel)
    own = response.PriceResponse(model, "shrunk", elasticity.elasticity_table(_train(spark, d, panel), CONFIG))
    raised = response.with_reference_price(last).withColumn("effective_unit_price", F.col("effective_unit_price") * 1.1)
    return _rounded(own.predict(raised).select(*KEYS, "reference_price", F.col("effective_unit_price").alias("price"), "predicted"))


def price_response_sweep(spark, d):
    return _rounded(response.sweep(contexts(spark, d)).select(*KEYS, "profit_optimum", "revenue_optimum", "monotone", "low_outside", "high_outside", "local_elasticity"))


def sweep_summary(spark, d):
    return _rounded(response.sweep_summary(response.sweep(contexts(spark, d))))


def guardrail_bounds(spark, d):
    policy = CONFIG.policy("standard")
    found = decisions.with_bounds(contexts(spark, d), policy, F.lit(policy["max_price_change_pct"]))
    return _rounded(found.select(*KEYS, "low", "high", F.array_join("binding", "|").alias("binding")))


def _simulated(spark, d):
    policy = CONFIG.policy("standard")
    found = decisions.with_bounds(contexts(spark, d), policy, F.lit(policy["max_price_change_pct"]))
    grid = decisions.price_grid(F.col("low"), F.col("high"), F.col("current_price"), 0.05, 0.01)
    return decisions.simulate(found.withColumn("grid", grid), "gross_profit")


def simulate_grid(spark, d):
    rows = _simulated(spark, d).select(*KEYS, F.explode("candidates").alias("c"))
    return _rounded(rows.select(*KEYS, F.col("c.price").alias("price"), F.col("c.units").alias("units"), F.col("c.value").alias("profit")))


def price_grid(spark, d):
    return _rounded(_simulated(spark, d).select(*KEYS, F.size("grid").alias("n_prices"), F.array_min("grid").alias("lowest"), F.array_max("grid").alias("highest")).withColumn("n_prices", F.greatest("n_prices", F.lit(0))))


def curve_diagnostics(spark, d):
    return _rounded(decisions.curve_diagnostics(_simulated(spark, d)).select(*KEYS, F.greatest(F.size("candidates"), F.lit(0)).alias("n_candidates"), "share_rising", "monotone", "relative_span", "flat"))


def risk_levels(spark, d):
    return contexts(spark, d).select(*KEYS, decisions.risk_level(F.col("current_price"), CONFIG).alias("risk_level"))


def _recommended(spark, d):
    return decisions.recommend(contexts(spark, d), "standard", CONFIG)


def recommendations(spark, d):
    cols = ["decision", "risk_level", "current_price", "proposed_price", "recommended_price", "n_candidates", "units_current", "units_proposed", "profit_current", "profit_proposed", "realisable_uplift"]
    return _rounded(_recommended(spark, d).select(*KEYS, *cols, F.array_join("reason_codes", "|").alias("reason_codes")))


def decision_mix(spark, d):
    return service.compare_policies(contexts(spark, d), CONFIG).groupBy(F.col("policy_profile").alias("profile"), "decision", "risk_level").agg(F.count("*").alias("n"))


def policy_comparison(spark, d):
    """Every context of the last week under every profile."""
    found = service.compare_policies(contexts(spark, d), CONFIG)
    return _rounded(found.withColumn("reason_codes", F.array_join("reason_codes", "|")))


def model_info(spark, d):
    """What is served on the fixed elasticity of the decision queries."""
    return _rounded(service.model_info(contexts(spark, d), "fixed", "1", elasticity.fixed(-2.0)))


def decision_records(spark, d):
    """The decisions of the last week under two profiles with what made them."""
    rows = contexts(spark, d).withColumn("asked", F.when(F.col("store") % 2 == 0, "aggressive").otherwise("conservative"))
    found = decisions.with_provenance(decisions.recommend(rows, F.col("asked"), CONFIG), "fixed", "1", CONFIG, F.col("asked"))
    return _rounded(found.select(*KEYS, "decision", "risk_level", "recommended_price", "policy_profile", "objective", "price_response_method", "model_version"))


def product_requests(spark, d):
    """A request for each part, by the code of its brand (some wrong, some missing) or a beginning of its name, against the
    products that each store serves in the last week."""
    served = contexts(spark, d).select("store", "upc", F.concat(F.lit("Brand#"), F.col("upc").cast("string")).alias("descrip"))
    part, key = spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey")
    code = F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("long") + F.when(key % 3 == 0, 100).otherwise(0)
    asked = part.select(
        key.cast("long").alias("request"), (F.col("p_size") % 30).cast("long").alias("store"), F.when(key % 4 != 0, code).alias("upc"),
        F.when(key % 5 != 0, F.lower(F.substr("p_brand", F.lit(1), (6 + key % 3).cast("int")))).alias("product"),
    )
    return service.resolved(asked, served)


def reason_code_counts(spark, d):
    return _recommended(spark, d).select(F.explode("reason_codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def _variants(spark, d):
    return attribution.variants(contexts(spark, d), "standard", CONFIG)


def constraint_attribution(spark, d):
    changed = F.abs(F.col("proposed_price") - F.col("baseline.proposed_price")) > 1e-9
    return _rounded(_variants(spark, d).groupBy("left_out").agg(F.count("*").alias("n"), F.count_if(changed).alias("n_changed"), F.avg("proposed_price").alias("mean_price")))


def constraint_intervals(spark, d):
    cost = F.when(F.col("unit_cost") > 0, F.col("unit_cost"))
    return _rounded(attribution.constraint_intervals(contexts(spark, d).withColumn("unit_cost", cost), CONFIG.policy("standard")))


def attribution_table(spark, d):
    return _rounded(attribution.constraint_table(attribution.by_constraint(_variants(spark, d), "standard", CONFIG)))


def attribution_contexts(spark, d):
    return _rounded(attribution.by_context(_variants(spark, d), "standard", CONFIG))


def determinants(spark, d):
    return attribution.by_context(_variants(spark, d), "standard", CONFIG).groupBy("determinant", "first_binding").agg(F.count("*").alias("n"))


def rule_policies(spark, d):
    base = contexts(spark, d)
    margins = _panel(spark, d).groupBy("upc", "store").agg(F.percentile("gross_margin_rate", F.lit(0.5)).alias("median_margin"), F.mode(F.round("effective_unit_price", 2), True).alias("modal_price"))
    base = base.join(margins, ["upc", "store"], "left")
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), target.cast("double").alias("target")) for name, target in policies.rule_targets().items()))
    rows = base.withColumn("__r", F.explode(rules)).select(*base.columns, "__r.*")
    found = decisions.recommend(rows, "standard", CONFIG, target=F.col("target"))
    return _rounded(found.groupBy("rule", "decision").agg(F.count("*").alias("n"), F.sum("profit_proposed").alias("profit")))


def policy_totals(spark, d):
    rows = _recommended(spark, d).where("unit_cost is not null")
    return _rounded(policies.totals(policies.scored(policies.policy_prices(rows, CONFIG.policy("standard")))))


def _backtest_contexts(found: DataFrame, weeks=10):
    """Each of the last weeks of a table of features as it stood before: the price before, statistics of earlier rows."""
    rows = series.history_stats(found)
    last = rows.agg(F.max("week").alias("__last"))
    rows = rows.join(F.broadcast(last), F.col("week") > F.col("__last") - weeks)
    return rows.where("lag_price_1 is not null").select(
        *KEYS, F.col("lag_price_1").alias("current_price"), F.col("decision_time_unit_cost").alias("unit_cost"), F.coalesce("roll_mean_move_4", "lag_move_1", F.lit(0.0)).alias("base_units"),
        F.lit(-2.0).alias("elasticity"), F.lit("fixed").alias("elasticity_source"), F.col("hist_n_obs").alias("n_obs"), F.col("hist_n_prices").alias("n_distinct_prices"),
        (F.col("hist_std") / F.nullif("hist_mean", F.lit(0.0))).alias("price_cv"), F.col("hist_min").alias("price_min"), F.col("hist_max").alias("price_max"),
    )


def policy_backtest(spark, d):
    """Each of the last ten weeks decided with what was known before it, scored by policy."""
    found = decisions.recommend(_backtest_contexts(_features(spark, d)), "standard", CONFIG).where("unit_cost is not null")
    return _rounded(policies.totals(policies.scored(policies.policy_prices(found, CONFIG.policy("standard")))))


def elasticities_as_of(spark, d):
    """The elasticity tables of what was known before each of the last ten weeks."""
    panel = _stored_panel(spark, d)
    cols = ["n_obs", "n_distinct_prices", "n_stores", "n_weeks", "price_cv", "estimate", "std_error", "usable", "reject_reason", "shrinkage_weight", "elasticity_final", "elasticity_source", "pooled"]
    return _rounded(walk_forward.tables_as_of(panel, walk_forward.last_weeks(panel, 10), CONFIG).select("as_of", "upc", *cols))


def _walked(spark, d):
    """(decisions of the last ten weeks on the response as of each week, at demand by a model of the training weeks, rows
    of those weeks with the model's forecast)."""
    panel = _stored_panel(spark, d)
    seen = _stored_features(panel)
    rows = _model_rows(spark, d, seen)
    model = models.DemandModel("ridge").fit(rows.where("split = 'train'"))
    weeks = walk_forward.last_weeks(rows.where("split = 'test'"), 10)
    tested = model.predict(rows.where(F.col("week").isin(weeks)))
    level = model.predict(tested.drop("predicted").withColumns(features.price_features(F.col("lag_price_1"))), "base_units")
    stood = _backtest_contexts(seen).drop("base_units", "elasticity", "elasticity_source").join(level.select(*KEYS, "base_units"), KEYS)
    tables = walk_forward.tables_as_of(panel, weeks, CONFIG)
    found = decisions.recommend(walk_forward.attach_as_of(stood, tables, CONFIG), "standard", CONFIG).where("unit_cost is not null")
    return found, tested


def walk_forward_backtest(spark, d):
    """Each of the last ten weeks decided on the response and the history known before it, by policy, beside how well the
    model foresaw the week."""
    found, tested = _walked(spark, d)
    scores = walk_forward.weekly_scores(policies.scored(policies.policy_prices(found, CONFIG.policy("standard"))))
    accuracy = models.evaluate(tested.select("week", F.col("move").alias("actual"), "predicted"), ["week"]).select("week", "wape", "bias")
    return _rounded(scores.join(accuracy, "week"))


def optimal_prices(spark, d):
    rows = contexts(spark, d).where("unit_cost > 0")
    return _rounded(rows.select(*KEYS, best_price(F.col("unit_cost"), F.col("elasticity")).alias("best_price")))


def value_scenarios(spark, d):
    return _rounded(commercial.value_scenarios(_recommended(spark, d), {"low": 0.25, "middle": 0.5, "high": 1.0}))


def modal_price(spark, d):
    return _rounded(_panel(spark, d).groupBy("upc").agg(F.mode(F.round("effective_unit_price", 2), True).alias("modal_price"), F.percentile("gross_margin_rate", F.lit(0.5)).alias("median_margin")))


def latest_state(spark, d):
    newest = Window.partitionBy("upc", "store").orderBy(F.desc("week"))
    rows = _panel(spark, d).withColumn("n", F.row_number().over(newest)).where("n = 1")
    return _rounded(rows.select(*KEYS, "move", "effective_unit_price"))


def review_queue(spark, d):
    log = audit.log_rows(_recommended(spark, d), "2000-01-01T00:00:00Z")
    moved = log.where("decision = 'RECOMMEND_CHANGE'").select("rec_id", F.lit("2000-01-02T00:00:00Z").alias("transitioned_at_utc"), F.lit("REVIEWED").alias("to_state"))
    done = log.where("decision = 'KEEP_CURRENT'").select("rec_id", F.lit("2000-01-03T00:00:00Z").alias("transitioned_at_utc"), F.lit("REJECTED").alias("to_state"))
    return audit.review_queue(log, moved.unionByName(done)).groupBy("state", "decision").agg(F.count("*").alias("n"))


def eligibility_funnel(spark, d):
    rows = features.with_split(_features(spark, d), CONFIG)
    modelling = features.training_rows(rows)
    return studies.funnel(rows, modelling, modelling.where("split = 'train'"), CONFIG)


def episode_scores(spark, d):
    rows = features.price_episodes(_features(spark, d).withColumn("baseline", F.coalesce("roll_mean_move_4", "lag_move_1")))
    return _rounded(studies.score_episodes(rows, {"null": F.lit(0.0), "fixed": F.lit(-2.0), "unit": F.lit(-1.0)}))


def episode_rank_correlation(spark, d):
    rows = features.price_episodes(_panel(spark, d)).withColumn("response", F.log(F.col("move") / F.col("prev_move")))
    return _rounded(studies.spearman(rows.select("change", "response"), "change", "response"))


def excluded_positions(spark, d):
    return studies.positions(_movement(spark, d), F.col("ok") == 0)


def elasticity_windows(spark, d):
    rows = regression.loglog(_panel(spark, d))
    return _rounded(studies.window_slopes(rows, studies.stable_windows(rows)))


def elasticity_stability(spark, d):
    return _rounded(studies.stability(elasticity_windows(spark, d)))


def elasticity_all_windows(spark, d):
    return _rounded(studies.in_all_windows(elasticity_windows(spark, d)))


def _banded(spark, d):
    """Forecasts of the test weeks with the risk band that was known before each week."""
    rows = series.history_stats(features.training_rows(features.with_split(_features(spark, d), CONFIG))).where("split = 'test'")
    rows = rows.select(
        *KEYS, F.col("move").alias("actual"), F.coalesce("roll_mean_move_4", "lag_move_1").alias("predicted"), F.col("hist_n_obs").alias("n_obs"), F.col("hist_n_prices").alias("n_distinct_prices"),
        F.col("hist_min").alias("price_min"), F.col("hist_max").alias("price_max"), F.lit("fixed").alias("elasticity_source"), "effective_unit_price",
    )
    return rows.withColumn("risk_level", decisions.risk_level(F.col("effective_unit_price"), CONFIG))


def risk_bootstrap(spark, d):
    return _rounded(studies.bootstrap_bands(_banded(spark, d)))


def risk_factors(spark, d):
    """Forecast errors by risk band and by what makes it."""
    rows = _banded(spark, d)
    inside = F.col("effective_unit_price").between(F.col("price_min"), F.col("price_max"))
    history = F.when(F.col("n_obs") >= 150, "long").when(F.col("n_obs") >= 80, "middle").otherwise("short")
    prices = F.when(F.col("n_distinct_prices") >= 15, "many").when(F.col("n_distinct_prices") >= 8, "some").otherwise("few")
    factors = {"risk_level": F.col("risk_level"), "history": history, "prices": prices, "inside_support": F.coalesce(inside, F.lit(False))}
    return _rounded(studies.band_metrics(rows, factors))


def log_documents(spark, d):
    """The recommendation log as JSON documents and back."""
    log = audit.log_rows(_recommended(spark, d), "2000-01-01T00:00:00Z")
    back = audit.from_documents(audit.as_documents(log.select("rec_id", "upc", "store", "week", "decision", "recommended_price", "reason_codes")))
    joined = back.join(log.select("rec_id", *KEYS), "rec_id")
    return _rounded(joined.select(*KEYS, "decision", "recommended_price", F.array_join("codes", "|").alias("reason_codes")))


def guardrail_ablation(spark, d):
    return _rounded(studies.guardrail_layers(contexts(spark, d), CONFIG))


def elasticity_scenarios(spark, d):
    return _rounded(studies.scenarios(contexts(spark, d), CONFIG))


def recommendation_stability(spark, d):
    return _rounded(studies.week_to_week(decisions.recommend(_backtest_contexts(_features(spark, d)), "standard", CONFIG)))


def sampled_contexts(spark, d):
    return _rounded(studies.seeded_sample(contexts(spark, d), KEYS, 50))


def serving_slice(spark, d):
    return _rounded(service.serving_slice(_features(spark, d)).select(*KEYS, "effective_unit_price", "lag_price_1"))


def portfolio_summary(spark, d):
    return _rounded(service.portfolio(_recommended(spark, d)))


def explained_codes(spark, d):
    return service.explained(_recommended(spark, d)).groupBy("code", "explanation").agg(F.count("*").alias("n"))


def _model_rows(spark, d, found: DataFrame | None = None):
    """Rows of a stored table of features (by default made here) that a model can learn from or be held against, with their split."""
    found = _stored_features(_stored_panel(spark, d)) if found is None else found
    return features.with_seasonality(features.training_rows(features.with_split(found, CONFIG)))


#: Trees of the queries: fewer and faster ones than the 400 that a model has by default.
_BOOSTING = {"rounds": 10, "rate": 0.25, "leaves": 15}


def boosted_metrics(spark, d):
    """Poisson trees beside the ridge over the validation weeks; chosen marks the one with the least WAPE."""
    rows = _model_rows(spark, d)
    train = rows.where("split = 'train'")
    fitted = {"boosted": models.DemandModel("boosted", boosting=_BOOSTING).fit(train), "ridge": models.DemandModel("ridge").fit(train)}
    found = models.scored_by(fitted, rows.where("split = 'valid'"))
    return _rounded(found.withColumn("chosen", F.col("model") == models.selected(found)))


def model_metrics(spark, d):
    """Both model families, fitted on the training weeks and held against the validation and test weeks."""
    rows = _model_rows(spark, d)
    train, rest = rows.where("split = 'train'"), rows.where("split <> 'train'")
    out = None
    for family in ("ridge", "poisson"):
        found = models.DemandModel(family).fit(train).predict(rest).select(F.lit(family).alias("model"), "split", F.col("move").alias("actual"), "predicted")
        one = models.evaluate(found, ["model", "split"])
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


def implied_elasticity(spark, d):
    """The ridge's own price response by central differences of two per cent, over the test weeks."""
    rows = _model_rows(spark, d)
    model, step = models.DemandModel("ridge").fit(rows.where("split = 'train'")), 0.02
    at = lambda f, name: lambda df: model.predict(df.withColumns(features.price_features(F.col("effective_unit_price") * f)), name)
    both = rows.where("split = 'test'").transform(at(1 + step, "up")).transform(at(1 - step, "down"))
    value = (F.log(F.col("up") + 1e-9) - F.log(F.col("down") + 1e-9)) / (F.log(F.lit(1 + step)) - F.log(F.lit(1 - step)))
    q = lambda x: F.percentile("e", F.lit(x))
    return _rounded(both.withColumn("e", value).agg(F.count("e").alias("n"), q(0.1).alias("p10"), q(0.5).alias("median"), q(0.9).alias("p90"), F.avg((F.col("e") < 0).cast("int")).alias("share_negative")))


def synthetic_recovery(spark, d):
    """Known elasticities, planted into the panel, against those found again in it."""
    panel = planted.planted(_panel(spark, d))
    fits = regression.slopes(regression.within(regression.loglog(panel), ["x", "y"], ["upc", "store"]), "upc")
    return _rounded(fits.join(planted.truth(panel), "upc").select("upc", "true_elasticity", "estimate", "std_error"))


def ground_truth_study(spark, d):
    """How far confounding misleads the elasticity table: the training weeks with known elasticities planted into them."""
    train, out = keep(_train(spark, d), "train").rows, None
    for name, settings in planted.SCENARIOS.items():
        panel = planted.planted(train, **settings)
        table = elasticity.elasticity_table(panel, Config({"elasticity": {"min_obs_per_upc": 50}}))
        one = studies.recovered(panel, table, planted.truth(panel)).select(F.lit(name).alias("scenario"), "*")
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


def model_selection(spark, d):
    """Metrics of both families over the validation weeks; chosen marks the one with the least WAPE."""
    rows = _model_rows(spark, d)
    fitted = {family: models.DemandModel(family).fit(rows.where("split = 'train'")) for family in ("ridge", "poisson")}
    found = models.scored_by(fitted, rows.where("split = 'valid'"))
    return _rounded(found.withColumn("chosen", F.col("model") == models.selected(found)))


def refitted_baselines(spark, d):
    """Baselines of the test weeks where series means come from training and validation weeks."""
    rows = features.training_rows(features.with_split(_features(spark, d), CONFIG))
    found = models.with_baselines(rows, rows.where("split <> 'test'")).where("split = 'test'")
    return _rounded(models.evaluate(models.long_forecasts(found), ["model"]))


def demand_prior(spark, d):
    return _rounded(models.demand_prior(_train(spark, d)))


def raw_audit(spark, d):
    return cleaning.raw_audit(_movement(spark, d))


def feature_drift(spark, d):
    found = monitoring.feature_drift(*_periods(spark, d), _DRIFT, CONFIG)
    return _rounded(found.withColumn("drift_rank", F.col("drift_rank").cast("long")))


def prediction_drift(spark, d):
    """Forecasts of the test weeks against those of the training weeks."""
    rows = features.training_rows(features.with_split(_features(spark, d), CONFIG)).withColumn("predicted", F.greatest(F.coalesce("roll_mean_move_4", "lag_move_1"), F.lit(0.0)))
    found = monitoring.prediction_drift(rows.where("split = 'train'"), rows.where("split = 'test'"), "predicted", CONFIG)
    return _rounded(found.drop("drift_rank"))


def schema_checks(spark, d):
    expected = {"upc": "bigint", "store": "bigint", "week": "bigint", "move": "double", "effective_unit_price": "double", "package": "double"}
    return _rounded(monitoring.schema_check(_panel(spark, d), expected))


def strict_alerts(spark, d):
    """Alerts at thresholds low enough that some fire."""
    strict = Config({"data": {"week1_start_date": "1995-01-02"}, "monitoring": {"alerts": {"psi_alert": 0.01, "wape_alert": 0.2, "bias_abs_alert": 1.0}}})
    return _rounded(monitoring.alerts(monitoring.psi(*_periods(spark, d), _DRIFT), performance_by_quarter(spark, d), strict))


def worst_stores(spark, d):
    return metrics_by_segment(spark, d).select("store", "n", "wape").orderBy(F.desc("wape"), "store").limit(10)


def top_products(spark, d):
    by = _panel(spark, d).groupBy("upc").agg(F.sum("revenue").alias("revenue"), F.sum("move").alias("units"))
    return _rounded(by.orderBy(F.desc("revenue"), "upc").limit(10))


def decision_crosstab(spark, d):
    kinds = ["KEEP_CURRENT", "RECOMMEND_CHANGE", "REVIEW_REQUIRED"]
    return _recommended(spark, d).groupBy("risk_level").pivot("decision", kinds).count().fillna(0)


def reason_code_flags(spark, d):
    """Every context with each reason code there is as a flag."""
    rows = _recommended(spark, d)
    return rows.select(*KEYS, *(F.array_contains("reason_codes", c).cast("long").alias(c) for c in service.EXPLANATIONS))


def log_generations(spark, d):
    """A log of three schemas, one of them without identifiers, read as one table with the state of each row."""
    rows, folder = _recommended(spark, d), shared_path(spark, "log")
    rec_id, part = F.concat_ws("-", *KEYS), F.col("upc") % 3
    append_log(rows.where(part == 0).select(*KEYS, "decision"), folder)
    append_log(rows.where(part == 1).select(rec_id.alias("rec_id"), *KEYS, "decision", F.col("n_candidates").cast("int").alias("n_candidates")), folder)
    append_log(rows.where(part == 2).select(rec_id.alias("rec_id"), *KEYS, "decision", (F.col("n_candidates") / 2).alias("n_candidates"), "recommended_price"), folder)
    log = read_log(spark, folder)
    moved = log.where("rec_id is not null and store % 2 = 0").select("rec_id", F.lit("2000-01-02T00:00:00Z").alias("transitioned_at_utc"), F.lit("REVIEWED").alias("to_state"))
    return _rounded(audit.current_state(log, moved).select(*KEYS, "decision", "n_candidates", "recommended_price", "state"))


def tiled_decisions(spark, d):
    """The decisions of the contexts twenty times over."""
    found = decisions.recommend(studies.tiled(contexts(spark, d), 20), "standard", CONFIG)
    return found.groupBy("decision").agg(F.count("*").alias("n"), F.countDistinct("store").alias("n_stores"))


def zero_price_audit(spark, d):
    """Rows without a positive price by product; the movement rows that are suspect stand for them here."""
    rows = _movement(spark, d).withColumn("price", F.when(F.col("ok") == 0, 0.0).otherwise(F.col("price")))
    return _rounded(studies.zero_prices(rows))


def _unpriced(spark, d):
    """Movement rows of which the suspect ones have no price: the sales tables have none of their own."""
    return _movement(spark, d).withColumn("price", F.when(F.col("ok") == 0, 0.0).otherwise(F.col("price")))


def zero_price_runs(spark, d):
    return zero_prices.runs(_unpriced(spark, d))


def zero_price_kinds(spark, d):
    return _rounded(zero_prices.by_kind(zero_prices.runs(_unpriced(spark, d))))


def zero_price_dimensions(spark, d):
    return _rounded(zero_prices.by_dimension(_unpriced(spark, d)))


def zero_price_spread(spark, d):
    return _rounded(zero_prices.spread(zero_prices.by_dimension(_unpriced(spark, d))))


def zero_price_selection(spark, d):
    return _rounded(zero_prices.selection(_unpriced(spark, d)))


def sketch_drift(spark, d):
    """Drift of the test weeks against the training weeks from weekly sketches, which are stored once."""
    rows = features.with_split(_features(spark, d), CONFIG)
    kept = keep(sketches.weekly(rows, _DRIFT), "sketches").rows
    weeks = {r["split"]: (r["a"], r["b"]) for r in rows.groupBy("split").agg(F.min("week").alias("a"), F.max("week").alias("b")).collect()}
    return _rounded(sketches.drift(kept, weeks["train"], weeks["test"], CONFIG))


def product_shares(spark, d):
    """Share of rows, units and promoted rows by product, with its description."""
    by = _panel(spark, d).groupBy("upc").agg(F.count("*").alias("n"), F.sum("move").alias("units"), F.avg("recorded_promotion_flag").alias("promotion_share"))
    total = by.agg(F.sum("n").alias("all_n"), F.sum("units").alias("all_units"))
    names = spark.read.parquet(f"{d}/part.parquet").select(F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("long").alias("upc"), F.col("p_brand").alias("descrip")).distinct()
    shares = by.crossJoin(F.broadcast(total)).join(names, "upc", "left")
    return _rounded(shares.select("upc", "descrip", (F.col("n") / F.col("all_n")).alias("row_share"), (F.col("units") / F.col("all_units")).alias("unit_share"), "promotion_share"))


def price_indices(spark, d):
    """Prices against the series' reference price."""
    rows = _features(spark, d)
    return _rounded(rows.select(*KEYS, price_index(F.col("effective_unit_price"), F.col("series_reference_price")).alias("price_index")))


def _priced_roles(spark, d):
    panel = _panel(spark, d)
    # a fixed value by product, so that SQL can follow; recommendations_estimated shows the estimated ones
    fixed = panel.select("upc").distinct().withColumn("elasticity", -(1.5 + F.col("upc") % 8 / 8.0))
    return commercial.priced_roles(panel, fixed)


def priced_roles(spark, d):
    return _rounded(_priced_roles(spark, d))


def role_summary(spark, d):
    return _rounded(commercial.role_summary(_recommended(spark, d), _priced_roles(spark, d)))


def traffic_cap(spark, d):
    return _rounded(commercial.traffic_cap(_recommended(spark, d), _priced_roles(spark, d), 0.02))


def cost_leakage(spark, d):
    return studies.cost_leakage(_panel(spark, d), lambda p: features.features(p, CONFIG))


def category_comparison(spark, d):
    """The headline of each group of products: size, prices, promotions, margins and the slope within series."""
    panel = _panel(spark, d).withColumn("category", F.floor(F.col("upc") / 10).cast("long"))
    p = F.col("effective_unit_price")
    by = panel.groupBy("category").agg(
        F.count("*").alias("n"), F.countDistinct("upc").alias("n_upcs"), F.sum("revenue").alias("revenue"), F.avg(p).alias("mean_price"), (F.stddev_samp(p) / F.avg(p)).alias("price_cv"),
        F.avg("recorded_promotion_flag").alias("promotion_share"), (F.sum("gross_profit") / F.sum("revenue")).alias("margin_rate"),
    )
    rows = regression.within(regression.loglog(panel), ["x", "y"], ["upc", "store"])
    slope = rows.groupBy("category").agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("slope"))
    return _rounded(by.join(slope, "category"))


def lifecycle_steps(spark, d):
    """Six transitions of each recommendation of the last week, some of them twice, out of order or illegal, and some of
    recommendations that the log lacks; the time is in hours."""
    log = contexts(spark, d).select(F.concat_ws("-", *KEYS).alias("rec_id"), *KEYS)
    k, states = F.col("k"), list(audit.TRANSITIONS)
    hour = (F.col("upc") * 11 + F.col("store") * 5 + k * 37) % 97
    to = F.element_at(F.array(*map(F.lit, states)), ((F.col("upc") * 7 + F.col("store") * 3 + k * k) % len(states) + 1).cast("int"))
    rows = log.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumns({"hour": hour, "to_state": to, "actor": F.concat(F.lit("a"), (k % 2).cast("string")), "note": F.lit(None).cast("string")})
    asked = rows.withColumns({"at": F.timestamp_seconds(F.col("hour") * 3600), "rec_id": F.when(F.col("upc") % 10 == 0, F.concat(F.lit("x"), "rec_id")).otherwise(F.col("rec_id"))})
    found = audit.fold_transitions(log, asked.unionByName(asked.where("k = 3")))
    return found.select("rec_id", (F.unix_seconds("at") / 3600).cast("long").alias("hour"), "from_state", "to_state", "actor", "accepted", "reason")


def late_outcomes(spark, d):
    """Forecasts of the test weeks as a stream of three waves, and the units sold as a second one of which each wave lacks its
    last weeks until the next: how well each week was foreseen, from the matches."""
    rows = features.training_rows(features.with_split(_features(spark, d), CONFIG)).where("split = 'test'")
    begins = F.to_timestamp(F.date_add(F.lit("1995-01-02").cast("date"), ((F.col("week") - 1) * 7).cast("int")))
    kept = keep(rows.select(*KEYS, begins.alias("decided_for"), F.greatest(F.coalesce("roll_mean_move_4", "lag_move_1"), F.lit(0.0)).alias("predicted"), "move"), "outcomes")
    weeks = kept.rows.agg(F.min("week"), F.max("week")).first()
    third = max(1, -(-(weeks[1] - weeks[0] + 1) // 3))
    wave = F.floor((F.col("week") - weeks[0]) / third)
    made, sold, out = (shared_path(spark, n) for n in ("made", "sold", "matched"))
    for i in range(3):
        kept.rows.where(wave == i).select(F.concat_ws("-", *KEYS).alias("rec_id"), *KEYS, "decided_for", "predicted").write.mode("append").parquet(made)
        later = F.floor((F.col("week") + 2 - weeks[0]) / third)
        sales = kept.rows.where(F.least(later, F.lit(2)) == i).select(*KEYS, (F.col("decided_for") + F.expr("INTERVAL 6 DAYS")).alias("sold_at"), "move")
        sales.write.mode("append").parquet(sold)
        read = lambda path: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        append_batches(outcomes.matched(read(made), read(sold), late="28 days"), out, f"{out}-state").awaitTermination()
    kept.drop()
    found = spark.read.parquet(out).where("actual is not null").select("week", "actual", "predicted")
    return _rounded(models.evaluate(found, ["week"]))


#: Limits of the admission query: requests of a client in a sliding hour, and of a day.
PER_CLIENT, PER_DAY = 2, 300


def admitted_events(spark, d):
    """Each event as a request of its user: whether the sliding hour and the day's cap admit it, and if not, which of them."""
    events = spark.read.parquet(f"{d}/events.parquet")
    found = admission.admissions(events, PER_CLIENT, PER_DAY, client="user_id", at="ts", key="event_id")
    return found.select(F.col("id").alias("event_id"), F.col("client").alias("user_id"), "admitted", "reason")


_NAMES = """panel_canonical exclusion_counts validation_checks table_fingerprint scale_summary numeric_profile promo_rollup weekly_rollup upc_concentration
product_roles store_dispersion price_variation_upc price_variation_series eligible_series lag_features rolling_features reference_price_median decision_cost
series_age price_features appended_features temporal_split_counts arc_pairs arc_summary price_change_events episodes history_stats_pit loglog_pooled loglog_upc_fe
loglog_upc_store_fe elasticity_by_upc shrinkage_weights error_ratios error_summary error_summary_controlled robust_inference elasticity_with_controls forecast_metrics metrics_by_segment performance_by_quarter
psi_by_feature ks_statistic alerts guardrail_bounds simulate_grid price_grid curve_diagnostics risk_levels recommendations decision_mix reason_code_counts
constraint_attribution constraint_intervals attribution_table attribution_contexts determinants rule_policies policy_totals policy_backtest elasticities_as_of walk_forward_backtest optimal_prices value_scenarios modal_price latest_state review_queue eligibility_funnel episode_scores
episode_rank_correlation excluded_positions elasticity_windows elasticity_stability risk_bootstrap guardrail_ablation elasticity_scenarios recommendation_stability
sampled_contexts serving_slice portfolio_summary explained_codes model_metrics implied_elasticity synthetic_recovery
elasticity_table product_history shrinkage_variants shrinkage_bands recommendations_estimated promotion_risk method_comparison method_decisions hybrid_demand price_response_sweep sweep_summary
ground_truth_study boosted_metrics model_selection refitted_baselines demand_prior raw_audit feature_drift prediction_drift schema_checks strict_alerts worst_stores top_products decision_crosstab reason_code_flags
tiled_decisions elasticity_all_windows risk_factors log_documents zero_price_audit zero_price_runs zero_price_kinds zero_price_dimensions zero_price_spread zero_price_selection sketch_drift product_shares price_indices priced_roles role_summary traffic_cap cost_leakage category_comparison policy_comparison model_info decision_records product_requests admitted_events lifecycle_steps late_outcomes log_generations""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
