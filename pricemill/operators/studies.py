"""Audits of the pipeline: the eligibility funnel, out-of-time price response, risk bands, stability over
windows, excluded weeks, guardrail layers and scenarios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.ranges import running_totals

from . import decisions, regression
from .features import series


def funnel(panel: DataFrame, modelling: DataFrame, train: DataFrame, config: Config) -> DataFrame:
    """(stage, n_upcs): distinct products left after each requirement of a product elasticity."""
    e = config["elasticity"]
    rows = regression.loglog(train)
    history = rows.groupBy("upc").agg(F.count("*").alias("n"), F.countDistinct("effective_unit_price").alias("k"))
    fits = regression.slopes(regression.within(rows, ["x", "y"], ["upc", "store"]), "upc")
    enough = history.where(F.col("n") >= e["min_obs_per_upc"])
    priced = enough.where(F.col("k") >= e["min_distinct_prices_per_upc"])
    estimated = fits.join(priced.select("upc"), "upc", "left_semi")
    negative = estimated.where("estimate < 0")
    stages = {
        "1_panel": panel, "2_modelling": modelling, "3_training": train, "4_positive_sales": rows, "5_enough_history": enough, "6_enough_prices": priced,
        "7_estimated": estimated, "8_right_sign": negative, "9_precise": negative.where(F.col("std_error") <= e["max_se_for_product_estimate"]),
    }
    out = None
    for name, df in stages.items():
        one = df.agg(F.countDistinct("upc").alias("n_upcs")).select(F.lit(name).alias("stage"), "n_upcs")
        out = one if out is None else out.unionByName(one)
    return out


def score_episodes(episodes: DataFrame, elasticities: dict[str, Column]) -> DataFrame:
    """(method, ...) metrics of predicted units after a price change: baseline * (new / old) ** elasticity.
    Episodes have baseline, prev_price, effective_unit_price and move; those without a baseline go."""
    rows = episodes.where("baseline > 0").withColumn("ratio", F.col("effective_unit_price") / F.col("prev_price"))
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("method"), (F.col("baseline") * F.pow("ratio", e)).alias("pred")) for k, e in elasticities.items())))
    rows = rows.withColumn("m", entries).select("*", "m.method", "m.pred").withColumns({
        "dev_pred": F.log(F.greatest(F.col("pred"), F.lit(1e-9)) / F.col("baseline")), "dev_obs": F.log(F.greatest(F.col("move"), F.lit(1e-9)) / F.col("baseline")),
    })
    moves = F.abs("dev_pred") > 1e-9
    return rows.groupBy("method").agg(
        F.count("*").alias("n"), (F.sum(F.abs(F.col("move") - F.col("pred"))) / F.nullif(F.sum(F.abs("move")), F.lit(0.0))).alias("wape"), F.avg(F.abs(F.col("move") - F.col("pred"))).alias("mae"),
        F.avg(F.col("pred") - F.col("move")).alias("bias"), F.avg(F.when(moves, (F.signum("dev_pred") == F.signum("dev_obs")).cast("int"))).alias("sign_accuracy"),
        F.percentile(F.abs(F.col("dev_pred") - F.col("dev_obs")), F.lit(0.5)).alias("median_log_error"),
    )


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the average rank of column among its values that are not null; values are counted first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    ranked = running_totals(counts, F.col(column), [F.col(column)], {"__upto": F.col("__n")})
    return df.join(ranked.select(column, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name)), column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the rank correlation of two columns."""
    both = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), a, "__ra"), b, "__rb")
    return both.agg(F.corr("__ra", "__rb").alias("spearman"))


def bootstrap_bands(rows: DataFrame, reps: int = 300, seed: int = 42) -> DataFrame:
    """(risk_level, wape, low, high): 95 % intervals by resampling series. rows: upc, store, risk_level, actual,
    predicted. Each repetition gives each series a Poisson weight of mean 1 from a keyed hash; rows are
    summed by series first, and only the sums of (band, repetition) meet."""
    by = rows.groupBy("upc", "store", "risk_level").agg(F.sum(F.abs(F.col("actual") - F.col("predicted"))).alias("err"), F.sum(F.abs("actual")).alias("act"))
    upto, term, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += term
        upto.append(total)
        term /= k + 1
    drawn = (F.pmod(F.xxhash64(F.lit(seed), "rep", "upc", "store"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight = F.size(F.filter(F.array(*map(F.lit, upto)), lambda t: t < drawn))
    drawn_rows = by.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", weight)
    sums = drawn_rows.groupBy("risk_level", "rep").agg(F.sum(F.col("w") * F.col("err")).alias("e"), F.sum(F.col("w") * F.col("act")).alias("a"))
    rate = F.col("e") / F.nullif("a", F.lit(0.0))
    spread = sums.groupBy("risk_level").agg(F.percentile(rate, F.lit(0.025)).alias("low"), F.percentile(rate, F.lit(0.975)).alias("high"))
    whole = by.groupBy("risk_level").agg((F.sum("err") / F.nullif(F.sum("act"), F.lit(0.0))).alias("wape"))
    return whole.join(spread, "risk_level").select("risk_level", "wape", "low", "high")


def stable_windows(df: DataFrame, parts: int = 3) -> DataFrame:
    """(window, first_week, last_week): equal parts of the span of weeks."""
    span = df.agg(F.min("week").alias("a"), F.max("week").alias("b"))
    length = (F.col("b") - F.col("a") + 1) / parts
    edge = lambda i: F.col("a") + F.floor(length * i)
    cells = [F.struct(F.lit(f"W{i + 1}").alias("window"), edge(i).cast("long").alias("first_week"), (edge(i + 1) - 1).cast("long").alias("last_week")) for i in range(parts)]
    return span.select(F.explode(F.array(*cells)).alias("w")).select("w.*")


def window_slopes(rows: DataFrame, windows: DataFrame, key: str = "upc") -> DataFrame:
    """(window, key, n_obs, estimate, std_error) of each window's own fits; rows have x and y. The windows (see
    stable_windows) are few; a row goes with each that holds its week, and all are fitted in one pass."""
    held = rows.join(F.broadcast(windows), F.col("week").between(F.col("first_week"), F.col("last_week")))
    held = held.withColumn("__key", F.concat_ws("|", "window", F.col(key).cast("string")))
    own = regression.within(held, ["x", "y"], ["window", "upc", "store"])
    fits = regression.slopes(own.select("__key", "store", "week", "x", "y"), "__key")
    kind = dict(rows.dtypes)[key]
    return fits.select(F.substring_index("__key", "|", 1).alias("window"), F.substring_index("__key", "|", -1).cast(kind).alias(key), "n_obs", "estimate", "std_error")


def stability(fits: DataFrame, key: str = "upc") -> DataFrame:
    """By pair of windows: products in both, correlation, agreement of sign, share of differences beyond 1.96
    standard errors."""
    a, b = (fits.select(key, *(F.col(c).alias(f"{c}_{s}") for c in ("window", "estimate", "std_error"))) for s in "ab")
    both = a.join(b, key).where("window_a < window_b")
    z = F.abs(F.col("estimate_a") - F.col("estimate_b")) / F.sqrt(F.col("std_error_a") ** 2 + F.col("std_error_b") ** 2)
    return both.groupBy("window_a", "window_b").agg(
        F.count("*").alias("n"), F.corr("estimate_a", "estimate_b").alias("correlation"), F.avg((F.signum("estimate_a") == F.signum("estimate_b")).cast("int")).alias("same_sign"),
        F.avg((z > 1.96).cast("int")).alias("share_different"),
    )


def in_all_windows(fits: DataFrame, windows: int = 3, key: str = "upc") -> DataFrame:
    """(key, n_windows, least, most, spread, same_sign) of the products that each window could fit."""
    e = F.col("estimate")
    by = fits.groupBy(key).agg(F.count("*").alias("n_windows"), F.min(e).alias("least"), F.max(e).alias("most"), F.countDistinct(F.signum(e)).alias("signs"))
    return by.where(F.col("n_windows") == windows).select(key, "n_windows", "least", "most", (F.col("most") - F.col("least")).alias("spread"), (F.col("signs") == 1).alias("same_sign"))


def tracked(contexts: DataFrame, series_: DataFrame) -> DataFrame:
    """Contexts of the series (upc, store) that are followed."""
    return contexts.join(series_.select("upc", "store").distinct(), ["upc", "store"], "left_semi")


def regret(recommendations: DataFrame, known: DataFrame) -> DataFrame:
    """One row: recommendations against the known elasticities (upc, true_elasticity): the share of contexts whose price
    moves towards the best one, and the profit of the recommended and of the current price as shares of the best."""
    p, c, e = F.col("current_price"), F.col("unit_cost"), F.col("true_elasticity")
    rows = recommendations.join(known.select("upc", "true_elasticity"), "upc", "left").where("unit_cost > 0 and true_elasticity < -1")
    profit = lambda price: (price - c) * F.col("base_units") * F.pow(price / p, e)
    best = c * e / (1 + e)
    moved = F.abs(F.col("recommended_price") - p) > 1e-9
    right = F.signum(F.col("recommended_price") - p) == F.signum(best - p)
    return rows.agg(
        F.count("*").alias("n"), F.avg(F.when(moved, right.cast("int"))).alias("share_right_direction"), (F.sum(profit(F.col("recommended_price"))) / F.sum(profit(best))).alias("recommended_of_best"),
        (F.sum(profit(p)) / F.sum(profit(best))).alias("current_of_best"),
    )


def band_metrics(rows: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """(factor, level, n, wape, bias) of forecasts (actual, predicted) by the level of each factor."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), v.cast("string").alias("level")) for k, v in factors.items())))
    error = F.col("predicted") - F.col("actual")
    return rows.withColumn("__f", cells).groupBy("__f.factor", "__f.level").agg(
        F.count("*").alias("n"), (F.sum(F.abs(error)) / F.nullif(F.sum(F.abs("actual")), F.lit(0.0))).alias("wape"), F.avg(error).alias("bias"),
    )


def positions(movement: DataFrame, excluded: Column) -> DataFrame:
    """(position, n): excluded rows before, after or between the other rows of their series, or in a series
    that has none; the first and last such weeks come from a window, not from a join."""
    whole = Window.partitionBy("upc", "store")
    good = F.when(~excluded, F.col("week"))
    rows = movement.withColumns({"__bad": excluded, "__first": F.min(good).over(whole), "__last": F.max(good).over(whole)}).where("__bad")
    place = F.when(F.col("__first").isNull(), "no_valid_week").when(F.col("week") < F.col("__first"), "leading").when(F.col("week") > F.col("__last"), "trailing").otherwise("interior")
    return rows.groupBy(place.alias("position")).agg(F.count("*").alias("n"))


def guardrail_layers(contexts: DataFrame, config: Config, profile: str = "standard") -> DataFrame:
    """(layer, decisions...): guardrails added one after the other, from none to all. The layers are rows of one
    table, so the contexts are decided in one pass."""
    order = ["MAX_PRICE_CHANGE", "EXTRAPOLATION", "COST_FLOOR", "MIN_MARGIN"]
    # without a change limit an interval may be open above, so the limit is the first layer and always there
    texts = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    layers = [F.struct(F.lit(f"{i}_{order[i - 1]}").alias("layer"), texts(order[i:]).alias("off")) for i in range(1, len(order) + 1)]
    rows = contexts.withColumn("__l", F.explode(F.array(*layers))).select(*contexts.columns, "__l.layer", "__l.off")
    found = decisions.recommend(rows, profile, config, disabled=F.col("off"))
    return found.groupBy("layer").agg(
        F.count("*").alias("n"), F.count_if(F.col("decision") != "KEEP_CURRENT").alias("n_changes"), F.avg("proposed_price").alias("mean_price"), F.sum("profit_proposed").alias("profit"),
    )


def scenarios(contexts: DataFrame, config: Config, values: tuple[float, ...] = (-1.5, -1.9, -2.4, -3.1), profile: str = "standard") -> DataFrame:
    """(elasticity, ...): the same contexts decided at each elasticity."""
    rows = contexts.withColumn("elasticity", F.explode(F.array(*map(F.lit, values))))
    return decisions.recommend(rows, profile, config).groupBy("elasticity").agg(
        F.count("*").alias("n"), F.count_if(F.col("decision") != "KEEP_CURRENT").alias("n_changes"), F.avg(F.col("proposed_price") / F.col("current_price") - 1).alias("mean_change"),
    )


def week_to_week(recommendations: DataFrame) -> DataFrame:
    """One row: how often and how far a series' recommended price moves from one row to the next."""
    rows = recommendations.withColumn("__before", F.lag("recommended_price").over(series())).where("__before is not null")
    move = F.abs(F.col("recommended_price") / F.col("__before") - 1)
    return rows.agg(F.count("*").alias("n"), F.avg((move > 1e-9).cast("int")).alias("share_moved"), F.avg(move).alias("mean_move"), F.percentile(move, F.lit(0.9)).alias("p90_move"))


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a keyed hash: the same rows on any cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def poisoned(panel: DataFrame, since: Column) -> DataFrame:
    """The panel with absurd costs from a week on."""
    late = F.col("week") >= since
    wrong = {"estimated_unit_aac": 999.0, "gross_margin_rate": -9.0, "gross_profit": -12345.0}
    return panel.withColumns({c: F.when(late, F.lit(v)).otherwise(F.col(c)) for c, v in wrong.items() if c in panel.columns})


def cost_leakage(panel: DataFrame, build, column: str = "decision_time_unit_cost") -> DataFrame:
    """One row: build (panel -> features) is run on the panel and on one with poisoned costs in the last two weeks. What a
    decision knows of costs must not change up to the first poisoned week, and must change in the week after it."""
    last = panel.agg(F.max("week").alias("__last"))
    marked = panel.crossJoin(F.broadcast(last))
    since = F.col("__last") - 1
    keys = ["upc", "store", "week"]
    a = build(marked).select(*keys, "__last", F.col(column).alias("clean"))
    b = build(poisoned(marked, since)).select(*keys, F.col(column).alias("wrong"))
    both, same = a.join(b, keys), F.col("clean").eqNullSafe(F.col("wrong"))
    early = F.col("week") <= since
    return both.agg(
        F.count_if(early).alias("n_early"), F.count_if(early & ~same).alias("n_leaked"), F.count_if(~early).alias("n_late"), F.count_if(~early & ~same).alias("n_reacting"),
    )


def zero_prices(movement: DataFrame) -> DataFrame:
    """(upc, n_rows, n_zero, n_zero_sold, share_zero, first_zero_week, last_zero_week) of rows without a positive price."""
    zero = F.coalesce(F.col("price") <= 0, F.lit(True))
    by = movement.groupBy("upc").agg(
        F.count("*").alias("n_rows"), F.count_if(zero).alias("n_zero"), F.count_if(zero & (F.col("move") > 0)).alias("n_zero_sold"),
        F.min(F.when(zero, F.col("week"))).alias("first_zero_week"), F.max(F.when(zero, F.col("week"))).alias("last_zero_week"),
    )
    return by.withColumn("share_zero", F.col("n_zero") / F.col("n_rows"))


def recovered(spec_rows: DataFrame, table, known: DataFrame) -> DataFrame:
    """One row: how well an elasticity table finds the known elasticities (upc, true_elasticity) again: the error of the
    pooled slope against their mean by rows, and of the products' own and shrunk slopes."""
    weights = spec_rows.groupBy("upc").agg(F.count("*").alias("n")).join(known, "upc")
    mean = weights.agg((F.sum(F.col("n") * F.col("true_elasticity")) / F.sum("n")).alias("true_mean"))
    errors = table.products.join(known, "upc").agg(
        F.count("*").alias("n_products"), F.avg(F.abs(F.col("estimate") - F.col("true_elasticity"))).alias("mae_raw"), F.avg(F.abs(F.col("elasticity_final") - F.col("true_elasticity"))).alias("mae_final"),
        F.avg(F.col("true_elasticity").between(F.col("ci_low"), F.col("ci_high")).cast("int")).alias("coverage"), F.count_if("usable").alias("n_usable"),
    )
    return mean.crossJoin(errors).withColumn("pooled_error", F.lit(float(table.facts["pooled"])) - F.col("true_mean"))


def tiled(contexts: DataFrame, times: int) -> DataFrame:
    """contexts as many times over, the copies told apart by store, to see how the decision scales."""
    step = contexts.agg((F.max("store") + 1).alias("__step"))
    copies = contexts.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).crossJoin(F.broadcast(step))
    return copies.withColumn("store", F.col("store") + F.col("__i") * F.col("__step")).select(*contexts.columns)
