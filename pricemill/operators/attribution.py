"""Which guardrail decides: each context once with every guardrail and once without each of them.

The variants are rows of one table, so one plan decides all of them; a window over the rows of a
context then holds each variant against the one with every guardrail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.columns import best_price, demand, objective, price_grid

from . import decisions

KEYS = ["upc", "store", "week"]
# The constraints in the order of reports.
CONSTRAINTS = ("MAX_PRICE_CHANGE", "MIN_PRICE", "MAX_PRICE", "MIN_MARGIN", "COST_FLOOR", "EXTRAPOLATION", "ROUNDING", "MATERIALITY", "RISK_GATE", "HISTORICAL_SUPPORT")
#: The wide grid that stands for no guardrails, in current prices; the step of the fine grid.
RESEARCH, FINE_STEP = (0.2, 5.0), 0.01


def constraint_intervals(contexts: DataFrame, policy: dict) -> DataFrame:
    """(upc, store, week, constraint, low, high): what each guardrail alone allows; null where it sets nothing."""
    own = decisions.intervals(policy, F.lit(float(policy["max_price_change_pct"])))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("constraint"), lo.alias("low"), hi.alias("high")) for k, (lo, hi) in own.items())))
    return contexts.withColumn("__c", rows).select(*KEYS, "__c.*")


def _best(prices: Column, goal: str) -> Column:
    """The lowest of the prices with the highest value; null for none."""
    units = lambda p: demand(F.col("base_units"), p, F.col("current_price"), F.col("elasticity"))
    rated = F.transform(prices, lambda p: F.struct(p.alias("price"), objective(goal, p, units(p), F.col("unit_cost")).alias("value")))
    top = F.aggregate(rated, F.get(rated, F.lit(0)), lambda a, s: F.when(s.value > a.value, s).otherwise(a))
    return F.when(top.value.isNotNull(), top.price)


def researched(contexts: DataFrame, policy: dict, config: Config, goal: str) -> DataFrame:
    """contexts with unconstrained_optimum, the best price of the wide grid, and removed, how many prices of it
    each guardrail takes away (a map)."""
    p = F.col("current_price")
    grid = price_grid(F.greatest(F.lit(0.01), p * RESEARCH[0]), p * RESEARCH[1], p, config["optimization.price_step"], config["optimization.price_rounding"], config["optimization.charm_pricing"])
    df = contexts.withColumn("unit_cost", F.when(F.col("unit_cost") > 0, F.col("unit_cost"))).withColumn("__wide", grid)
    df = decisions._settled(df)
    outside = lambda q, lo, hi: F.coalesce(q < lo - 1e-9, F.lit(False)) | F.coalesce(q > hi + 1e-9, F.lit(False))
    counts = [
        x for k, (lo, hi) in decisions.intervals(policy, F.lit(float(policy["max_price_change_pct"]))).items()
        for x in (F.lit(k), F.size(F.filter("__wide", lambda q: outside(q, lo, hi))).cast("long"))
    ]
    return decisions._settled(df.withColumns({"unconstrained_optimum": _best(F.col("__wide"), goal), "removed": F.create_map(*counts)}).drop("__wide"))


def variants(contexts: DataFrame, profile: str = "standard", config: Config | None = None) -> DataFrame:
    """Eleven rows a context: left_out ("baseline", then each constraint), its decision, and baseline, the
    decision with every guardrail as a struct."""
    config = config or Config()
    goal = config["optimization.objective"]
    rows = researched(contexts, config.policy(profile), config, goal)
    rows = rows.withColumn("left_out", F.explode(F.array(*(F.lit(x) for x in ("baseline", *CONSTRAINTS)))))
    found = decisions.recommend(rows, profile, config, disabled=F.array("left_out"))
    kept = ["decision", "proposed_price", "recommended_price", "constrained_optimum", "low", "high", "guards", "reason_codes", "n_candidates"]
    first = F.max(F.when(F.col("left_out") == "baseline", F.struct(*kept))).over(Window.partitionBy(*KEYS))
    return found.withColumn("baseline", first)


def by_constraint(found: DataFrame, profile: str = "standard", config: Config | None = None) -> DataFrame:
    """Rows (context, constraint) of variants: whether it is there, takes prices away, binds, and what leaving
    it out changes. Rounding binds where the best price by cents lies further away than one cent."""
    config = config or Config()
    policy, goal = config.policy(profile), config["optimization.objective"]
    rows = decisions._settled(found.where("left_out <> 'baseline'"))
    own = decisions.intervals(policy, F.lit(float(policy["max_price_change_pct"])))
    there = F.lit(True)
    for k, (lo, hi) in own.items():
        there = F.when(F.col("left_out") == k, lo.isNotNull() | hi.isNotNull()).otherwise(there)
    there = F.when(F.col("left_out") == "MATERIALITY", F.lit(policy["materiality_threshold_pct"] > 0)).otherwise(there)
    has = lambda *codes: F.arrays_overlap("baseline.reason_codes", F.array(*map(F.lit, codes)))
    low, high = F.col("baseline.low"), F.col("baseline.high")
    steps = (F.ceil((high + 1e-9 - low) / FINE_STEP) - 1).cast("int")
    fine = F.when((F.col("left_out") == "ROUNDING") & (F.col("baseline.n_candidates") > 0) & (high >= low), F.transform(F.sequence(F.lit(0), steps), lambda i: low + i * FINE_STEP))
    rows = decisions._settled(rows.withColumn("__fine", fine))
    distance = F.abs(_best(F.col("__fine"), goal) - F.col("baseline.constrained_optimum"))
    rows = decisions._settled(rows.withColumn("rounding_distance", distance).drop("__fine"))
    coarse = F.coalesce(F.col("rounding_distance") > 0.011, F.lit(False))
    name = F.col("left_out")
    binds = (
        F.when(name == "MATERIALITY", has("NON_MATERIAL_UPLIFT")).when(name == "RISK_GATE", has("HIGH_RISK_REVIEW_REQUIRED", "HIGH_RISK_KEEP_CURRENT", "MEDIUM_RISK_CONSERVATIVE"))
        .when(name == "HISTORICAL_SUPPORT", has("INSUFFICIENT_HISTORY", "INSUFFICIENT_PRICE_VARIATION")).when(name == "ROUNDING", coarse)
        .otherwise(F.col("baseline.n_candidates").cast("boolean") & F.array_contains("baseline.guards", name))
    )
    price = F.abs(F.col("recommended_price") - F.col("baseline.recommended_price")) > 1e-9
    return rows.select(
        *KEYS, name.alias("constraint"), there.alias("present"), F.coalesce(F.try_element_at("removed", name), F.lit(0)).cast("long").alias("removed_candidates"), binds.alias("binding"),
        (F.col("decision") != F.col("baseline.decision")).alias("changed_decision"), F.when(name == "ROUNDING", coarse).otherwise(price).alias("changed_price"), "rounding_distance",
    )


def constraint_table(rows: DataFrame) -> DataFrame:
    """By constraint of by_constraint: contexts where it is there, takes prices away (and how many, in the
    middle), binds, changes the decision or the price."""
    takes = F.col("removed_candidates") > 0
    return rows.groupBy("constraint").agg(
        F.count_if("present").alias("present"), F.count_if(takes).alias("removing"), F.coalesce(F.percentile(F.when(takes, F.col("removed_candidates")), F.lit(0.5)), F.lit(0.0)).alias("median_removed"),
        F.count_if("binding").alias("binding"), F.count_if("changed_decision").alias("changed_decision"), F.count_if("changed_price").alias("changed_price"),
    )


def by_context(found: DataFrame, profile: str = "standard", config: Config | None = None) -> DataFrame:
    """One row a context of variants: the optimum without guardrails, on the grid and in closed form, what was
    decided, the first guardrail on the way to that optimum, and what determines the final price."""
    config = config or Config()
    policy, tolerance = config.policy(profile), config["optimization.price_step"] + 1e-9
    rows = found.where("left_out = 'baseline'")
    best, low, high = F.col("unconstrained_optimum"), F.col("low"), F.col("high")
    has = lambda *codes: F.arrays_overlap("reason_codes", F.array(*map(F.lit, codes)))
    bounded = (F.col("n_candidates") > 0) | has("NO_FEASIBLE_PRICE")
    above, below = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (lo, hi) in reversed(decisions.intervals(policy, F.lit(float(policy["max_price_change_pct"]))).items()):
        above, below = F.when(F.abs(hi - high) < 1e-6, k).otherwise(above), F.when(F.abs(lo - low) < 1e-6, k).otherwise(below)
    first = (
        F.when(best.isNull(), "").when(has("INSUFFICIENT_HISTORY", "INSUFFICIENT_PRICE_VARIATION"), "HISTORICAL_SUPPORT").when(has("HIGH_RISK_KEEP_CURRENT"), "RISK_GATE").when(~bounded, "")
        .when(best > high + 1e-9, F.coalesce(above, F.lit(""))).when(best < low - 1e-9, F.coalesce(below, F.lit(""))).when(has("NON_MATERIAL_UPLIFT"), "MATERIALITY")
        .when(has("HIGH_RISK_REVIEW_REQUIRED"), "RISK_GATE").otherwise("NONE")
    )
    inside = F.coalesce(bounded & (best >= low - 1e-9) & (best <= high + 1e-9), F.lit(False))
    close = lambda c: F.coalesce(F.abs(best - F.col(c)) <= tolerance, F.lit(False))
    determinant = (
        F.when(has("INSUFFICIENT_HISTORY", "INSUFFICIENT_PRICE_VARIATION", "COST_UNAVAILABLE", "NO_FEASIBLE_PRICE"), "screened").when(has("HIGH_RISK_KEEP_CURRENT"), "high_risk")
        .when(F.col("decision") == "REVIEW_REQUIRED", "review").when(has("NON_MATERIAL_UPLIFT"), "materiality").when(~inside, "guardrail_corner").otherwise("learned_signal")
    )
    return rows.select(
        *KEYS, "decision", "risk_level", "unconstrained_optimum", best_price(F.col("unit_cost"), F.col("elasticity")).alias("analytic_optimum"), "constrained_optimum", "proposed_price", "recommended_price",
        first.alias("first_binding"), inside.alias("optimum_inside"), close("proposed_price").alias("proposal_matches"), close("recommended_price").alias("optimum_survives"), determinant.alias("determinant"),
    )
