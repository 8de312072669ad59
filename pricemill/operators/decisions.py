"""The decision: guardrails, candidate prices, risk, and the recommendation, as column expressions.

One generator serves every caller: a set of disabled guardrails leaves those out (a Python set, or an
array column that differs from row to row), a target price replaces the search for the best one, and a
simulator replaces the constant elasticity by any other demand. Nothing leaves the row it belongs to,
so a batch is one projection over the contexts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.columns import demand, extrapolation, objective, price_grid, ratio

# The reason code that each guardrail's bound carries, in the order of reports.
CODES = {
    "MAX_PRICE_CHANGE": "PRICE_CHANGE_LIMIT", "MIN_PRICE": "ABSOLUTE_PRICE_FLOOR", "MAX_PRICE": "ABSOLUTE_PRICE_CEILING",
    "EXTRAPOLATION": "OUTSIDE_EXTRAPOLATION_RANGE", "COST_FLOOR": "MARGIN_CONSTRAINT", "MIN_MARGIN": "MARGIN_CONSTRAINT",
}
CONTEXT = ["upc", "store", "week", "current_price", "unit_cost", "base_units", "elasticity", "elasticity_source", "n_obs", "n_distinct_prices", "price_cv", "price_min", "price_max"]
#: Upper bound, in current prices, where no guardrail gives one.
WIDEST = 5.0

Disabled = frozenset | Column


def is_off(disabled: Disabled, name: str) -> Column:
    """Whether a guardrail is left out."""
    return F.array_contains(disabled, name) if isinstance(disabled, Column) else F.lit(name in disabled)


def policy_columns(profile: str | Column, config: Config) -> dict[str, Column]:
    """The settings of a policy as columns: of one profile, or of the profile that a column names in each row
    (none of them where it names no profile that there is)."""
    if not isinstance(profile, Column):
        return _as_columns(config.policy(profile))
    each = {name: _as_columns(config.policy(name)) for name in config["policy_profiles"]}
    settings = sorted({k for own in each.values() for k in own})
    return {k: F.coalesce(*(F.when(profile == name, own[k]) for name, own in each.items() if k in own)) for k in settings}


def _as_columns(policy: dict) -> dict[str, Column]:
    kind = lambda v: F.lit(v) if isinstance(v, bool | str) else F.lit(v).cast("double")
    return {k: v if isinstance(v, Column) else kind(v) for k, v in policy.items()}


def intervals(policy: dict, cap: Column) -> dict[str, tuple[Column, Column]]:
    """The lowest and the highest price of each guardrail; null where it sets none."""
    policy = _as_columns(policy)
    p, c, tol, margin = F.col("current_price"), F.col("unit_cost"), policy["extrapolation_tolerance_pct"], policy["min_gross_margin_rate"]
    none = F.lit(None).cast("double")
    return {
        "MAX_PRICE_CHANGE": (p * (1 - cap), p * (1 + cap)), "MIN_PRICE": (F.coalesce(policy.get("abs_min_price", none), F.lit(0.01)), none),
        "MAX_PRICE": (none, policy.get("abs_max_price", none)), "EXTRAPOLATION": (F.col("price_min") * (1 - tol), F.col("price_max") * (1 + tol)),
        "COST_FLOOR": (F.when(~policy["allow_below_cost"], c), none), "MIN_MARGIN": (F.when(margin > 0, c / (1 - margin)), none),
    }


def _settled(df: DataFrame) -> DataFrame:
    """df behind a generator of one row each: a filter on a computed column is then not pushed below what
    computes it, where its expression would be written out again at every step."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("__row")).select("__row.*")


def with_bounds(df: DataFrame, policy: dict, cap: Column, disabled: Disabled = frozenset()) -> DataFrame:
    """low, high, guards (the guardrails that stand at the edges of the interval) and binding (their codes)."""
    own = {k: tuple(F.when(~is_off(disabled, k), v) for v in pair) for k, pair in intervals(policy, cap).items()}
    low = F.greatest(*(v for v, _ in own.values()), F.lit(0.01))
    high = F.coalesce(F.least(*(v for _, v in own.values())), F.col("current_price") * WIDEST)
    df = df.withColumns({"low": low, "high": high})
    at = lambda v, edge: F.coalesce(F.abs(v - F.col(edge)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(edge)), F.lit(False))
    names = F.array_compact(F.array(*(F.when(at(v, "low") | at(w, "high"), k) for k, (v, w) in own.items())))
    code_of = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    df = df.withColumn("guards", names)
    return df.withColumn("binding", F.array_sort(F.array_distinct(F.transform("guards", lambda g: code_of[g]))))


def risk_level(price: Column, config: Config, promotion_share: Column | None = None) -> Column:
    """LOW, MEDIUM or HIGH by history and by how far the price lies outside what was seen."""
    away = extrapolation(price, F.col("price_min"), F.col("price_max"))

    def meets(band: dict) -> Column:
        ok = (F.col("n_obs") >= band["min_observations"]) & (F.col("n_distinct_prices") >= band["min_distinct_prices"]) & (away <= band["max_extrapolation_pct"])
        return F.coalesce(ok, F.lit(False))

    doubtful = F.coalesce(F.col("elasticity_source") == "pooled_fallback", F.lit(False))
    if promotion_share is not None:
        doubtful = doubtful | F.coalesce(promotion_share > 0.5, F.lit(False))
    return F.when(meets(config["risk.low_risk"]) & ~doubtful, "LOW").when(meets(config["risk.low_risk"]) | meets(config["risk.medium_risk"]), "MEDIUM").otherwise("HIGH")


def screen(config: Config, goal: str, disabled: Disabled = frozenset()) -> list[Column]:
    """Reason codes that keep a context from being priced at all, in order; null where they don't apply."""
    e, support = config["eligibility"], ~is_off(disabled, "HISTORICAL_SUPPORT")
    few = F.when(support & (F.col("n_obs") < e["min_observations"]), "INSUFFICIENT_HISTORY")
    flat = F.coalesce(F.col("n_distinct_prices") < e["min_distinct_prices"], F.lit(False)) | F.coalesce(F.col("price_cv") < e["min_price_cv"], F.lit(False))
    no_cost = F.when(F.col("unit_cost").isNull(), "COST_UNAVAILABLE") if goal == "gross_profit" else F.lit(None).cast("string")
    return [few, F.when(support & flat, "INSUFFICIENT_PRICE_VARIATION"), no_cost]


def constant_elasticity(df: DataFrame) -> DataFrame:
    """candidates (price, units) of the grid under the context's elasticity, below its cap if it has one."""
    cap = F.col("prediction_cap") if "prediction_cap" in df.columns else None
    units = lambda p: demand(F.col("base_units"), p, F.col("current_price"), F.col("elasticity"), cap)
    return df.withColumn("candidates", F.transform("grid", lambda p: F.struct(p.alias("price"), units(p).alias("units"))))


Simulator = Callable[[DataFrame], DataFrame]


def simulate(df: DataFrame, goal: str, simulator: Simulator = constant_elasticity) -> DataFrame:
    """candidates as structs of price, units and value, in rising order of price."""
    valued = lambda s: F.struct(s.price.alias("price"), s.units.alias("units"), objective(goal, s.price, s.units, F.col("unit_cost")).alias("value"))
    return simulator(df).withColumn("candidates", F.transform("candidates", valued))


def recommend(
    contexts: DataFrame, profile: str | Column = "standard", config: Config | None = None, goal: str | None = None, disabled: Disabled = frozenset(), target: Column | None = None, simulator: Simulator = constant_elasticity,
) -> DataFrame:
    """One row a context, with the decision, the prices, units and uplifts, risk and reason codes.

    Contexts have the columns of CONTEXT, and may have promotion_share (half of the weeks or more on
    promotion make a risk of at least MEDIUM) and prediction_cap. Besides the guardrails of CODES,
    disabled may name HISTORICAL_SUPPORT, RISK_GATE, MATERIALITY and ROUNDING. A context without statistics is not screened, but its risk is
    HIGH. The profile may be a column, so that one pass decides the same context under several. With a target, the price to judge is the target kept within the bounds, and the change of price
    must be material instead of the uplift.
    """
    config = config or Config()
    goal, policy = goal or config["optimization.objective"], policy_columns(profile, config)
    cents, step = config["optimization.price_rounding"], config["optimization.price_step"]
    p, action = F.col("current_price"), policy["high_risk_action"]
    share = F.col("promotion_share") if "promotion_share" in contexts.columns else None
    gated = ~is_off(disabled, "RISK_GATE")
    df = contexts.withColumn("unit_cost", F.when(F.col("unit_cost") > 0, F.col("unit_cost")))
    df = df.withColumns({"screened": F.array_compact(F.array(*screen(config, goal, disabled))), "preliminary_risk": risk_level(p, config, share)})
    cap = policy["max_price_change_pct"]
    if "medium_risk_max_price_change_pct" in policy:
        cap = F.when(gated & (F.col("preliminary_risk") == "MEDIUM"), F.least(cap, policy["medium_risk_max_price_change_pct"])).otherwise(cap)
    df = with_bounds(df, policy, cap, disabled)
    stopped = F.when(F.size("screened") > 0, "screened").when(gated & (F.col("preliminary_risk") == "HIGH") & (action == "keep_current"), "risky")
    grid = price_grid(F.col("low"), F.col("high"), p, step, cents, config["optimization.charm_pricing"])
    if target is not None:
        kept = F.bround(F.least(F.greatest(target, F.col("low")), F.col("high")) / cents, 0) * cents
        grid = F.when(F.col("high") >= F.col("low"), F.array_sort(F.array_distinct(F.array(kept, F.least(F.greatest(p, F.col("low")), F.col("high"))))))
    df = _settled(df.withColumn("stop", stopped))
    df = _settled(df.withColumn("grid", F.when(F.col("stop").isNull(), grid)))
    df = df.withColumn("stop", F.coalesce("stop", F.when(F.coalesce(F.size("grid"), F.lit(0)) <= 0, "infeasible")))
    df = _settled(simulate(df, goal, simulator))
    # a rising array and a strict comparison: of equal values the lowest price wins
    first = F.element_at("candidates", 1)
    best = F.aggregate("candidates", first, lambda a, s: F.when(s.value > a.value, s).otherwise(a))
    if target is not None:
        goal_price = F.least(F.greatest(target, F.col("low")), F.col("high"))
        best = F.aggregate("candidates", first, lambda a, s: F.when(F.abs(s.price - goal_price) < F.abs(a.price - goal_price), s).otherwise(a))
    near = F.aggregate("candidates", first, lambda a, s: F.when(F.abs(s.price - p) < F.abs(a.price - p), s).otherwise(a))
    some = F.size("candidates") > 0
    df = _settled(df.withColumns({"best": F.when(some, best), "now": F.when(some, near)}))
    df = df.withColumns({
        "uplift": ratio(F.col("best.value") - F.col("now.value"), F.abs("now.value")), "change": F.col("best.price") / p - 1,
        "final_risk": F.when(F.col("stop").isNull(), risk_level(F.col("best.price"), config, share)).otherwise(F.col("preliminary_risk")),
    })
    same = F.abs("change") < 1e-9
    material = F.when(is_off(disabled, "MATERIALITY"), 0.0).otherwise(policy["materiality_threshold_pct"])
    small = F.col("uplift").isNull() | (F.col("uplift") < material) if target is None else F.abs("change") < material
    high_risk = gated & (F.col("final_risk") == "HIGH") & (action != "recommend")
    outcome = (
        F.when(F.col("stop").isNotNull(), F.col("stop")).when(same, "same").when(small, "small")
        .when(high_risk & (action == "keep_current"), "risky").when(high_risk, "review").otherwise("change")
    )
    df = _settled(df.withColumn("outcome", outcome))
    is_ = lambda *names: F.col("outcome").isin(*names)
    priced = F.col("stop").isNull()
    rising = F.exists(F.sequence(F.lit(1), F.greatest(F.size("candidates") - 1, F.lit(1))), lambda i: F.coalesce(F.get("candidates", i).units - F.get("candidates", i - 1).units > 1e-9, F.lit(False)))
    past_gate = priced | is_("infeasible")
    codes = F.concat(
        F.coalesce("screened", F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(past_gate & gated & (F.col("preliminary_risk") == "MEDIUM"), "MEDIUM_RISK_CONSERVATIVE"),
            F.when(past_gate & (F.col("elasticity_source") == "pooled_fallback") & F.lit(target is None), "POOLED_ELASTICITY_FALLBACK"),
        )),
        F.when(priced, F.col("binding")).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(priced & rising, "DEMAND_CURVE_NOT_DECREASING"), F.when(is_("infeasible"), "NO_FEASIBLE_PRICE"), F.when(is_("small"), "NON_MATERIAL_UPLIFT"),
            F.when(priced & is_("change", "review", "risky"), "PROFIT_UPLIFT_POSITIVE" if goal == "gross_profit" else "REVENUE_UPLIFT_POSITIVE"),
            F.when(is_("risky"), "HIGH_RISK_KEEP_CURRENT"), F.when(is_("review"), "HIGH_RISK_REVIEW_REQUIRED"), F.when(is_("risky", "review"), "LOW_CONFIDENCE"),
            F.when(~is_("change", "review"), "KEEP_CURRENT_OPTIMAL"),
        )),
    )
    decision = F.when(is_("change"), "RECOMMEND_CHANGE").when(is_("review"), "REVIEW_REQUIRED").otherwise("KEEP_CURRENT")
    proposed = F.when(is_("change", "review"), F.col("best.price")).otherwise(p)
    final = F.when(is_("change"), F.col("best.price")).otherwise(p)
    units_now = F.coalesce("now.units", "base_units")
    units_new = F.when(is_("change", "review"), F.col("best.units")).otherwise(units_now)
    profit = lambda price, units: (price - F.col("unit_cost")) * units
    out = df.withColumns({
        "decision": decision, "proposed_price": proposed, "recommended_price": final, "units_current": units_now, "units_proposed": units_new,
        "profit_current": profit(p, units_now), "profit_proposed": profit(proposed, units_new), "revenue_current": p * units_now, "revenue_proposed": proposed * units_new,
        "risk_level": F.col("final_risk"), "reason_codes": codes, "n_candidates": F.coalesce(F.size("candidates"), F.lit(0)).cast("long"), "constrained_optimum": F.col("best.price"),
    })
    gain = ratio(F.col("profit_proposed") - F.col("profit_current"), F.abs("profit_current"))
    out = out.withColumns({"model_internal_estimated_uplift": gain, "realisable_uplift": F.when(is_("change"), gain).otherwise(F.lit(0.0))})
    own = [c for c in contexts.columns if c in df.columns]
    keep = [*own, "low", "high", "guards", "binding", "preliminary_risk", "risk_level", "decision", "proposed_price", "recommended_price", "constrained_optimum", "n_candidates", "units_current", "units_proposed", "revenue_current", "revenue_proposed", "profit_current", "profit_proposed", "model_internal_estimated_uplift", "realisable_uplift", "reason_codes"]
    return _settled(out.select(*keep))


def with_provenance(recommendations: DataFrame, method: str, model_version: str, config: Config, profile: str | Column = "standard", goal: str | None = None) -> DataFrame:
    """Recommendations with what made them: the profile, the objective, the method of the price response, the version of
    the model, and config_sha256, a digest of all settings that doesn't depend on their order."""
    settings = json.dumps(config.values, sort_keys=True, separators=(",", ":"))
    return recommendations.withColumns({
        "policy_profile": profile if isinstance(profile, Column) else F.lit(profile), "objective": F.lit(goal or config["optimization.objective"]), "price_response_method": F.lit(method),
        "model_version": F.lit(model_version), "config_sha256": F.lit(hashlib.sha256(settings.encode()).hexdigest()),
    })


def curve_diagnostics(simulated: DataFrame) -> DataFrame:
    """By context of simulated candidates: share of rising steps, monotony, relative span, flatness."""
    c = F.col("candidates")
    steps = F.zip_with(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda b, a: b.units - a.units)
    span = ratio(F.array_max(F.transform(c, lambda s: s.units)) - F.array_min(F.transform(c, lambda s: s.units)), F.array_max(F.transform(c, lambda s: s.units)))
    return simulated.withColumns({
        "share_rising": F.size(F.filter(steps, lambda d: d > 1e-9)) / F.nullif(F.size(steps), F.lit(0)), "monotone": F.forall(steps, lambda d: d <= 1e-9), "relative_span": span, "flat": span < 0.01,
    })
