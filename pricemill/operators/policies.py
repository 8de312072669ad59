"""Simple pricing policies, their scoring, and the weekly backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.functions.columns import demand

POLICIES = ("historical", "simple_margin", "elasticity_baseline", "optimised")


def clipped(price: Column, policy: dict) -> Column:
    """A price kept within the change limit, the cost floor and the support; the current price where that is empty."""
    p, cap, tol = F.col("current_price"), policy["max_price_change_pct"], policy["extrapolation_tolerance_pct"]
    low = F.greatest(F.lit(0.01), p * (1 - cap), F.col("unit_cost"), F.col("price_min") * (1 - tol))
    high = F.least(p * (1 + cap), F.col("price_max") * (1 + tol))
    return F.when(high >= low, F.least(F.greatest(price, low), high)).otherwise(p)


def policy_prices(contexts: DataFrame, policy: dict, margin: float = 0.20, elasticity: float = -2.0, more: dict[str, Column] | None = None) -> DataFrame:
    """Contexts (with recommended_price) as one row a policy: policy and price. A policy is any column that makes a price
    of a context; more names further ones, which are kept within the same limits."""
    cost = F.col("unit_cost")
    prices = {
        "historical": F.col("current_price"), "simple_margin": clipped(cost / (1 - margin), policy),
        "elasticity_baseline": clipped(cost * elasticity / (1 + elasticity), policy), "optimised": F.col("recommended_price"),
    }
    prices |= {k: clipped(v, policy) for k, v in (more or {}).items()}
    entries = [F.struct(F.lit(k).alias("policy"), F.coalesce(v, F.col("current_price")).alias("price")) for k, v in prices.items()]
    return contexts.withColumn("__p", F.explode(F.array(*entries))).select(*contexts.columns, "__p.policy", "__p.price")


def scored(prices: DataFrame) -> DataFrame:
    """Units, revenue and profit of each policy's price at the context's cost."""
    units = demand(F.col("base_units"), F.col("price"), F.col("current_price"), F.col("elasticity"))
    return prices.withColumn("units", units).withColumns({"revenue": F.col("price") * F.col("units"), "profit": (F.col("price") - F.col("unit_cost")) * F.col("units")})


def totals(scores: DataFrame) -> DataFrame:
    """By policy: contexts, revenue, profit, and profit against the historical policy."""
    by = scores.groupBy("policy").agg(F.count("*").alias("n_contexts"), F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
    anchor = by.where("policy = 'historical'").select(F.col("profit").alias("__anchor"))
    return by.crossJoin(F.broadcast(anchor)).withColumn("profit_vs_historical", F.col("profit") / F.nullif("__anchor", F.lit(0.0)) - 1).drop("__anchor")


def rule_targets() -> dict[str, Column]:
    """Rule-only targets: keep, hold the margin, cost plus a quarter, the modal price, the largest rise."""
    p, c = F.col("current_price"), F.col("unit_cost")
    return {
        "R0_keep": p, "R1_hold_margin": c / (1 - F.least(F.greatest("median_margin", F.lit(0.0)), F.lit(0.8))), "R2_cost_plus": c * 1.25, "R3_modal_price": F.col("modal_price"), "R4_max_increase": p * 10,
    }
