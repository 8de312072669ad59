"""Product roles, concentration, and what the recommendations would be worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.functions.columns import demand
from pricemill.functions.ranges import running_totals


def concentration(panel: DataFrame) -> DataFrame:
    """By product: units, revenue, weeks, shares, and the running revenue share in falling order of revenue."""
    by = panel.groupBy("upc").agg(F.sum("move").alias("units"), F.sum("revenue").alias("revenue"), F.count("*").alias("n_obs"))
    whole = by.agg(F.sum("revenue").alias("__all"))
    out = running_totals(by, -F.col("revenue"), [F.desc("revenue"), F.col("upc")], {"revenue_rank": F.lit(1).cast("long"), "__upto": F.col("revenue")})
    shares = {"revenue_share": F.col("revenue") / F.col("__all"), "cumulative_share": F.col("__upto") / F.col("__all")}
    return out.crossJoin(F.broadcast(whole)).withColumns(shares).drop("__all", "__upto")


def roles(panel: DataFrame, weeks: int = 52) -> DataFrame:
    """Products of the last weeks as core (first half of revenue), support (to four fifths) or tail."""
    last = panel.agg(F.max("week").alias("__last"))
    recent = panel.crossJoin(F.broadcast(last)).where(F.col("week") > F.col("__last") - weeks)
    before = F.col("cumulative_share") - F.col("revenue_share")
    return concentration(recent).withColumn("role", F.when(before < 0.5, "core").when(before < 0.8, "support").otherwise("tail"))


def value_scenarios(recommendations: DataFrame, shares: dict[str, float], weeks: int = 52) -> DataFrame:
    """(scenario, weekly, annual): the realisable gain of the recommendations at each share of it."""
    gain = F.coalesce(F.sum(F.when(F.col("decision") == "RECOMMEND_CHANGE", F.col("profit_proposed") - F.col("profit_current"))), F.lit(0.0))
    one = recommendations.agg(gain.alias("gain"))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(float(v)).alias("share")) for k, v in shares.items())))
    return one.withColumn("s", rows).select("s.scenario", (F.col("gain") * F.col("s.share")).alias("weekly"), (F.col("gain") * F.col("s.share") * weeks).alias("annual"))


# Which products drive traffic and which make the tail.
TRAFFIC_TOP, TRAFFIC_COVERAGE, TAIL_REVENUE = 0.2, 0.75, 0.05


def priced_roles(panel: DataFrame, elasticities: DataFrame, weeks: int = 52) -> DataFrame:
    """Products of the last weeks by role: traffic driver (among the most sold, in most stores), tail (the last revenue),
    margin builder (of the others, a margin above and an elasticity below their medians), or core.
    elasticities: (upc, elasticity)."""
    last = panel.agg(F.max("week").alias("__last"))
    recent = panel.crossJoin(F.broadcast(last)).where(F.col("week") > F.col("__last") - weeks)
    stores = recent.agg(F.countDistinct("store").alias("__stores"), F.sum("revenue").alias("__revenue"), F.countDistinct("upc").alias("__products"))
    by = recent.groupBy("upc").agg(F.sum("move").alias("units"), F.sum("revenue").alias("revenue"), F.sum("gross_profit").alias("gross_profit"), F.countDistinct("store").alias("stores"))
    by = by.join(elasticities.select("upc", "elasticity"), "upc", "left").crossJoin(F.broadcast(stores))
    ranked = running_totals(by, -F.col("units"), [F.desc("units"), F.col("upc")], {"unit_rank": F.lit(1).cast("long")})
    ranked = running_totals(ranked, -F.col("revenue"), [F.desc("revenue"), F.col("upc")], {"__upto": F.col("revenue")})
    before = (F.col("__upto") - F.col("revenue")) / F.col("__revenue")
    traffic = (F.col("unit_rank") / F.col("__products") <= TRAFFIC_TOP) & (F.col("stores") / F.col("__stores") >= TRAFFIC_COVERAGE)
    rows = ranked.withColumns({
        "gross_margin_rate": F.col("gross_profit") / F.nullif("revenue", F.lit(0.0)), "store_coverage": F.col("stores") / F.col("__stores"),
        "__kind": F.when(traffic, "traffic driver").when(before >= 1 - TAIL_REVENUE, "tail").otherwise("rest"),
    })
    middle = rows.where("__kind = 'rest'").agg(F.percentile("gross_margin_rate", F.lit(0.5)).alias("__margin"), F.percentile(F.abs("elasticity"), F.lit(0.5)).alias("__response"))
    builds = F.coalesce((F.col("gross_margin_rate") > F.col("__margin")) & (F.abs("elasticity") < F.col("__response")), F.lit(False))
    role = F.when(F.col("__kind") != "rest", F.col("__kind")).when(builds, "margin builder").otherwise("core")
    return rows.crossJoin(F.broadcast(middle)).select("upc", "units", "revenue", "gross_margin_rate", "store_coverage", "elasticity", role.alias("role"))


def _gain(price: Column) -> Column:
    """Profit of a price over the current one, under the context's elasticity."""
    cost, p = F.col("unit_cost"), F.col("current_price")
    return (price - cost) * demand(F.col("base_units"), price, p, F.col("elasticity")) - (p - cost) * F.col("base_units")


def with_role(recommendations: DataFrame, roles_: DataFrame) -> DataFrame:
    """recommendations with the role of their product; products without one are tail."""
    out = recommendations.join(roles_.select("upc", F.col("role").alias("__role")), "upc", "left")
    return out.withColumn("role", F.coalesce("__role", F.lit("tail"))).drop("__role")


def role_summary(recommendations: DataFrame, roles_: DataFrame) -> DataFrame:
    """By role: contexts, shares of decisions, the middle change of the actionable ones, and the share of the gain."""
    rows = with_role(recommendations, roles_).withColumn("__gain", _gain(F.col("recommended_price")))
    act = F.col("decision") == "RECOMMEND_CHANGE"
    change = F.when(act, F.col("recommended_price") / F.col("current_price") - 1)
    total = rows.agg(F.sum("__gain").alias("__total"))
    by = rows.groupBy("role").agg(
        F.count("*").alias("contexts"), F.avg(act.cast("int")).alias("share_actionable"), F.avg((F.col("decision") == "REVIEW_REQUIRED").cast("int")).alias("share_review"),
        F.avg((change > 0).cast("int")).alias("share_increases"), F.percentile(change, F.lit(0.5)).alias("median_change"), F.sum("__gain").alias("__own"),
    )
    return by.crossJoin(F.broadcast(total)).withColumn("share_of_gain", F.col("__own") / F.nullif("__total", F.lit(0.0))).drop("__own", "__total")


def traffic_cap(recommendations: DataFrame, roles_: DataFrame, cap: float) -> DataFrame:
    """One row: what it costs to cap the increases of traffic drivers."""
    rows, full = with_role(recommendations, roles_), F.col("recommended_price")
    limit = F.col("current_price") * (1 + cap)
    drives = F.col("role") == "traffic driver"
    base = (F.col("current_price") - F.col("unit_cost")) * F.col("base_units")
    out = rows.agg(
        F.sum(base).alias("base"), F.sum(_gain(full)).alias("full"), F.sum(_gain(F.when(drives, F.least(full, limit)).otherwise(full))).alias("capped"),
        F.count_if(drives & (full > limit + 1e-9)).alias("affected"),
    )
    part = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    return out.select(F.lit(float(cap)).alias("cap"), part("full", "base").alias("uplift_full"), part("capped", "base").alias("uplift_capped"), (1 - part("capped", "full")).alias("share_given_up"), "affected")
