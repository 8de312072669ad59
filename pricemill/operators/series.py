"""Price variation of series and products, over all rows or over what was known at a week."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.columns import ratio

from .features import series


def _changes(panel: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n_price_changes) of groups of many series, their rows ordered by week and series. A week's prices are compared within
    an array of its series, and weeks with each other by one row a week, so no task orders all rows of a group."""
    rest = [c for c in ("upc", "store") if c not in keys]
    weeks = panel.groupBy(*keys, "week").agg(F.array_sort(F.collect_list(F.struct(*rest, F.col("effective_unit_price").alias("p")))).alias("a"))
    n, differ = F.size("a"), lambda x, y: F.coalesce(F.abs(y - x) > 1e-9, F.lit(False))
    inside = F.size(F.filter(F.zip_with(F.slice("a", F.lit(1), n - 1), F.slice("a", F.lit(2), n - 1), lambda x, y: differ(x.p, y.p)), lambda d: d))
    before = F.lag(F.element_at("a", -1).p).over(Window.partitionBy(*keys).orderBy("week"))
    return weeks.withColumn("c", inside + differ(before, F.element_at("a", 1).p).cast("int")).groupBy(*keys).agg(F.sum("c").alias("n_price_changes"))


def price_variation(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: observations, weeks, distinct prices, price moments, units, changes from row to row."""
    p, of_series = F.col("effective_unit_price"), {"upc", "store"} <= set(keys)
    figures = {
        "n_obs": F.count(p), "n_weeks": F.countDistinct("week"), "n_distinct_prices": F.countDistinct(p), "price_min": F.min(p),
        "price_max": F.max(p), "price_mean": F.avg(p), "price_std": F.stddev_samp(p), "total_units": F.sum("move"),
    }
    if of_series:  # a series has at most its weeks
        panel = panel.withColumn("__change", F.abs(p - F.lag(p).over(Window.partitionBy(*keys).orderBy("week"))) > 1e-9)
        figures["n_price_changes"] = F.count_if("__change")
    out = panel.groupBy(*keys).agg(*(v.alias(k) for k, v in figures.items()))
    if not of_series:
        out = out.join(_changes(panel, keys), keys)
    return out.withColumns({
        "price_cv": ratio(F.col("price_std"), F.col("price_mean")), "price_range_pct": ratio(F.col("price_max") - F.col("price_min"), F.col("price_mean")),
        "price_change_rate": F.col("n_price_changes") / F.greatest(F.col("n_obs"), F.lit(1)),
    })


def with_series_stats(panel: DataFrame) -> DataFrame:
    """Each row with the statistics of its whole series; by windows, so that features and statistics share one
    shuffle and the panel is read once. The distinct prices of a series are at most its weeks."""
    p, whole = F.col("effective_unit_price"), Window.partitionBy("upc", "store")
    return panel.withColumns({
        "n_obs": F.count(p).over(whole), "n_distinct_prices": F.size(F.collect_set(p).over(whole)).cast("long"), "price_min": F.min(p).over(whole), "price_max": F.max(p).over(whole),
        "price_cv": ratio(F.stddev_samp(p).over(whole), F.avg(p).over(whole)),
    })


def with_eligibility(stats: DataFrame, config: Config | None = None) -> DataFrame:
    e = (config or Config())["eligibility"]
    ok = (F.col("n_obs") >= e["min_observations"]) & (F.col("n_distinct_prices") >= e["min_distinct_prices"]) & (F.col("price_cv") >= e["min_price_cv"])
    return stats.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def history_stats(panel: DataFrame) -> DataFrame:
    """Each row with its series' statistics over strictly earlier rows; distinct prices by a running sum of
    first appearances, so that no frame is scanned for it."""
    p = F.col("effective_unit_price")
    past = series().rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("upc", "store", "effective_unit_price").orderBy("week")) == 1
    out = panel.withColumn("__first", first.cast("long")).withColumns({
        "hist_n_obs": F.count(p).over(past), "hist_n_prices": F.coalesce(F.sum("__first").over(past), F.lit(0)), "hist_mean": F.avg(p).over(past),
        "hist_std": F.stddev_samp(p).over(past), "hist_min": F.min(p).over(past), "hist_max": F.max(p).over(past),
    })
    return out.drop("__first")
