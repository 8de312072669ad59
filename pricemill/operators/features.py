"""Decision-time features: windows over a series that never see the week being priced."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.columns import package_ounces, ratio


def series():
    """Rows of a product in a store, by week."""
    return Window.partitionBy("upc", "store").orderBy("week")


def _past(n: int | None):
    return series().rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def price_features(price: Column) -> dict[str, Column]:
    """The features that depend on the price itself; call it again with a candidate price."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return {
        "log_price": F.log(price), "price_vs_lag": price / positive("lag_price_1") - 1, "price_vs_reference": price / positive("series_reference_price") - 1,
        "price_vs_roll_mean": price / positive("roll_mean_price_4") - 1,
    }


def with_seasonality(df: DataFrame) -> DataFrame:
    angle = F.col("week_of_year") * (2 * math.pi / 52)
    return df.withColumns({"sin_week": F.sin(angle), "cos_week": F.cos(angle), "trend": F.col("week") / 100})


def features(panel: DataFrame, config: Config | None = None) -> DataFrame:
    """The panel with lags, rolling statistics, reference price, decision-time cost and price features; one
    shuffle, as all windows share partitioning and order. Lags count rows, not calendar weeks."""
    config = config or Config()
    move, price = F.col("move"), F.col("effective_unit_price")
    mean_of = lambda w, least: F.when(F.count("move").over(_past(w)) >= least, F.avg("move").over(_past(w)))
    new = {f"lag_move_{k}": F.lag(move, k).over(series()) for k in config["modeling.lags"]}
    new |= {f"roll_mean_move_{w}": mean_of(w, 2) for w in config["modeling.rolling_windows"]}
    new |= {
        "roll_std_move_4": F.stddev_samp("move").over(_past(4)), "lag_price_1": F.lag(price, 1).over(series()), "lag_price_2": F.lag(price, 2).over(series()),
        "roll_mean_price_4": F.avg(price).over(_past(4)), "series_reference_price": F.percentile(price, F.lit(0.5)).over(_past(None)),
        "decision_time_unit_cost": F.last("estimated_unit_aac", ignorenulls=True).over(_past(None)), "lag_promotion_1": F.lag("recorded_promotion_flag", 1).over(series()),
        "series_age_weeks": (F.row_number().over(series()) - 1).cast("long"), "time_index": F.col("week"),
    }
    out = panel.withColumns(new)
    out = out.withColumn("package_size_oz", package_ounces(F.col("size")) if "size" in panel.columns else F.lit(None).cast("double"))
    return out.withColumns(price_features(price))


def training_rows(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["move", "lag_move_1", "lag_price_1"])


def split_weeks(df: DataFrame, config: Config | None = None) -> DataFrame:
    """One row: last_train and last_valid, the last weeks of the first two parts. The distinct weeks are a few hundred
    numbers. A table of too few weeks raises an error when it is read."""
    config = config or Config()
    n, train = F.size("weeks"), config["modeling.train_frac"]
    a, b = (F.floor(n * F.lit(x)).cast("int") for x in (train, train + config["modeling.valid_frac"]))
    fits = (a > 0) & (a < b) & (b < n)
    fail = F.raise_error(F.concat(n.cast("string"), F.lit(" weeks are too few to split"))).cast("long")
    at = lambda i: F.when(fits, F.element_at("weeks", F.greatest(i, F.lit(1)))).otherwise(fail)
    one = df.agg(F.array_sort(F.collect_set(F.col("week").cast("long"))).alias("weeks"))
    return one.select(at(a).alias("last_train"), at(b).alias("last_valid"))


def with_split(df: DataFrame, config: Config | None = None) -> DataFrame:
    cuts = split_weeks(df.select("week"), config).select(F.col("last_train").alias("__a"), F.col("last_valid").alias("__b"))
    part = F.when(F.col("week") <= F.col("__a"), "train").when(F.col("week") <= F.col("__b"), "valid").otherwise("test")
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", part).drop("__a", "__b")


def arc_pairs(panel: DataFrame) -> DataFrame:
    """Neighbouring rows of a series in consecutive weeks, with the earlier price and units."""
    price = F.col("effective_unit_price")
    prev = {"prev_price": F.lag(price, 1).over(series()), "prev_move": F.lag("move", 1).over(series()), "prev_week": F.lag("week", 1).over(series())}
    return panel.withColumns(prev).where("week - prev_week = 1")


def price_episodes(panel: DataFrame, least: float = 0.05, most: float = 0.60) -> DataFrame:
    """Consecutive-week price changes of a size worth studying, with units sold before and after."""
    pairs = arc_pairs(panel).where("prev_price > 0 and effective_unit_price > 0 and prev_move > 0 and move > 0")
    change = ratio(F.col("effective_unit_price"), F.col("prev_price")) - 1
    return pairs.withColumn("change", change).where(F.abs("change").between(least, most))
