"""Rows without a positive price: runs of them within a series, where they lie, and whom they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("never_priced", "leading", "trailing", "interior")


def is_zero() -> Column:
    """No price, or one that is not positive."""
    return F.coalesce(F.col("price") <= 0, F.lit(True))


def runs(movement: DataFrame) -> DataFrame:
    """(upc, store, kind, first_week, last_week, n_weeks, n_sold): each run of rows without a price, rows of a series
    following each other by week; weeks without a row neither end a run nor count. kind: of a series that never has a
    price, before its first priced row, after its last, or between two. n_sold counts rows with units. Windows and
    groups share the one shuffle by series."""
    whole, order = Window.partitionBy("upc", "store"), Window.partitionBy("upc", "store").orderBy("week")
    rows = movement.select("upc", "store", "week", "move", is_zero().alias("zero"))
    rows = rows.withColumns({
        "starts": (F.col("zero") & ~F.coalesce(F.lag("zero").over(order), F.lit(False))).cast("int"),
        "priced": F.sum((~F.col("zero")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "all_priced": F.sum((~F.col("zero")).cast("int")).over(whole),
    })
    rows = rows.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("zero")
    by = rows.groupBy("upc", "store", "run").agg(
        F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.count("*").alias("n_weeks"), F.count_if(F.col("move") > 0).alias("n_sold"),
        F.first("priced").alias("priced"), F.first("all_priced").alias("all_priced"),
    )
    kind = F.when(F.col("all_priced") == 0, "never_priced").when(F.col("priced") == 0, "leading").when(F.col("priced") == F.col("all_priced"), "trailing").otherwise("interior")
    return by.select("upc", "store", kind.alias("kind"), "first_week", "last_week", "n_weeks", "n_sold")


def by_kind(found: DataFrame) -> DataFrame:
    """Runs by kind: their number, rows, rows with units, mean and greatest length, and share of all such rows."""
    by = found.groupBy("kind").agg(F.count("*").alias("n_runs"), F.sum("n_weeks").alias("n_rows"), F.sum("n_sold").alias("n_sold"), F.avg("n_weeks").alias("mean_length"), F.max("n_weeks").alias("longest"))
    return by.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(0))))  # four rows


def by_dimension(movement: DataFrame) -> DataFrame:
    """(dimension, key, n_rows, n_zero, n_zero_sold, share_zero) by week, product and store, in one pass over the rows."""
    zero = is_zero()
    names = ("week", "upc", "store")
    by = movement.select(*names, "move", zero.alias("zero")).groupingSets([["week"], ["upc"], ["store"]], *names).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n_rows"), F.count_if("zero").alias("n_zero"), F.count_if(F.col("zero") & (F.col("move") > 0)).alias("n_zero_sold"))
    place = {3: "week", 5: "upc", 6: "store"}  # the bits of the columns that a set leaves out
    dimension, key = None, None
    for g, n in place.items():
        dimension = F.when(F.col("g") == g, n) if dimension is None else dimension.when(F.col("g") == g, n)
        key = F.when(F.col("g") == g, F.col(n).cast("long")) if key is None else key.when(F.col("g") == g, F.col(n).cast("long"))
    return by.select(dimension.alias("dimension"), key.alias("key"), "n_rows", "n_zero", "n_zero_sold", (F.col("n_zero") / F.col("n_rows")).alias("share_zero"))


def spread(found: DataFrame) -> DataFrame:
    """(dimension, n, mean_share, std_share, min_share, max_share, n_above_half, n_above_80, n_below_5) of by_dimension's shares."""
    s = F.col("share_zero")
    return found.groupBy("dimension").agg(
        F.count("*").alias("n"), F.avg(s).alias("mean_share"), F.stddev_samp(s).alias("std_share"), F.min(s).alias("min_share"), F.max(s).alias("max_share"),
        F.count_if(s > 0.5).alias("n_above_half"), F.count_if(s > 0.8).alias("n_above_80"), F.count_if(s < 0.05).alias("n_below_5"),
    )


def selection(movement: DataFrame) -> DataFrame:
    """(series, n, mean_price, mean_units): whether series that lose over half of their rows to the rule (heavy) differ from
    those that lose a tenth at most (light) in prices and units."""
    zero = is_zero()
    by = movement.groupBy("upc", "store").agg(F.avg(zero.cast("int")).alias("share"), F.avg(F.when(~zero, F.col("price"))).alias("price"), F.avg("move").alias("units"))
    kind = F.when(F.col("share") > 0.5, "heavy").when(F.col("share") <= 0.1, "light").otherwise("middle")
    return by.groupBy(kind.alias("series")).agg(F.count("*").alias("n"), F.avg("price").alias("mean_price"), F.avg("units").alias("mean_units"))
