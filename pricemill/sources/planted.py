"""Known elasticities planted into a panel: its series, weeks, prices and promotions stay as they are, its units are made
anew from them, so that what an estimate finds can be held against what was put in. Every random number is a hash of
its place, so any row can be made anywhere, and the same again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Log units of a week at the series' mean price: about 400, so that counting in whole units adds little noise.
LEVEL = 6.0
#: Standard deviation of log units beside price and promotion: a fifth, about that of weekly sales of one product in one store.
NOISE = 0.2


def elasticity_of(upc: Column) -> Column:
    """-1.25 to -3.0 in eight equal steps by product number: all elastic, and evenly spread whatever the products are."""
    return -(1.25 + upc % 8 * 0.25)


def truth(panel: DataFrame) -> DataFrame:
    """(upc, true_elasticity) of a panel's products."""
    return panel.select("upc").distinct().withColumn("true_elasticity", elasticity_of(F.col("upc")))


def _normal(name: str) -> Column:
    """A standard normal number by Box and Muller's formula from two hashes of a row's place."""
    uniform = lambda part: (F.pmod(F.xxhash64(F.lit(f"{name}/{part}"), "upc", "store", "week"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.log(uniform("radius"))) * F.cos(2 * math.pi * uniform("angle"))


def planted(panel: DataFrame, depth: float = 0.0, lift: float = 0.0, recorded: bool = True, follows: float = 0.0) -> DataFrame:
    """The panel with units of known elasticities (see truth).

    Promoted rows are sold cheaper by `depth` and lift log units by `lift` beside that; not recorded, their flag is taken away
    after the units are made, which misleads. With `follows`, log prices go down by so much of the row's noise (in
    standard deviations), as if prices were cut when demand is high: no regression on prices can tell that apart.
    """
    p, promoted = F.col("effective_unit_price"), F.col("recorded_promotion_flag") == 1
    noise = _normal("noise")
    rows = panel.where(p > 0).withColumns({"__noise": noise, "__promoted": promoted.cast("int")})
    price = p * F.when(promoted, 1 - depth).otherwise(1.0) * F.exp(-follows * F.col("__noise"))
    rows = rows.withColumn("effective_unit_price", price)
    usual = F.avg(F.log("effective_unit_price")).over(Window.partitionBy("upc", "store"))
    units = F.exp(LEVEL + elasticity_of(F.col("upc")) * (F.log("effective_unit_price") - usual) + lift * F.col("__promoted") + NOISE * F.col("__noise"))
    rows = rows.withColumn("move", F.round(units, 0))
    return rows.withColumn("recorded_promotion_flag", F.col("__promoted") if recorded else F.lit(0)).drop("__noise", "__promoted")


#: What misleads a regression, and what does not: settings of planted(). A fifth off and half as much again beside it are a usual
#: promotion; a twentieth of the price for a standard deviation of demand is a mild reaction.
SCENARIOS = {
    "clean": {}, "promotions recorded": {"depth": 0.2, "lift": 0.4}, "promotions not recorded": {"depth": 0.2, "lift": 0.4, "recorded": False},
    "prices follow demand": {"follows": 0.05}, "both": {"depth": 0.2, "lift": 0.4, "recorded": False, "follows": 0.05},
}
