"""Drift from mergeable sketches: what is kept of a feature and a week is a quantile sketch, its number of rows, sum and
zeros; any two periods are compared by merging the sketches of their weeks, without a raw row.

The sketches are KLL with parameter K. For K = 200 a rank that a sketch gives is within RANK_ERROR of the true one with a
probability of 99 % (a normalised error of 1.33 %, of one query to one sketch; merging does not make it worse).
Ranks are read off a sketch's thousand quantiles, which adds a thousandth. A distance between distributions (KS) is then
within twice that; a bin's share in PSI is a difference of two ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.config import Config

from .monitoring import band

#: Size of the sketches, the error of a rank that comes of it, and the steps in which ranks are read off.
K, RANK_ERROR, RESOLUTION = 200, 0.0133, 1000


def weekly(rows: DataFrame, columns: list[str], week: str = "week") -> DataFrame:
    """(feature, week, n, total, n_zero, sketch): one row a feature and week, for values that are not null. Partial sketches
    merge before they are shuffled. New weeks can be appended to those stored."""
    cells = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = rows.selectExpr(f"`{week}` as week", f"stack({len(columns)}, {cells}) as (feature, value)").where("value is not null and not isnan(value)")
    return long.groupBy("feature", "week").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("value") <= 0).alias("n_zero"), F.kll_sketch_agg_double("value", F.lit(K)).alias("sketch"))


def period(sketches: DataFrame, first: int, last: int) -> DataFrame:
    """(feature, n, mean, share_zero, sketch) of the weeks from first to last."""
    own = sketches.where(F.col("week").between(first, last))
    return own.groupBy("feature").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), (F.sum("n_zero") / F.sum("n")).alias("share_zero"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"))


def _quantiles(sketch: str, shares: list[float]) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, shares)))


def _ranks(fine: str, at: str) -> Column:
    """Ranks of values by a sketch's quantiles: as many of them as a value reaches. (Spark gives ranks of constants only.)"""
    return F.transform(at, lambda x: F.size(F.filter(F.col(fine), lambda q: q <= x)) / RESOLUTION)


def drift(sketches: DataFrame, reference: tuple[int, int], current: tuple[int, int], config: Config | None = None, bins: int = 10) -> DataFrame:
    """(feature, psi, ks, reference_mean, current_mean, reference_p95, current_p95, reference_share_zero, current_share_zero, band,
    drift_rank) of two periods of weeks, from the sketches of weekly().

    psi is over bins between the reference's approximate quantiles (0 where fewer than three distinct edges remain), ks the
    largest distance at a hundred quantiles of either period. Means and shares of zeros are exact. A feature
    that one of the periods lacks is left out.
    """
    a = period(sketches, *reference).select("feature", *(F.col(c).alias(f"reference_{c}") for c in ("mean", "share_zero", "sketch")))
    b = period(sketches, *current).select("feature", *(F.col(c).alias(f"current_{c}") for c in ("mean", "share_zero", "sketch")))
    both = a.join(b, "feature")
    inner = F.array_sort(F.array_distinct(_quantiles("reference_sketch", [i / bins for i in range(1, bins)])))
    ends = _quantiles("reference_sketch", [0.0, 1.0])
    cuts = F.filter(inner, lambda e: (e > F.get(F.col("__ends"), F.lit(0))) & (e < F.get(F.col("__ends"), F.lit(1))))
    grid = [i / 100 for i in range(1, 101)]
    both = both.withColumn("__ends", ends).withColumn("__cuts", cuts).withColumn("__grid", F.array_sort(F.array_union(_quantiles("reference_sketch", grid), _quantiles("current_sketch", grid))))
    fine = [i / RESOLUTION for i in range(1, RESOLUTION + 1)]
    both = both.withColumns({f"__{side}_fine": _quantiles(f"{side}_sketch", fine) for side in ("reference", "current")})
    both = both.withColumns({f"__{side}_{at}": _ranks(f"__{side}_fine", f"__{at}") for side in ("reference", "current") for at in ("cuts", "grid")})
    share = lambda side: F.zip_with(F.concat(F.col(f"__{side}_cuts"), F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), F.col(f"__{side}_cuts")), lambda x, y: F.greatest(x - y, F.lit(1e-6)))
    terms = F.zip_with(share("current"), share("reference"), lambda c, r: (c - r) * F.log(c / r))
    psi = F.when(F.size("__cuts") >= 1, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))
    gaps = F.zip_with("__reference_grid", "__current_grid", lambda x, y: F.abs(x - y))
    high = {f"{side}_p95": F.get(_quantiles(f"{side}_sketch", [0.95]), F.lit(0)) for side in ("reference", "current")}
    out = both.select("feature", psi.alias("psi"), F.array_max(gaps).alias("ks"), "reference_mean", "current_mean", *(c.alias(n) for n, c in high.items()), "reference_share_zero", "current_share_zero")
    rank = F.row_number().over(Window.orderBy(F.desc("psi"), "feature"))  # one row a feature
    return out.withColumns({"band": band(F.col("psi"), config or Config()), "drift_rank": rank.cast("long")})
