"""Elasticity tables as of many weeks from one pass, and a backtest that decides each week on what was known before it.

Rows are summed once by (product, store, span), a span being the weeks between two neighbouring cuts. Running sums
over the spans of a series give its moments before each cut; less their means they are the series' Gram matrix
within the series, and added up over stores the product's. So slopes, pooled slopes and histories as of all cuts
follow from tables that don't grow with the weeks. Robust errors take the residuals of each cut's own fit, and for
them alone the rows are read again, once for each cut that they precede.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.kept import keep

from . import regression
from .elasticity import CONTROLS, judged, magnitude_band, prepared, usable_slope, with_reasons

_XS = ["x", *CONTROLS]
_Z = [*_XS, "y"]
_PAIRS = [(i, j) for i in range(len(_Z)) for j in range(i, len(_Z))]


def last_weeks(rows: DataFrame, n: int) -> list[int]:
    """The last n distinct weeks, which are a few numbers."""
    return sorted(r["week"] for r in rows.select("week").distinct().orderBy(F.desc("week")).limit(n).collect())


def _span(cuts: list[int]) -> Column:
    """How many cuts a row comes at or after; it counts for the cuts from that place on."""
    return sum((F.when(F.col("week") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def _running(sums: DataFrame, keys: list[str], totals: dict[str, Column], cuts: list[int]) -> DataFrame:
    """Sums by keys and span as running totals before each cut (column as_of), where keys have any row before."""
    upto = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    following = F.lead("span", 1, len(cuts)).over(Window.partitionBy(*keys).orderBy("span"))
    out = sums.select(*keys, "span", following.alias("__next"), *(c.over(upto).alias(n) for n, c in totals.items()))
    at = F.explode(F.sequence("span", F.col("__next") - 1))
    cut = F.element_at(F.array(*map(F.lit, cuts)), F.col("__at") + 1)
    return out.where("span < __next").withColumn("__at", at).withColumn("as_of", cut.cast("long")).drop("span", "__next", "__at")


def _series_moments(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """(upc, store, as_of, n, m_i, s_i_j): rows, means and Gram matrix within the series before each cut."""
    sums = rows.groupBy("upc", "store", "span").agg(
        F.count("*").alias("n"), *(F.sum(z).alias(f"t_{i}") for i, z in enumerate(_Z)), *(F.sum(F.col(_Z[i]) * F.col(_Z[j])).alias(f"q_{i}_{j}") for i, j in _PAIRS)
    )
    names = ["n", *(f"t_{i}" for i in range(len(_Z))), *(f"q_{i}_{j}" for i, j in _PAIRS)]
    upto = _running(sums, ["upc", "store"], {n: F.sum(n) for n in names}, cuts)
    means = [(F.col(f"t_{i}") / F.col("n")).alias(f"m_{i}") for i in range(len(_Z))]
    grams = [(F.col(f"q_{i}_{j}") - F.col(f"t_{i}") * F.col(f"t_{j}") / F.col("n")).alias(f"s_{i}_{j}") for i, j in _PAIRS]
    return upto.select("upc", "store", "as_of", "n", *means, *grams)


def _histories(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """(as_of, upc) with what was known of the product's rows and prices before each cut. A price or a week is new in
    the span in which it first appears."""
    p = F.col("effective_unit_price")
    by = rows.groupBy("upc", "span").agg(F.count("*").alias("n_rows"), F.sum(p).alias("t"), F.sum(p * p).alias("tt"), F.min(p).alias("low"), F.max(p).alias("high"))
    first = lambda key: rows.groupBy("upc", key).agg(F.min("span").alias("span")).groupBy("upc", "span").agg(F.count("*").alias("new"))
    prices, weeks, stores = (first(c).withColumnRenamed("new", f"new_{n}") for c, n in ((p, "prices"), ("week", "weeks"), ("store", "stores")))
    sums = by.join(prices, ["upc", "span"], "left").join(weeks, ["upc", "span"], "left").join(stores, ["upc", "span"], "left").fillna(0, ["new_prices", "new_weeks", "new_stores"])
    totals = {n: F.sum(n) for n in ("n_rows", "t", "tt")} | {"price_min": F.min("low"), "price_max": F.max("high")}
    totals |= {"n_distinct_prices": F.sum("new_prices"), "n_weeks": F.sum("new_weeks"), "n_stores": F.sum("new_stores")}
    upto, n = _running(sums, ["upc"], totals, cuts), F.col("n_rows")
    spread = F.sqrt(F.greatest(F.col("tt") - F.col("t") * F.col("t") / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
    return upto.withColumn("price_cv", spread / (F.col("t") / n)).drop("t", "tt")


def _fits(rows: DataFrame, moments: DataFrame, cuts: list[int]) -> DataFrame:
    """(as_of, upc) with the controlled slope before each cut and its errors."""
    sums = moments.groupBy("as_of", "upc").agg(F.sum("n").alias("n"), F.count("*").alias("n_stores"), *(F.sum(f"s_{i}_{j}").alias(f"s_{i}_{j}") for i, j in _PAIRS))
    fits = regression.solved(sums, ["as_of", "upc"], _XS).withColumn("fit", F.struct("as_of", "upc"))
    later = F.explode(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c > F.col("week")))
    seen = rows.select("upc", "store", "week", *_Z, later.alias("as_of"))
    means = moments.select("upc", "store", "as_of", *(f"m_{i}" for i in range(len(_Z))))
    own = seen.join(means, ["upc", "store", "as_of"]).select("upc", "store", "week", "as_of", *((F.col(z) - F.col(f"m_{i}")).alias(z) for i, z in enumerate(_Z)))
    scored = own.join(fits.drop("n_obs", "n_stores", "n_kept", "sse", "syy"), ["as_of", "upc"])
    meats = regression._clustered_meats(scored, "fit", regression.score(_XS))
    return regression.with_errors(fits.join(meats, "fit")).select("as_of", "upc", *regression.SLOPE_COLUMNS)


def _pooled(moments: DataFrame) -> dict[int, float]:
    """The slope of all products before each cut: one small matrix a cut."""
    k, out = len(_XS), {}
    for row in moments.groupBy("as_of").agg(*(F.sum(f"s_{i}_{j}").alias(f"s_{i}_{j}") for i, j in _PAIRS)).collect():
        gram = regression._gram(row, k + 1)
        kept = regression.independent(gram[:k, :k])
        if kept and kept[0] == 0:
            out[row["as_of"]] = float(np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, k])[0])
    return out


def tables_as_of(panel: DataFrame, cuts: list[int], config: Config | None = None) -> DataFrame:
    """(as_of, upc, ...): for each cut the elasticity table of the rows before it, as elasticity_table makes it of
    those rows alone, with the pooled slope of the cut beside it. Products without a row before a cut are not in
    its table; a cut with no row before it, or whose rows have no price variation, has no table. Stored."""
    config, cuts = config or Config(), sorted(set(map(int, cuts)))
    if not cuts:
        raise ValueError("no week to stand at")
    # means over all weeks are taken out first: they cancel below, and sums of small numbers lose no digits
    rows = regression.within(prepared(panel), _Z, ["upc", "store"]).withColumn("span", _span(cuts)).where(F.col("span") < len(cuts))
    kept = keep(rows, "rows-before")
    moments = keep(_series_moments(kept.rows, cuts), "moments")
    pooled = _pooled(moments.rows)
    judged_ = keep(judged(_histories(kept.rows, cuts), _fits(kept.rows, moments.rows, cuts).drop("n_obs"), ["as_of", "upc"], config).withColumn("usable", F.coalesce(usable_slope(config), F.lit(False))), "estimates")
    spreads = [(c, slope, (regression.dispersion(judged_.rows.where((F.col("as_of") == c) & F.col("usable"))) or (0.0, slope))[0]) for c, slope in sorted(pooled.items())]
    facts = panel.sparkSession.createDataFrame(spreads, "as_of long, pooled double, tau2 double")
    found = regression.weighed(judged_.rows.join(F.broadcast(facts), "as_of"), F.col("tau2"), F.col("pooled"), magnitude_band(config))
    out = keep(with_reasons(found).drop("tau2"), "tables-as-of")
    for used in (kept, moments, judged_):
        used.drop()
    return out.rows


def attach_as_of(contexts: DataFrame, tables: DataFrame, config: Config | None = None) -> DataFrame:
    """Contexts of several weeks with elasticity and elasticity_source of their own week's table; a product it lacks
    takes the week's pooled slope within the band, and a week without a table has none and is left out."""
    low, high = magnitude_band(config or Config())
    own = tables.select(F.col("as_of").alias("week"), "upc", F.col("elasticity_final").alias("__e"), F.col("elasticity_source").alias("__s"))
    every = tables.groupBy(F.col("as_of").alias("week")).agg((-F.least(F.greatest(F.abs(F.first("pooled")), F.lit(low)), F.lit(high))).alias("__pooled"))
    rest = contexts.drop("elasticity", "elasticity_source").join(F.broadcast(every), "week").join(own, ["week", "upc"], "left")
    return rest.withColumns({"elasticity": F.coalesce("__e", "__pooled"), "elasticity_source": F.coalesce("__s", F.lit("pooled_fallback"))}).drop("__e", "__s", "__pooled")


def weekly_scores(scores: DataFrame) -> DataFrame:
    """By week and policy: contexts, units, revenue, profit, mean price, and how the prices differ from the current ones.
    Medians are of one week's contexts of one policy, by approximate percentiles."""
    change = F.col("price") / F.col("current_price") - 1
    outside = (F.col("price") < F.col("price_min") - 1e-9) | (F.col("price") > F.col("price_max") + 1e-9)
    return scores.groupBy("week", "policy").agg(
        F.count("*").alias("n"), F.sum("units").alias("units"), F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.avg("price").alias("mean_price"),
        F.avg((F.abs(change) < 1e-9).cast("int")).alias("share_no_change"), F.percentile_approx(F.abs(change), 0.5, 10_000).alias("median_abs_change"),
        F.avg(F.coalesce(outside, F.lit(False)).cast("int")).alias("share_outside_support"),
    )
