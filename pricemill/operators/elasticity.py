"""The elasticity table: a controlled slope for each product, screened, shrunk towards the pooled slope, and
looked up by the decisions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.kept import keep
from pricemill.functions.ranges import quantiles

from . import regression
from .features import with_seasonality

CONTROLS = ["promotion", "sin_week", "cos_week", "trend"]
_SERIES = ["upc", "store"]


@dataclass(frozen=True)
class ElasticityTable:
    """products: one row a product (see elasticity_table); pooled: the slope for all others, within the band;
    facts: where both come from."""

    products: DataFrame | None
    pooled: float
    facts: dict

    def attach(self, contexts: DataFrame) -> DataFrame:
        """contexts with elasticity and elasticity_source by product; pooled for products the table lacks."""
        rest = contexts.drop("elasticity", "elasticity_source")
        if self.products is None:
            return rest.withColumns({"elasticity": F.lit(self.pooled), "elasticity_source": F.lit(self.facts.get("kind", "pooled"))})
        own = self.products.select("upc", F.col("elasticity_final").alias("__e"), F.col("elasticity_source").alias("__s"))
        out = rest.join(own, "upc", "left")
        return out.withColumns({"elasticity": F.coalesce("__e", F.lit(self.pooled)), "elasticity_source": F.coalesce("__s", F.lit("pooled_fallback"))}).drop("__e", "__s")


def fixed(elasticity: float) -> ElasticityTable:
    """The same elasticity for every product: a scenario, no estimate."""
    return ElasticityTable(None, float(elasticity), {"kind": "fixed_scenario", "elasticity": float(elasticity)})


def pooled(elasticity: float) -> ElasticityTable:
    return ElasticityTable(None, float(elasticity), {"kind": "pooled", "elasticity": float(elasticity)})


def prepared(train: DataFrame) -> DataFrame:
    """Rows with log price x, log units y and the controls; zero units are dropped."""
    rows = with_seasonality(regression.loglog(train)).withColumn("promotion", F.col("recorded_promotion_flag").cast("double"))
    return rows.select("upc", "store", "week", "effective_unit_price", "x", "y", *CONTROLS)


def centred(train: DataFrame) -> DataFrame:
    """prepared rows with the means over their series taken out of x, y and the controls."""
    return regression.within(prepared(train), ["x", "y", *CONTROLS], _SERIES)


def _estimates(rows: DataFrame, config: Config) -> DataFrame:
    p = F.col("effective_unit_price")
    history = rows.groupBy("upc").agg(
        F.count("*").alias("n_rows"), F.countDistinct(p).alias("n_distinct_prices"), F.countDistinct("store").alias("n_stores"), F.countDistinct("week").alias("n_weeks"),
        (F.stddev_samp(p) / F.avg(p)).alias("price_cv"), F.min(p).alias("price_min"), F.max(p).alias("price_max"),
    )
    fits = regression.controlled_slopes(rows, "upc", CONTROLS).drop("n_obs")
    return judged(history, fits, ["upc"], config)


def judged(history: DataFrame, fits: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """Histories (n_rows, n_distinct_prices, ...) and fits by keys as estimates: no slope where there are too few rows or
    prices, and the reason where there is none."""
    e = config["elasticity"]
    enough = (F.col("n_rows") >= e["min_obs_per_upc"]) & (F.col("n_distinct_prices") >= e["min_distinct_prices_per_upc"])
    out = history.withColumn("enough", enough).join(fits, keys, "left")
    numbers = ["estimate", "std_error_hc1", "std_error_store", "std_error_week", "std_error", "r_squared"]
    out = out.withColumns({c: F.when(F.col("enough"), F.col(c)) for c in numbers})
    b, se = F.col("estimate"), F.col("std_error")
    reason = (
        F.when(~F.col("enough"), "insufficient_observations_or_price_variation").when(b.isNull(), "no_price_variation_after_fixed_effects")
        .when(~F.coalesce(se > 0, F.lit(False)), "standard_error_not_computable").otherwise("")
    )
    t = b / F.nullif(se, F.lit(0.0))
    return out.withColumn("reject_reason", reason).withColumns({
        "se_inflation_vs_hc1": se / F.nullif("std_error_hc1", F.lit(0.0)), "t_stat": t, "ci_low": b - 1.96 * se, "ci_high": b + 1.96 * se,
        "significant_negative": F.coalesce((b < 0) & (t < -1.96), F.lit(False)),
    }).withColumnRenamed("n_rows", "n_obs").drop("enough")


def product_estimates(train: DataFrame, config: Config | None = None) -> DataFrame:
    """One row a product: its history, the controlled slope within its stores with its errors, interval and t,
    and reject_reason, empty where there is a slope. No slope is tried with too few rows or prices. Stored, as the
    audits below read it many times."""
    rows = centred(train).persist()
    try:
        return keep(_estimates(rows, config or Config()), "estimates").rows
    finally:
        rows.unpersist()


def magnitude_band(config: Config) -> tuple[float, float]:
    r = config["pricing_response"]
    return float(r["min_abs_elasticity"]), float(r["max_abs_elasticity"])


def usable_slope(config: Config) -> Column:
    """Whether an estimate is precise and of the right sign."""
    precise = F.col("std_error") <= float(config["elasticity"]["max_se_for_product_estimate"])
    return (F.col("reject_reason") == "") & precise & (F.col("estimate") < 0)


def with_reasons(found: DataFrame) -> DataFrame:
    """Shrunk estimates with the reason of those that are not usable."""
    own = F.when(F.col("estimate") >= 0, "wrong_sign").otherwise("standard_error_too_large")
    return found.withColumn("reject_reason", F.when((F.col("reject_reason") == "") & ~F.col("usable"), own).otherwise(F.col("reject_reason")))


def elasticity_table(train: DataFrame, config: Config | None = None, weeks: tuple[int, int] | None = None) -> ElasticityTable:
    """The table of training rows. Slopes that are imprecise or of the wrong sign take the pooled one; the
    others are shrunk towards it. facts names the weeks that the rows come from. The rows are kept only
    while the table is made; what stays is a stored table of one row a product."""
    config = config or Config()
    band = magnitude_band(config)
    rows = centred(train).persist()
    try:
        fit = regression.Fit(rows, "y", ["x", *CONTROLS])
        slope = float(fit.beta[0])
        products = keep(_estimates(rows, config), "estimates").rows
        found = with_reasons(regression.shrunk(products, slope, band=band, usable=usable_slope(config)))
    finally:
        rows.unpersist()
    facts = {"kind": "shrunk", "pooled": slope, "rows": fit.n, "weeks": weeks, "band": band}
    return ElasticityTable(found, -min(max(abs(slope), band[0]), band[1]), facts)


# The variants of the shrinkage audit.
VARIANTS = {
    "moment, free prior, HC1": ("std_error_hc1", "moment", "estimated", True), "moment, pooled prior, HC1": ("std_error_hc1", "moment", "pooled", True),
    "REML, pooled prior, HC1": ("std_error_hc1", "reml", "pooled", True), "moment, pooled prior, robust": ("std_error", "moment", "pooled", True),
    "REML, pooled prior, robust": ("std_error", "reml", "pooled", True), "REML, pooled prior, robust, unfiltered": ("std_error", "reml", "pooled", False),
    "REML, free prior, robust": ("std_error", "reml", "estimated", True),
}


def shrinkage_variants(products: DataFrame, slope: float, max_error: float = 1.5) -> DataFrame:
    """(variant, n, tau2, prior_mean, mean_weight, median_shrunk, p10_shrunk, p90_shrunk) of each way to shrink the
    slopes of product_estimates."""
    kept = products.where("reject_reason = ''")
    fine = kept.where((F.col("std_error") <= max_error) & (F.col("estimate") < 0))
    out = None
    for name, (error, method, prior, filtered) in VARIANTS.items():
        own = (fine if filtered else kept).select("estimate", F.col(error).alias("std_error"))
        tau2, free = regression.dispersion(own, method) or (0.0, slope)
        mean = free if prior == "estimated" else slope
        w = F.lit(tau2) / F.nullif(F.lit(tau2) + F.col("std_error") ** 2, F.lit(0.0))
        q = lambda x: F.percentile("value", F.lit(x))
        one = own.withColumn("w", F.coalesce(w, F.lit(0.0))).withColumn("value", F.col("w") * F.col("estimate") + (1 - F.col("w")) * mean).agg(
            F.count("*").alias("n"), F.lit(tau2).alias("tau2"), F.lit(mean).alias("prior_mean"), F.avg("w").alias("mean_weight"), q(0.5).alias("median_shrunk"), q(0.1).alias("p10_shrunk"), q(0.9).alias("p90_shrunk"),
        ).select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def weight_bands(products: DataFrame) -> DataFrame:
    """(band, n) of the weights of usable products; a band holds its upper edge."""
    w, edges = F.col("shrinkage_weight"), [(0.25, "<0.25"), (0.5, "0.25-0.5"), (0.75, "0.5-0.75"), (0.9, "0.75-0.9"), (0.99, "0.9-0.99")]
    band = F.lit(">0.99")
    for top, name in reversed(edges):
        band = F.when(w <= top, name).otherwise(band)
    return products.where("usable").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def error_ratios(products: DataFrame) -> DataFrame:
    """By product with a slope (estimate, std_error_hc1, _store and _week of product_estimates or regression.slopes): the larger
    clustered error as std_error_clustered, each as a ratio to HC1, and whether the slope differs from zero at 1.96 errors by
    either. An error of zero gives no ratio and no test; a product of one store has no error by store."""
    b, hc1 = F.abs("estimate"), F.nullif("std_error_hc1", F.lit(0.0))
    out = products.where("estimate is not null").withColumn("std_error_clustered", F.greatest("std_error_store", "std_error_week"))
    ratios = {f"ratio_{k}": F.col(f"std_error_{k}") / hc1 for k in ("store", "week", "clustered")}
    tests = {f"significant_{k}": (b / F.nullif(f"std_error_{k}", F.lit(0.0)) > 1.96).cast("double") for k in ("hc1", "clustered")}
    errors = [f"std_error_{k}" for k in ("hc1", "store", "week", "clustered")]
    return out.withColumns(ratios | tests).select("upc", "n_obs", "estimate", *errors, *ratios, *tests)


def error_summary(ratios: DataFrame) -> DataFrame:
    """(statistic, n, mean, median, p90): each column of error_ratios over the products that have it; the mean of significant_*
    is the share of significant slopes. A statistic that no product has gives no row."""
    names = [c for c in ratios.columns if c.startswith(("std_error_", "ratio_", "significant_"))]
    pairs = F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in names))
    rows = keep(ratios.select(F.inline(pairs)).where("value is not null"), "errors").rows
    means = rows.groupBy("statistic").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return means.join(quantiles(rows, "statistic", "value", {"median": 0.5, "p90": 0.9}), "statistic")


def inference(fit: regression.Fit, one_way: dict[str, list[str]], two_way: tuple[str, str] | None = None) -> pd.DataFrame:
    """The first coefficient under each assumption on the errors, with t intervals and the ratio of each error to
    the classical one."""
    kinds = {"classical": fit.classical(), "hc1": fit.hc1()} | {f"cluster_{k}": fit.clustered(v) for k, v in one_way.items()}
    if two_way:
        kinds["two_way"] = fit.two_way(*two_way)
    frame = pd.concat([fit.summary(k, v).iloc[:1] for k, v in kinds.items()], ignore_index=True)
    return frame.assign(t_stat=frame.estimate / frame.std_error, ratio_to_classical=frame.std_error / frame.std_error.iloc[0])
