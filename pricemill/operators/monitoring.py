"""Drift, performance over time, and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.kept import keep
from pricemill.functions.ranges import counted_quantiles, running_totals

from .models import metric_columns


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {cells}) as (feature, value)").where("value is not null")


def value_counts(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, r, c), stored: how often each value comes in the reference and in the current period. Everything that
    is asked of both periods is taken from this table, so their rows are read once."""
    both = _long(reference, columns).withColumn("side", F.lit(1)).unionByName(_long(current, columns).withColumn("side", F.lit(0)))
    return keep(both.groupBy("feature", "value").agg(F.sum("side").alias("r"), F.sum(1 - F.col("side")).alias("c")), "counts").rows


def _psi(counts: DataFrame, bins: int) -> DataFrame:
    cuts = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = counted_quantiles(counts, "feature", "value", "r", cuts).select("feature", F.array_distinct(F.array(*cuts)).alias("edges"))
    # a value's bin is the number of inner edges that it exceeds
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    bin_of = F.size(F.filter(inner, lambda e: F.col("value") > e))
    found = counts.join(F.broadcast(edges), "feature").groupBy("feature", bin_of.alias("bin"), F.size("edges").alias("n_edges")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    total = lambda c: F.sum(c).over(Window.partitionBy("feature"))
    share = lambda c: F.greatest(F.col(c) / F.nullif(total(c), F.lit(0)), F.lit(1e-6))
    term = (share("c") - share("r")) * F.log(share("c") / share("r"))
    return found.withColumn("term", term).groupBy("feature").agg(F.when(F.max("n_edges") >= 3, F.sum("term")).otherwise(F.lit(0.0)).alias("psi"))


def psi(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Population stability index by feature, over bins between the reference's quantiles; 0 where fewer than
    three distinct edges remain. The edges are a few numbers a feature."""
    return _psi(value_counts(reference, current, columns), bins)


def _ks(counts: DataFrame) -> DataFrame:
    upto = running_totals(counts, F.col("value"), [F.col("value")], {"__r": F.col("r"), "__c": F.col("c")}, by=("feature",))
    whole = counts.groupBy("feature").agg(F.sum("r").alias("__n"), F.sum("c").alias("__m"))
    part = lambda c, n: F.col(c) / F.nullif(F.col(n), F.lit(0))
    gap = F.abs(part("__r", "__n") - part("__c", "__m"))
    return upto.join(F.broadcast(whole), "feature").groupBy("feature").agg(F.max(gap).alias("ks"))


def ks(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance by feature; values are counted before the running sums."""
    return _ks(value_counts(reference, current, columns))


def _moments(counts: DataFrame) -> DataFrame:
    """By feature the mean and the share of values that are not positive, in both periods."""
    both = {"reference": "r", "current": "c"}
    mean = {f"{n}_mean": F.sum(F.col("value") * F.col(c)) / F.nullif(F.sum(c), F.lit(0)) for n, c in both.items()}
    zero = {f"{n}_share_zero": F.sum(F.when(F.col("value") <= 0, F.col(c)).otherwise(F.lit(0))) / F.nullif(F.sum(c), F.lit(0)) for n, c in both.items()}
    return counts.groupBy("feature").agg(*(v.alias(k) for k, v in (mean | zero).items()))


def _drift(counts: DataFrame, config: Config | None, bins: int) -> DataFrame:
    # a feature that a period lacks has no mean there, and is left out
    means = _moments(counts).where("reference_mean is not null and current_mean is not null")
    out = _psi(counts, bins).join(_ks(counts), "feature").join(means, "feature")
    rank = F.row_number().over(Window.orderBy(F.desc("psi"), "feature"))  # one row a feature
    return out.withColumns({"band": band(F.col("psi"), config or Config()), "drift_rank": rank})


def feature_drift(reference: DataFrame, current: DataFrame, columns: list[str], config: Config | None = None, bins: int = 10) -> DataFrame:
    """(feature, psi, ks, reference_mean, current_mean, band, drift_rank): rank 1 drifts most."""
    return _drift(value_counts(reference, current, columns), config, bins).drop("reference_share_zero", "current_share_zero")


def prediction_drift(reference: DataFrame, current: DataFrame, column: str, config: Config | None = None, bins: int = 10) -> DataFrame:
    """feature_drift of predictions, with their 95th percentiles and shares of zero in both periods."""
    counts = value_counts(reference, current, [column])
    out = _drift(counts, config, bins)
    for name, c in (("reference", "r"), ("current", "c")):
        out = out.join(counted_quantiles(counts, "feature", "value", c, {f"{name}_p95": 0.95}), "feature")
    return out


def schema_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(column, found_type, passed, null_share) of each expected column and the type its name must begin with."""
    found = dict(df.dtypes)
    there = [c for c in expected if c in found]
    rows = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in there))
    share = lambda c: (F.col(c) / F.nullif("__n", F.lit(0))) if c in found else F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias("column"), F.lit(found.get(c)).alias("found_type"), F.lit(found.get(c, "").startswith(t)).alias("passed"), share(c).alias("null_share")) for c, t in expected.items()]
    return rows.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def band(value, config: Config):
    b = config["monitoring.psi_bands"]
    return F.when(value < b["stable_below"], "stable").when(value < b["moderate_below"], "moderate").otherwise("large")


def performance(forecasts: DataFrame) -> DataFrame:
    """Metrics of (year, quarter, actual, predicted) by period."""
    period = F.concat(F.col("year").cast("string"), F.lit("Q"), F.col("quarter").cast("string"))
    return forecasts.groupBy(period.alias("period")).agg(*(v.alias(k) for k, v in metric_columns(F.col("actual"), F.col("predicted")).items()))


def alerts(drift: DataFrame, periods: DataFrame, config: Config | None = None) -> DataFrame:
    """(kind, subject, value, threshold) of what exceeds its threshold."""
    a = (config or Config())["monitoring.alerts"]
    out = drift.where(F.col("psi") >= a["psi_alert"]).select(F.lit("psi").alias("kind"), F.col("feature").alias("subject"), F.col("psi").alias("value"), F.lit(a["psi_alert"]).alias("threshold"))
    for kind, value, limit in (("wape", F.col("wape"), a["wape_alert"]), ("bias", F.abs("bias"), a["bias_abs_alert"])):
        out = out.unionByName(periods.where(value >= limit).select(F.lit(kind).alias("kind"), F.col("period").alias("subject"), value.alias("value"), F.lit(limit).alias("threshold")))
    return out
