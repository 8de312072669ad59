"""How demand answers a price: the fitted model itself, or its level at the current price times a constant
elasticity; and how the answers of these methods differ."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.functions.columns import money, ratio

from . import decisions
from .elasticity import ElasticityTable
from .features import price_features
from .models import MODEL_INPUTS, DemandModel

KEYS = ["upc", "store", "week"]
#: What price features are made from; a context keeps it, so that a candidate price can be put in.
_ANCHORS = ["lag_price_1", "series_reference_price", "roll_mean_price_4"]


def with_reference_price(rows: DataFrame, price: Column | None = None) -> DataFrame:
    """rows with the price that is charged now, before any candidate takes its place."""
    return rows.withColumn("reference_price", F.col("effective_unit_price") if price is None else price)


def at_price(rows: DataFrame, price: Column) -> DataFrame:
    """rows as if the price were another, with the features that hang on it."""
    return rows.withColumn("effective_unit_price", price).withColumns(price_features(F.col("effective_unit_price")))


class PriceResponse:
    """Demand of a fitted model with a method: "ml" (the model's own response), "pooled" or "shrunk"."""

    def __init__(self, model: DemandModel, method: str = "shrunk", table: ElasticityTable | None = None):
        if method not in ("ml", "pooled", "shrunk"):
            raise ValueError(f"no method {method}")
        if method != "ml" and table is None:
            raise ValueError(f"the method {method} takes an elasticity table")
        self.model, self.method, self.table = model, method, table

    def _attached(self, rows: DataFrame) -> DataFrame:
        if self.method == "ml":
            return rows.withColumns({"elasticity": F.lit(None).cast("double"), "elasticity_source": F.lit("ml_native")})
        if self.method == "pooled":
            return rows.withColumns({"elasticity": F.lit(self.table.pooled), "elasticity_source": F.lit("pooled")})
        return self.table.attach(rows)

    def predict(self, rows: DataFrame, column: str = "predicted") -> DataFrame:
        """Units at effective_unit_price. Other methods than ml take the model's units at reference_price, which
        must be positive, times (price / reference_price) ** elasticity, up to the model's largest value."""
        if self.method == "ml":
            return self.model.predict(rows, column)
        if "reference_price" not in rows.columns:
            raise ValueError("the rows lack reference_price")
        p0 = F.when(F.col("reference_price") > 0, F.col("reference_price")).otherwise(F.raise_error(F.lit("reference_price must be positive")).cast("double"))
        priced = rows.withColumns({"__price": F.col("effective_unit_price"), "__p0": p0})
        out = self._attached(self.model.predict(at_price(priced, F.col("__p0")), "__level"))
        units = F.col("__level") * F.pow(F.col("__price") / F.col("__p0"), F.col("elasticity"))
        return out.withColumn("effective_unit_price", F.col("__price")).withColumns(price_features(F.col("__price"))).select(
            *rows.columns, F.least(F.greatest(units, F.lit(0.0)), F.lit(float(self.model.top))).alias(column))

    def contexts(self, rows: DataFrame) -> DataFrame:
        """Decision contexts of feature rows with statistics of their series: the level of demand is the model's at
        the current price. For the model's own response they keep what the model reads."""
        found = self._attached(self.model.predict(rows, "base_units")).withColumn("prediction_cap", F.lit(float(self.model.top)))
        kept = [c for c in dict.fromkeys([*MODEL_INPUTS, *_ANCHORS]) if c not in KEYS] if self.method == "ml" else []
        return found.select(
            *KEYS, F.col("effective_unit_price").alias("current_price"), F.col("decision_time_unit_cost").alias("unit_cost"), "base_units", "elasticity", "elasticity_source",
            "n_obs", "n_distinct_prices", "price_cv", "price_min", "price_max", "prediction_cap", *kept,
        )

    def simulate(self, df: DataFrame) -> DataFrame:
        """candidates (price, units) of the grid of each context, as decisions.recommend asks for. The model's own
        response takes a row a candidate; a context has as many as its grid."""
        if self.method != "ml":
            return decisions.constant_elasticity(df)
        kept = [c for c in dict.fromkeys([*MODEL_INPUTS, *_ANCHORS]) if c not in KEYS]
        rows = df.select(*KEYS, *kept, F.explode("grid").alias("__price"))
        rows = self.model.predict(at_price(rows, F.col("__price")), "__units")
        by = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col("__price").alias("price"), F.col("__units").alias("units")))).alias("candidates"))
        return df.join(by, KEYS, "left")

    def recommend(self, rows: DataFrame, profile: str = "standard", config=None) -> DataFrame:
        return decisions.recommend(self.contexts(rows), profile, config, simulator=self.simulate)


def disagreement(found: dict[str, DataFrame]) -> DataFrame:
    """(pair, ...) of the recommendations of several methods: how far their proposed prices lie apart, and how often
    they agree."""
    columns = ["current_price", "decision", "proposed_price"]
    joined = None
    for name, df in found.items():
        own = df.select(*KEYS, *(F.col(c).alias(f"{name}_{c}") for c in columns))
        joined = own if joined is None else joined.join(own, KEYS)
    rows = []
    for a, b in combinations(found, 2):
        gap, p = F.col(f"{a}_proposed_price") - F.col(f"{b}_proposed_price"), F.col(f"{a}_current_price")
        acts = (F.col(f"{a}_decision") == "RECOMMEND_CHANGE") & (F.col(f"{b}_decision") == "RECOMMEND_CHANGE")
        apart = F.signum(F.col(f"{a}_proposed_price") - p) * F.signum(F.col(f"{b}_proposed_price") - p) < 0
        rows.append(F.struct(
            F.lit(f"{a} vs {b}").alias("pair"), F.abs(gap).alias("gap"), F.abs(gap / p).alias("relative"), (F.col(f"{a}_decision") == F.col(f"{b}_decision")).cast("int").alias("same"),
            (acts & apart).cast("int").alias("opposite"), F.col(f"{a}_proposed_price").alias("pa"), F.col(f"{b}_proposed_price").alias("pb"),
        ))
    long = joined.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    q = lambda x: F.percentile("gap", F.lit(x))
    return long.groupBy("pair").agg(
        F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), q(0.5).alias("median_gap"), q(0.9).alias("p90_gap"), F.avg("relative").alias("mean_relative_gap"),
        F.avg((F.col("gap") < 1e-9).cast("int")).alias("share_same_price"), F.avg("same").alias("share_same_decision"), F.avg("opposite").alias("share_opposite"), F.corr("pa", "pb").alias("correlation"),
    )


def by_method(found: dict[str, DataFrame]) -> DataFrame:
    """(method, ...): shares of decisions, and the changes of the actionable ones."""
    out = None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("method"), "decision", "proposed_price", "current_price", "model_internal_estimated_uplift")
        out = one if out is None else out.unionByName(one)
    act = F.col("decision") == "RECOMMEND_CHANGE"
    change = F.when(act, F.col("proposed_price") / F.col("current_price") - 1)
    share = lambda k: F.avg((F.col("decision") == k).cast("int"))
    return out.groupBy("method").agg(
        F.count("*").alias("n"), share("RECOMMEND_CHANGE").alias("share_actionable"), share("KEEP_CURRENT").alias("share_keep"), share("REVIEW_REQUIRED").alias("share_review"),
        F.coalesce(F.percentile(change, F.lit(0.5)), F.lit(0.0)).alias("median_change"), F.coalesce(F.avg((change > 0).cast("int")), F.lit(0.0)).alias("share_increases"),
        F.coalesce(F.percentile(F.when(act, F.col("model_internal_estimated_uplift")), F.lit(0.5)), F.lit(0.0)).alias("median_uplift"), F.avg("proposed_price").alias("mean_price"),
    )


def sweep_grid(price: Column, reach: float, points: int) -> Column:
    """Distinct positive prices by cents, evenly from price * (1 - reach) to price * (1 + reach)."""
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: money(price * ((1 - reach) + i * (2 * reach / (points - 1)))))
    return F.array_sort(F.array_distinct(F.filter(at, lambda p: p > 0)))


def sweep(contexts: DataFrame, simulator: decisions.Simulator = decisions.constant_elasticity, reach: float = 0.3, points: int = 25) -> DataFrame:
    """One row a context: how demand runs over the sweep, the local elasticity in the middle, whether the sweep leaves
    the range of prices seen, and the best prices by profit and by revenue."""
    df = simulator(contexts.withColumn("grid", sweep_grid(F.col("current_price"), reach, points)))
    df = decisions._settled(decisions.curve_diagnostics(df))
    c = F.col("candidates")
    local = F.zip_with(F.slice(c, 2, F.size(c)), F.slice(c, 1, F.size(c) - 1), lambda b, a: ratio(F.log(b.units + 1e-9) - F.log(a.units + 1e-9), F.log(b.price) - F.log(a.price)))
    value = lambda of: F.transform(c, lambda s: F.struct(of(s).alias("v"), (-s.price).alias("p")))
    best = lambda of: -F.array_max(F.filter(value(of), lambda s: s.v.isNotNull())).p
    middle = F.array_sort(F.filter(local, lambda e: e.isNotNull()))
    half = F.floor((F.size(middle) - 1) / 2).cast("int")
    other = F.floor(F.size(middle) / 2).cast("int")
    return df.select(
        *KEYS, "current_price", "share_rising", "monotone", "relative_span", "flat", ((F.get(middle, half) + F.get(middle, other)) / 2).alias("local_elasticity"),
        (F.array_min("grid") < F.col("price_min")).alias("low_outside"), (F.array_max("grid") > F.col("price_max")).alias("high_outside"),
        best(lambda s: (s.price - F.col("unit_cost")) * s.units).alias("profit_optimum"), best(lambda s: s.price * s.units).alias("revenue_optimum"),
    )


def sweep_summary(rows: DataFrame, reach: float = 0.3) -> DataFrame:
    p, best = F.col("current_price"), F.col("profit_optimum")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    edge = (best <= p * (1 - reach) + 0.005 + 1e-6) | (best >= p * (1 + reach) - 0.005 - 1e-6)
    return rows.agg(
        F.count("*").alias("n_contexts"), share(F.col("monotone")).alias("share_monotone"), share(F.col("share_rising") > 0).alias("share_with_rise"), share(F.col("flat")).alias("share_flat"),
        F.percentile("local_elasticity", F.lit(0.5)).alias("median_local_elasticity"), F.percentile("relative_span", F.lit(0.5)).alias("median_span"),
        share(best < p).alias("share_profit_below"), share(edge).alias("share_profit_at_edge"), share(F.col("revenue_optimum") < p).alias("share_revenue_below"),
    )
