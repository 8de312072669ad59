"""Demand baselines, the ridge, Poisson and boosted models, their metrics, and how a model is chosen and kept."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.functions.kept import keep

from .boosting import PoissonTrees

BASELINES = ("last_week", "rolling_mean_4", "series_mean", "seasonal_naive")


def with_baselines(df: DataFrame, train: DataFrame) -> DataFrame:
    """Naive forecasts of a feature table; series means come from train, the season from 52 weeks back."""
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    means = train.groupBy("upc", "store").agg(F.avg("move").alias("__mean"))
    overall = train.agg(F.avg("move").alias("__overall"))
    back = df.select("upc", "store", (F.col("week") + 52).alias("week"), F.col("move").alias("__back"))
    out = df.join(means, ["upc", "store"], "left").join(back, ["upc", "store", "week"], "left").crossJoin(F.broadcast(overall))
    rolling = F.coalesce("roll_mean_move_4", "lag_move_1")
    return out.withColumns({
        "pred_last_week": floor(F.col("lag_move_1")), "pred_rolling_mean_4": floor(rolling), "pred_series_mean": floor(F.coalesce("__mean", "__overall")),
        "pred_seasonal_naive": floor(F.coalesce(F.col("__back"), rolling)),
    }).drop("__mean", "__back", "__overall")


def metric_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    error = predicted - actual
    scale = F.abs(actual) + F.abs(predicted)
    return {
        "n": F.count(actual), "mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "wape": F.sum(F.abs(error)) / F.nullif(F.sum(F.abs(actual)), F.lit(0.0)),
        "bias": F.avg(error), "smape": F.avg(F.when(scale > 0, 2 * F.abs(error) / F.nullif(scale, F.lit(0.0)))),
    }


def long_forecasts(df: DataFrame, names: tuple[str, ...] = BASELINES) -> DataFrame:
    """One row a forecast: the keys, model, actual and predicted."""
    cells = ", ".join(f"'{n}', pred_{n}" for n in names)
    return df.selectExpr("upc", "store", "week", "move as actual", f"stack({len(names)}, {cells}) as (model, predicted)")


def evaluate(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of (actual, predicted) by keys."""
    return forecasts.groupBy(*keys).agg(*(v.alias(k) for k, v in metric_columns(F.col("actual"), F.col("predicted")).items()))


_LOGGED = ["lag_move_1", "lag_move_2", "lag_move_3", "lag_move_4", "roll_mean_move_4", "roll_mean_move_8", "roll_mean_move_13", "roll_std_move_4"]
_PRIOR = "upc_demand_prior"
_PLAIN = [_PRIOR, "package_size_oz", "log_price", "price_vs_lag", "price_vs_reference", "price_vs_roll_mean", "recorded_promotion_flag", "lag_promotion_1", "sin_week", "cos_week", "series_age_weeks"]
_CATEGORIES = ["upc", "store"]
#: What a model reads of a row, beside the demand prior, which it adds itself.
MODEL_INPUTS = [*_LOGGED, *(c for c in _PLAIN if c != _PRIOR), *_CATEGORIES]
FAMILIES = ("ridge", "poisson", "boosted")
#: Weight of the overall mean in a product's demand prior, in rows.
PRIOR_ROWS = 50


def demand_prior(train: DataFrame) -> DataFrame:
    """(upc, upc_demand_prior): the mean of log1p units of a product, drawn to that of all rows."""
    y = F.log1p("move")
    overall = train.agg(F.avg(y).alias("__all"))
    by = train.groupBy("upc").agg(F.sum(y).alias("__sum"), F.count("*").alias("__n")).join(F.broadcast(overall))
    return by.select("upc", ((F.col("__sum") + PRIOR_ROWS * F.col("__all")) / (F.col("__n") + PRIOR_ROWS)).alias(_PRIOR))


class DemandModel:
    """Demand from the features: a ridge on log1p units, a Poisson regression with a log link, or boosted
    trees with a Poisson loss (see PoissonTrees; boosting has its settings).

    For the regressions numeric gaps take the training median and are scaled by the training mean and population
    standard deviation; a level of a category that training has not seen, or in fewer than min_frequency rows,
    adds nothing. Trees take the numbers as they are, gaps as a bin of their own and levels as categories. A
    product's demand prior is one of the numbers. Predictions lie between 0 and five times the largest
    training value.
    """

    def __init__(self, family: str = "ridge", alpha: float = 1.0, min_frequency: int = 50, boosting: dict | None = None):
        if family not in FAMILIES:
            raise ValueError(f"no model family {family}")
        self.family, self.alpha, self.min_frequency, self.boosting = family, alpha, min_frequency, dict(boosting or {})
        self.pipeline: PipelineModel | None = None
        self.trees: PoissonTrees | None = None
        self.prior: DataFrame | None = None

    def _prepared(self, df: DataFrame) -> DataFrame:
        if missing := sorted(set(MODEL_INPUTS) - set(df.columns)):
            raise ValueError(f"the table lacks {', '.join(missing)}")
        df = df.drop(_PRIOR).join(self.prior, "upc", "left").withColumn(_PRIOR, F.coalesce(_PRIOR, F.lit(self.overall)))
        logged = {c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in _LOGGED}
        plain = {c: F.col(c).cast("double") for c in _PLAIN}
        return df.withColumns({f"__{c}": v for c, v in (logged | plain).items()}).withColumns({f"__{c}": F.col(c).cast("string") for c in _CATEGORIES})

    def _scaled(self, df: DataFrame) -> DataFrame:
        numbers = [*_LOGGED, *_PLAIN]
        return self._prepared(df).withColumns({f"__{c}": (F.coalesce(F.col(f"__{c}"), F.lit(m)) - mean) / (sd or 1.0) for c, (m, mean, sd) in zip(numbers, self.scales)})

    def fit(self, train: DataFrame) -> DemandModel:
        """Fits the rows, which are kept while they are read over and over."""
        kept = train.select(*(c for c in dict.fromkeys([*MODEL_INPUTS, "move"]) if c in train.columns)).persist()
        try:
            return self._fitted(kept)
        finally:
            kept.unpersist()

    def _fitted(self, train: DataFrame) -> DemandModel:
        numbers = [*_LOGGED, *_PLAIN]
        prior = keep(demand_prior(train), "prior").rows  # one row a product, read again by every prediction
        self.prior, self.overall = prior, train.agg(F.avg(F.log1p("move"))).first()[0]
        raw = self._prepared(train)
        if self.family == "boosted":
            self.top = 5 * train.agg(F.max("move")).first()[0]
            self.trees = PoissonTrees(**self.boosting).fit(raw, [f"__{c}" for c in numbers], [f"__{c}" for c in _CATEGORIES], "move")
            return self
        medians = raw.agg(*(F.percentile(f"__{c}", F.lit(0.5)).alias(c) for c in numbers)).first()  # prices by cents, units by ones
        filled = raw.select(*(F.coalesce(F.col(f"__{c}"), F.lit(medians[c] or 0.0)).alias(c) for c in numbers), "move")
        stats = filled.agg(*(F.avg(c).alias(f"m_{c}") for c in numbers), *(F.stddev_pop(c).alias(f"s_{c}") for c in numbers), F.count("*").alias("n"), F.max("move").alias("top")).first()
        self.scales = [(medians[c] or 0.0, stats[f"m_{c}"], stats[f"s_{c}"]) for c in numbers]
        self.top = 5 * stats["top"]
        self.frequent = {}
        for c in _CATEGORIES:  # levels with enough rows: at most rows / min_frequency of them
            levels = train.groupBy(F.col(c).cast("string").alias("level")).agg(F.count("*").alias("n")).where(F.col("n") >= self.min_frequency)
            self.frequent[c] = sorted(r["level"] for r in levels.collect() if r["level"] is not None)
        stages = [
            *(StringIndexerModel.from_labels(self.frequent[c] or [""], f"__{c}", f"__{c}_i", handleInvalid="keep") for c in _CATEGORIES),
            OneHotEncoder(inputCols=[f"__{c}_i" for c in _CATEGORIES], outputCols=[f"__{c}_v" for c in _CATEGORIES], dropLast=True),
            VectorAssembler(inputCols=[*(f"__{c}" for c in numbers), *(f"__{c}_v" for c in _CATEGORIES)], outputCol="__x"),
        ]
        common = {"featuresCol": "__x", "labelCol": "__y", "predictionCol": "__p"}
        if self.family == "ridge":  # the loss here is a mean of squares, so the penalty is one too
            stages.append(LinearRegression(elasticNetParam=0.0, standardization=False, regParam=self.alpha / stats["n"], **common))
        else:
            stages.append(GeneralizedLinearRegression(family="poisson", link="log", regParam=self.alpha / stats["n"], maxIter=25, **common))
        label = F.col("move") if self.family == "poisson" else F.log1p("move")
        self.pipeline = Pipeline(stages=stages).fit(self._scaled(train).withColumn("__y", label))
        return self

    def predict(self, df: DataFrame, column: str = "predicted") -> DataFrame:
        if self.trees is not None:
            out, value = self.trees.predicted(self._prepared(df), "__p"), F.col("__p")
        else:
            out = self.pipeline.transform(self._scaled(df))
            value = F.col("__p") if self.family == "poisson" else F.expm1("__p")
        return out.select(*df.columns, F.least(F.greatest(value, F.lit(0.0)), F.lit(float(self.top))).alias(column))

    def save(self, folder: str) -> None:
        """The fitted pipeline or trees, the priors and the numbers, below a folder that Spark reaches."""
        spark = SparkSession.getActiveSession()
        facts = {"family": self.family, "alpha": self.alpha, "min_frequency": self.min_frequency, "boosting": self.boosting, "top": self.top, "overall": self.overall}
        if self.trees is not None:
            facts["trees"] = self.trees.facts()
        else:
            self.pipeline.write().overwrite().save(f"{folder}/pipeline")
            facts |= {"scales": self.scales, "frequent": self.frequent}
        self.prior.write.mode("overwrite").parquet(f"{folder}/prior")
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/facts")

    @classmethod
    def load(cls, folder: str) -> DemandModel:
        spark = SparkSession.getActiveSession()
        facts = json.loads(spark.read.text(f"{folder}/facts").first()["value"])
        model = cls(facts["family"], facts["alpha"], facts["min_frequency"], facts["boosting"])
        model.top, model.overall, model.prior = facts["top"], facts["overall"], spark.read.parquet(f"{folder}/prior")
        if "trees" in facts:
            model.trees = PoissonTrees.from_facts(facts["trees"])
        else:
            model.scales, model.frequent = [tuple(x) for x in facts["scales"]], facts["frequent"]
            model.pipeline = PipelineModel.load(f"{folder}/pipeline")
        return model


def scored_by(candidates: dict[str, DemandModel], rows: DataFrame) -> DataFrame:
    """Metrics of each model over rows, by model."""
    out = None
    for name, model in candidates.items():
        one = model.predict(rows).select(F.lit(name).alias("model"), F.col("move").alias("actual"), "predicted")
        out = one if out is None else out.unionByName(one)
    return evaluate(out, ["model"])


def selected(metrics: DataFrame) -> str:
    """The model with the least WAPE; of equal ones the first by name."""
    return metrics.agg(F.min(F.struct("wape", "model")).alias("best")).first()["best"]["model"]
