"""Panel regressions from sums: means over series are taken out by windows, those over larger groups by
grouped means; the normal equations are grouped sums, and only their small matrices (one row a group)
are solved in Python."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = NormalDist().inv_cdf(0.975)
#: Products whose slopes the driver takes at most to estimate their dispersion; more go by aggregates.
DRIVER_PRODUCTS = 1_000_000


def t_quantile(p: float, dof: float) -> float:
    """Quantile of Student's t by Newton steps on its distribution function, from the normal quantile."""
    if dof > 1e6:
        return NormalDist().inv_cdf(p)
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    nodes, weights = np.polynomial.legendre.leggauss(200)
    density = lambda x: scale * (1 + x * x / dof) ** (-(dof + 1) / 2)
    t = NormalDist().inv_cdf(p)
    for _ in range(100):
        below = 0.5 + t / 2 * float(np.sum(weights * density((nodes + 1) * t / 2)))
        step = (below - p) / float(density(t))
        t -= max(-1.0, min(1.0, step)) if dof > 2 else max(-0.5 * (1 + abs(t)), min(0.5 * (1 + abs(t)), step))
        if abs(step) < 1e-12 * (1 + abs(t)):
            break
    return t


def loglog(panel: DataFrame, zero: str = "drop") -> DataFrame:
    """Rows with log price x and log units y; zero units are dropped, or y is log1p."""
    positive = panel.where("effective_unit_price > 0")
    if zero == "drop":
        positive = positive.where("move > 0")
    y = F.log("move") if zero == "drop" else F.log1p("move")
    return positive.withColumns({"x": F.log("effective_unit_price"), "y": y})


def within(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Columns less their means over the keys. A series has at most its weeks, so a window will do; a larger
    group would be one task, so its means are aggregated and joined."""
    if {"upc", "store"} <= set(keys):
        over = Window.partitionBy(*keys)
        return df.withColumns({c: F.col(c) - F.avg(c).over(over) for c in columns})
    means = df.groupBy(*keys).agg(*(F.avg(c).alias(f"__mean_{c}") for c in columns))
    out = df.join(means, keys).withColumns({c: F.col(c) - F.col(f"__mean_{c}") for c in columns})
    return out.select(*df.columns)


def within_slope(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n, slope) of y on x with the means over the keys taken out, from the sums of each group."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("xy"), F.var_samp("x").alias("xx"))
    rest = F.col("n") - 1
    return by.agg(F.sum("n").alias("n"), (F.sum(rest * F.col("xy")) / F.sum(rest * F.col("xx"))).alias("slope"))


def _sums(columns: list[str]):
    return [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]


def _gram(row, k: int) -> np.ndarray:
    out = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"s_{i}_{j}"]
    return out


def independent(gram: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Columns that are not combinations of those before them, judged on the scaled Gram matrix."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1))
    g = gram / np.outer(scale, scale)
    kept: list[int] = []
    for j in range(len(g)):
        if gram[j, j] <= 0:
            continue
        rest = g[j, j]
        if kept:
            part = g[np.ix_(kept, [j])]
            rest -= (part.T @ np.linalg.solve(g[np.ix_(kept, kept)], part)).item()
        if rest > tolerance:
            kept.append(j)
    return kept


class Fit:
    """Ordinary least squares of a table: coefficients and covariances, all from sums over the table."""

    def __init__(self, df: DataFrame, y: str, xs: list[str], absorbed: int = 0):
        self.df, self.y, self.xs, self.absorbed = df, y, xs, absorbed
        row = df.agg(F.count("*").alias("n"), F.sum(y).alias("sum_y"), *_sums([*xs, y])).first()
        k = len(xs)
        gram = _gram(row, k + 1)
        self.n, self.kept = row["n"], independent(gram[:k, :k])
        self.inverse = np.linalg.inv(gram[np.ix_(self.kept, self.kept)])
        self.beta = np.full(k, np.nan)
        self.beta[self.kept] = self.inverse @ gram[self.kept, k]
        self.dof = self.n - len(self.kept) - absorbed
        self.sse = gram[k, k] - self.beta[self.kept] @ gram[self.kept, k]
        centred = gram[k, k] - row["sum_y"] ** 2 / self.n
        self.r_squared = 1 - self.sse / centred if centred > 0 else float("nan")

    def _scores(self) -> DataFrame:
        e = F.col(self.y) - reduce(lambda a, b: a + b, [F.col(self.xs[i]) * float(self.beta[i]) for i in self.kept])
        return self.df.withColumn("__e", e).withColumns({f"__s{i}": F.col("__e") * F.col(self.xs[i]) for i in self.kept})

    def _sandwich(self, scores: DataFrame, factor: float) -> np.ndarray:
        names = [f"__s{i}" for i in self.kept]
        meat = _gram(scores.agg(*_sums(names)).first(), len(names))
        return self.inverse @ meat @ self.inverse * factor

    def classical(self) -> np.ndarray:
        return self.inverse * (self.sse / self.dof)

    def hc1(self) -> np.ndarray:
        return self._sandwich(self._scores(), self.n / self.dof)

    def clustered(self, keys: list[str]) -> np.ndarray:
        """One-way clusters of the joint values of keys: scores are summed by cluster first."""
        names = [f"__s{i}" for i in self.kept]
        sums = self._scores().groupBy(*keys).agg(*(F.sum(s).alias(s) for s in names))
        row = sums.agg(F.count("*").alias("g"), *_sums(names)).first()
        if row["g"] < 2:
            raise ValueError("clustered errors take two clusters at least")
        return self.inverse @ _gram(row, len(names)) @ self.inverse * (row["g"] / (row["g"] - 1) * (self.n - 1) / self.dof)

    def two_way(self, a: str, b: str) -> np.ndarray:
        """Cluster a plus cluster b less their joint clusters, projected to be positive semi-definite."""
        v = self.clustered([a]) + self.clustered([b]) - self.clustered([a, b])
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        return vectors @ np.diag(np.maximum(values, 0)) @ vectors.T

    def summary(self, name: str, covariance: np.ndarray) -> pd.DataFrame:
        se = np.full(len(self.xs), np.nan)
        se[self.kept] = np.sqrt(np.diag(covariance))
        frame = pd.DataFrame({"fit": name, "term": self.xs, "estimate": self.beta, "std_error": se, "n": self.n, "r_squared": self.r_squared})
        critical = t_quantile(0.975, max(self.dof, 1))
        return frame.assign(ci_low=frame.estimate - critical * frame.std_error, ci_high=frame.estimate + critical * frame.std_error)


def _clustered_meats(rows: DataFrame, key: str, score: Column, clusters: tuple[str, ...] = ("store", "week")) -> DataFrame:
    """By key: the sum of squared scores (meat), and for each cluster the number of its groups (g_) and the sum
    of their squared sums of scores (meat_). One pass over the rows."""
    sets = [[key, c] for c in clusters]
    sums = rows.withColumn("__s", score).groupingSets(sets, key, *clusters).agg(
        F.grouping_id().alias("__g"), F.sum("__s").alias("__sum"), F.sum(F.col("__s") * F.col("__s")).alias("__sq"))
    n = len(clusters)  # of the id's bits, the key's is clear and so is that of the set's own cluster
    is_ = {c: F.col("__g") == ((1 << n) - 1) ^ (1 << (n - 1 - i)) for i, c in enumerate(clusters)}
    own = [x for c in clusters for x in (F.count_if(is_[c]).alias(f"g_{c}"), F.sum(F.when(is_[c], F.col("__sum") * F.col("__sum"))).alias(f"meat_{c}"))]
    return sums.groupBy(key).agg(F.sum(F.when(is_[clusters[0]], F.col("__sq"))).alias("meat"), *own)


def _largest_error(out: DataFrame, dof: Column, bread: Column, clusters: tuple[str, ...] = ("store", "week")) -> DataFrame:
    """HC1 and clustered errors from their meats, and std_error, the largest of those that exist."""
    n, errors = F.col("n_obs"), {"std_error_hc1": F.sqrt(F.col("meat") * F.col("n_obs") / dof) * bread}
    for c in clusters:
        g = F.col(f"g_{c}")
        errors[f"std_error_{c}"] = F.when(g > 1, F.sqrt(F.col(f"meat_{c}") * g / (g - 1) * (n - 1) / dof) * bread)
    return out.withColumns(errors).withColumn("std_error", F.greatest(*errors))


def slopes(df: DataFrame, key: str) -> DataFrame:
    """By key: slope of y on x (both with their group means out already), and its standard errors: HC1 and
    clustered by store and by week; the largest is std_error. Absorbed means are not charged."""
    base = df.groupBy(key).agg(F.count("*").alias("n_obs"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    base = base.where("sxx > 0 and n_obs > 2").withColumn("estimate", F.col("sxy") / F.col("sxx"))
    scored = df.join(base.select(key, "estimate"), key)
    out = base.join(_clustered_meats(scored, key, F.col("x") * (F.col("y") - F.col("estimate") * F.col("x"))), key)
    out = _largest_error(out, F.col("n_obs") - 1, 1 / F.col("sxx"))
    r2 = F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.nullif("syy", F.lit(0.0)))
    return out.select(key, "n_obs", "estimate", "std_error_hc1", "std_error_store", "std_error_week", "std_error", r2.alias("r_squared"))


def controlled_slopes(df: DataFrame, key: str, controls: list[str]) -> DataFrame:
    """By key: the coefficient of x beside controls (means over series out of all of them and of y), with its
    errors as in slopes, charged for the intercept, the controls and the stores, and R2.

    Once the controls are regressed out, an error takes no more than the score of x: each row's x less
    what the controls say of it, times its residual. So the solving of one row a key yields the weights
    of that (w_) and the coefficients (b_), and a second pass sums the scores. A key whose x does not
    vary gives no row."""
    xs = ["x", *controls]
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("store").alias("n_stores"), *_sums([*xs, "y"]))
    fits = solved(sums, [key], xs)
    scored = df.join(fits.select(key, *_coefficients(xs)), key)
    out = fits.join(_clustered_meats(scored, key, score(xs)), key)
    return with_errors(out).select(key, *SLOPE_COLUMNS)


SLOPE_COLUMNS = ["n_obs", "estimate", "std_error_hc1", "std_error_store", "std_error_week", "std_error", "r_squared"]


def _coefficients(xs: list[str]) -> list[str]:
    return [*(f"b_{x}" for x in xs), *(f"w_{x}" for x in xs)]


def solved(sums: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """From sums by keys (n, n_stores and the s_i_j of xs and y): n_obs, n_stores, n_kept, sse, syy, the coefficients
    (b_) and what the score of the first regressor takes of each (w_). One row a key; none where the first regressor
    does not vary."""
    k = len(xs)
    names = [*keys, "n_obs", "n_stores", "n_kept", "sse", "syy", *_coefficients(xs)]

    def solve(frames):
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                gram = _gram(row, k + 1)
                kept = independent(gram[:k, :k])
                if kept and kept[0] == 0:
                    inverse = np.linalg.inv(gram[np.ix_(kept, kept)])
                    beta, weight = np.zeros(k), np.zeros(k)
                    beta[kept], weight[kept] = inverse @ gram[kept, k], inverse[0]
                    rows.append((*(row[c] for c in keys), row["n"], row["n_stores"], len(kept), gram[k, k] - beta @ gram[:k, k], gram[k, k], *beta, *weight))
            yield pd.DataFrame(rows, columns=names)

    kinds = dict(sums.dtypes)
    own = ", ".join(f"{c} {kinds[c]}" for c in keys)
    return sums.mapInPandas(solve, f"{own}, n_obs long, n_stores long, n_kept long, sse double, syy double, " + ", ".join(f"{n} double" for n in _coefficients(xs)))


def score(xs: list[str]) -> Column:
    """A row's score of the first regressor, from the coefficients that solved gives its key."""
    total = lambda p: reduce(lambda a, b: a + b, [F.col(x) * F.col(f"{p}_{x}") for x in xs])
    return total("w") * (F.col("y") - total("b"))


def with_errors(out: DataFrame) -> DataFrame:
    """Fits with the meats of their scores: estimate, its errors and r_squared."""
    dof = F.col("n_obs") - F.col("n_kept") - F.col("n_stores")
    out = _largest_error(out, F.when(dof > 0, dof), F.lit(1.0))
    return out.withColumns({"estimate": F.col("b_x"), "r_squared": 1 - F.col("sse") / F.nullif("syy", F.lit(0.0))})


def slope_by_group(df: DataFrame, key: str, xs: list[str]) -> DataFrame:
    """By key the coefficients of several regressors (means out already): Gram matrices as grouped sums, one
    row a group, solved beside the data. A group whose first regressor is no use gives no row."""
    k = len(xs)
    sums = df.groupBy(key).agg(F.count("*").alias("n"), *_sums([*xs, "y"]))

    def solve(frames):
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                gram = _gram(row, k + 1)
                kept = independent(gram[:k, :k])
                if kept and kept[0] == 0:
                    beta = np.full(k, np.nan)
                    beta[kept] = np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, k])
                    rows.append((row[key], row["n"], *(None if np.isnan(v) else float(v) for v in beta)))
            yield pd.DataFrame(rows, columns=[key, "n_obs", *(f"beta_{x}" for x in xs)])

    kind = dict(df.dtypes)[key]
    return sums.mapInPandas(solve, f"{key} {kind}, n_obs long, " + ", ".join(f"beta_{x} double" for x in xs))


def tau2_moment(estimates: np.ndarray, errors: np.ndarray) -> float:
    return max(float(np.var(estimates, ddof=1) - np.mean(errors**2)), 0.0)


def tau2_reml(estimates: np.ndarray, errors: np.ndarray, rounds: int = 500, tolerance: float = 1e-12) -> tuple[float, float]:
    """Between-product variance and mean by restricted maximum likelihood, as a fixed point."""
    tau2 = tau2_moment(estimates, errors)
    mean = float(np.mean(estimates))
    for _ in range(rounds):
        w = 1 / (tau2 + errors**2)
        mean = float(np.sum(w * estimates) / np.sum(w))
        new = max(float(np.sum(w**2 * ((estimates - mean) ** 2 - errors**2)) / np.sum(w**2) + 1 / np.sum(w)), 0.0)
        if abs(new - tau2) < tolerance:
            return new, mean
        tau2 = new
    return tau2, mean


def _reml_by_aggregates(table: DataFrame, rounds: int = 500, tolerance: float = 1e-12) -> tuple[float, float]:
    """tau2_reml of (estimate, std_error) where the products are too many for the driver: each round is one
    aggregate over the table, which should be stored."""
    e, v = F.col("estimate"), F.col("std_error") * F.col("std_error")
    first = table.agg(F.var_samp(e).alias("var"), F.avg(v).alias("noise"), F.avg(e).alias("mean")).first()
    tau2, mean = max((first["var"] or 0.0) - first["noise"], 0.0), first["mean"]
    for _ in range(rounds):
        w = 1 / (F.lit(tau2) + v)
        row = table.agg(F.sum(w).alias("w"), F.sum(w * e).alias("we")).first()
        mean = row["we"] / row["w"]
        spread = table.agg(F.sum(w * w * ((e - mean) * (e - mean) - v)).alias("a"), F.sum(w * w).alias("b")).first()
        new = max(spread["a"] / spread["b"] + 1 / row["w"], 0.0)
        if abs(new - tau2) < tolerance:
            return new, mean
        tau2 = new
    return tau2, mean


def dispersion(table: DataFrame, method: str = "reml") -> tuple[float, float] | None:
    """(tau2, mean) of the slopes (estimate, std_error) of a table; None for fewer than two. The slopes are
    counted before they come to the driver."""
    own = table.where("std_error > 0").select("estimate", "std_error")
    count = own.count()
    if count < 2:
        return None
    if count > DRIVER_PRODUCTS:
        return _reml_by_aggregates(own)
    frame = own.toPandas()
    e, s = frame.estimate.to_numpy(), frame.std_error.to_numpy()
    return tau2_reml(e, s) if method == "reml" else (tau2_moment(e, s), float(np.mean(e)))


def shrunk(
    table: DataFrame, pooled: float, max_error: float = 1.5, band: tuple[float, float] = (0.2, 6.0), prior: str = "pooled",
    method: str = "reml", usable: Column | None = None,
) -> DataFrame:
    """Empirical-Bayes elasticities: usable slopes (by default negative, error at most max_error) weigh tau2 /
    (tau2 + se^2) against the prior; others take the prior. The magnitude is kept within the band."""
    usable = (F.col("estimate") < 0) & (F.col("std_error") <= max_error) if usable is None else usable
    table = table.withColumn("usable", F.coalesce(usable, F.lit(False)))
    tau2, free = dispersion(table.where("usable"), method) or (0.0, pooled)
    return weighed(table, F.lit(tau2), F.lit(free if prior == "estimated" else pooled), band)


def weighed(table: DataFrame, tau2: Column, mean: Column, band: tuple[float, float]) -> DataFrame:
    """Slopes (estimate, std_error, usable) drawn to a mean by their dispersion, and kept within the band."""
    weight = F.when(F.col("usable"), tau2 / F.nullif(tau2 + F.col("std_error") * F.col("std_error"), F.lit(0.0))).otherwise(F.lit(0.0))
    out = table.withColumn("shrinkage_weight", F.coalesce(weight, F.lit(0.0)))
    value = F.when(F.col("shrinkage_weight") > 0, F.col("shrinkage_weight") * F.col("estimate") + (1 - F.col("shrinkage_weight")) * mean).otherwise(mean)
    out = out.withColumn("elasticity_shrunk", value)
    final = -F.least(F.greatest(F.abs("elasticity_shrunk"), F.lit(band[0])), F.lit(band[1]))
    source = F.when(F.col("usable"), "shrunk_product").otherwise("pooled_fallback")
    return out.withColumns({"elasticity_final": final, "elasticity_source": source, "clipped": F.abs(final - F.col("elasticity_shrunk")) > 1e-9})
