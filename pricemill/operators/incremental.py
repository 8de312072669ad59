"""Features week by week: new weeks are made from a small state of each series instead of from its whole past.

The panel, the features and the state lie in tables that are bucketed by series, so a new week joins its state
without a shuffle. A series' state is what its next row needs: its last rows as far as lags and rolling windows
reach, how often it had each price (for the median of all past prices), its last known cost and its age. A state
is named by the week it ends with and is never changed, so a week can be made again from the state before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricemill.config import Config

from .features import features, package_ounces, price_features, series

_KEYS = ["upc", "store"]
_LAST = "array<struct<move:double,price:double,promotion:int>>"


def _row() -> Column:
    return F.struct(F.col("move").cast("double").alias("move"), F.col("effective_unit_price").alias("price"), F.col("recorded_promotion_flag").cast("int").alias("promotion"))


def _reach(config: Config) -> int:
    """Past rows that lags and rolling windows look at."""
    return max(*config["modeling.lags"], *config["modeling.rolling_windows"], 4)


def _counted(prices: Column) -> Column:
    """An array of prices as a sorted array of each with its number."""
    return F.transform(F.array_sort(F.array_distinct(prices)), lambda p: F.struct(p.alias("price"), F.size(F.filter(prices, lambda x: x == p)).alias("n")))


def _spelled(counts: Column) -> Column:
    """The sorted prices that a sorted array of counts stands for."""
    return F.flatten(F.transform(counts, lambda c: F.array_repeat(c.price, c.n)))


def states(panel: DataFrame, config: Config | None = None) -> DataFrame:
    """(upc, store, last, counts, cost, age) of each series after all rows of a panel. A series has at most its weeks."""
    reach = _reach(config or Config())
    rows = F.array_sort(F.collect_list(F.struct("week", _row().alias("r"))))
    by = panel.groupBy(*_KEYS).agg(
        rows.alias("__rows"), F.collect_list("effective_unit_price").alias("__prices"), F.count("*").alias("age"),
        F.max_by("estimated_unit_aac", F.when(F.col("estimated_unit_aac").isNotNull(), F.col("week"))).alias("cost"),
    )
    last = F.slice(F.transform("__rows", lambda x: x.r), F.greatest(F.size("__rows") - reach + 1, F.lit(1)), F.lit(reach))
    return by.select(*_KEYS, last.alias("last"), _counted(F.col("__prices")).alias("counts"), "cost", "age")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def _median(prices: Column) -> Column:
    """The median of sorted prices, between the two middle ones where they are even in number."""
    n = F.size(prices)
    low, high = F.get(prices, F.floor((n - 1) / 2).cast("int")), F.get(prices, F.floor(n / 2).cast("int"))
    return F.when(n > 0, low + (high - low) * F.when(n % 2 == 0, 0.5).otherwise(0.0))


def next_features(state: DataFrame, rows: DataFrame, config: Config | None = None) -> DataFrame:
    """The columns of features() for rows that follow the state, at one or more new weeks. Nothing is shuffled where
    both tables are bucketed by series."""
    config = config or Config()
    reach = _reach(config)
    own = rows.join(state.hint("merge"), _KEYS, "left")
    before = series().rowsBetween(Window.unboundedPreceding, -1)
    # earlier new rows of the series, beside what the state holds
    new = own.withColumns({
        "__new": F.collect_list(_row()).over(before), "__late": F.last("estimated_unit_aac", ignorenulls=True).over(before), "__at": F.row_number().over(series()),
    })
    past = F.concat(F.coalesce("last", F.array().cast(_LAST)), F.col("__new").cast(_LAST))
    new = new.withColumn("__past", F.slice(past, F.greatest(F.size(past) - reach + 1, F.lit(1)), F.lit(reach)))
    prices = F.concat(_spelled(F.coalesce("counts", F.array().cast("array<struct<price:double,n:int>>"))), F.filter(F.transform("__new", lambda r: r.price), lambda p: p.isNotNull()))
    new = new.withColumn("__prices", F.array_sort(prices))
    n = F.size("__past")

    def back(k: int, name: str) -> Column:
        return F.when(n >= k, F.get(F.col("__past"), F.greatest(n - k, F.lit(0))).getField(name))

    def window(w: int, name: str) -> Column:
        rows_ = F.slice("__past", F.greatest(n - w + 1, F.lit(1)), F.lit(w))
        return F.filter(F.transform(rows_, lambda r: r.getField(name)), lambda x: x.isNotNull())

    moves = {w: window(w, "move") for w in config["modeling.rolling_windows"]}
    four = window(4, "move")
    spread = F.aggregate(F.transform(four, lambda x: (x - _mean(four)) * (x - _mean(four))), F.lit(0.0), lambda a, x: a + x)
    made = {f"lag_move_{k}": back(k, "move") for k in config["modeling.lags"]}
    made |= {f"roll_mean_move_{w}": F.when(F.size(v) >= 2, _mean(v)) for w, v in moves.items()}
    made |= {
        "roll_std_move_4": F.when(F.size(four) >= 2, F.sqrt(spread / (F.size(four) - 1))), "lag_price_1": back(1, "price"), "lag_price_2": back(2, "price"),
        "roll_mean_price_4": _mean(window(4, "price")), "series_reference_price": _median(F.col("__prices")), "decision_time_unit_cost": F.coalesce("__late", "cost"),
        "lag_promotion_1": back(1, "promotion"), "series_age_weeks": (F.coalesce("age", F.lit(0)) + F.col("__at") - 1).cast("long"), "time_index": F.col("week"),
    }
    out = new.select(*rows.columns, *(c.alias(k) for k, c in made.items()))
    out = out.withColumn("package_size_oz", package_ounces(F.col("size")) if "size" in rows.columns else F.lit(None).cast("double"))
    return out.withColumns(price_features(F.col("effective_unit_price")))


def advanced(state: DataFrame, rows: DataFrame, config: Config | None = None) -> DataFrame:
    """The state after the rows that follow it; series without new rows keep theirs."""
    reach = _reach(config or Config())
    fresh = states(rows, config).select(*_KEYS, *(F.col(c).alias(f"__{c}") for c in ("last", "counts", "cost", "age")))
    both = state.join(fresh.hint("merge"), _KEYS, "full")
    none = F.array()
    rows_ = F.concat(F.coalesce("last", none.cast(_LAST)), F.coalesce("__last", none.cast(_LAST)))
    kind = "array<struct<price:double,n:int>>"
    prices = F.concat(_spelled(F.coalesce("counts", none.cast(kind))), _spelled(F.coalesce("__counts", none.cast(kind))))
    return both.select(
        *_KEYS, F.slice(rows_, F.greatest(F.size(rows_) - reach + 1, F.lit(1)), F.lit(reach)).alias("last"), _counted(prices).alias("counts"),
        F.coalesce("__cost", "cost").alias("cost"), (F.coalesce("age", F.lit(0)) + F.coalesce("__age", F.lit(0))).alias("age"),
    )


class FeatureStore:
    """Bucketed tables of a panel, its features and its states, below a folder that Spark reaches.

    name: prefix of the tables in the session's catalogue. start() takes a panel as it is; append() takes weeks that
    follow a state, and writes only those: appended again they replace themselves. Panel and features are
    partitioned by week.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = 8, config: Config | None = None):
        self.spark, self.name, self.folder, self.buckets, self.config = spark, name, folder.rstrip("/"), buckets, config or Config()

    def _write(self, df: DataFrame, table: str, weekly: bool = True) -> None:
        # one task a bucket; nothing is moved where df is bucketed so already
        dealt = df.repartition(self.buckets, *_KEYS)
        writer = dealt.write.format("parquet").bucketBy(self.buckets, *_KEYS).option("path", f"{self.folder}/{table}")
        (writer.partitionBy("week").sortBy("upc", "store") if weekly else writer.sortBy(*_KEYS)).mode("overwrite").saveAsTable(f"{self.name}_{table}")

    def _replace(self, df: DataFrame, table: str) -> None:
        """Overwrites the weeks of df, and no others."""
        full = f"{self.name}_{table}"
        columns = self.spark.table(full).columns
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            df.select(*columns).write.mode("overwrite").insertInto(full)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def start(self, panel: DataFrame) -> None:
        self._write(panel, "panel")
        kept = self.spark.table(f"{self.name}_panel")
        self._write(features(kept, self.config), "features")
        self._write(states(kept, self.config), f"state_{kept.agg(F.max('week')).first()[0]}", weekly=False)

    def state_before(self, week: int) -> DataFrame:
        """The newest state that ends before a week."""
        names = [t.name for t in self.spark.catalog.listTables(pattern=f"{self.name}_state_*")]
        ends = [int(n.rsplit("_", 1)[1]) for n in names]
        if not (earlier := [e for e in ends if e < week]):
            raise ValueError(f"no state ends before week {week}")
        return self.spark.table(f"{self.name}_state_{max(earlier)}")

    def following(self, weeks: list[int]) -> DataFrame:
        """The features of weeks of the stored panel, from the state before them."""
        rows = self.spark.table(f"{self.name}_panel").where(F.col("week").isin(weeks))
        return next_features(self.state_before(min(weeks)), rows, self.config)

    def append(self, rows: DataFrame) -> list[int]:
        """Takes in rows of new weeks, which must follow each other and a state; returns the weeks. A table without rows
        changes nothing."""
        weeks = sorted(r["week"] for r in rows.select("week").distinct().collect())  # a few numbers
        if not weeks:
            return []
        state = self.state_before(weeks[0])
        self._replace(rows.repartition(self.buckets, *_KEYS), "panel")
        self._replace(self.following(weeks), "features")
        self._write(advanced(state, self.spark.table(f"{self.name}_panel").where(F.col("week").isin(weeks)), self.config), f"state_{weeks[-1]}", weekly=False)
        return weeks

    def features(self) -> DataFrame:
        return self.spark.table(f"{self.name}_features")

    def drop(self) -> None:
        """Forgets the tables; their files stay."""
        for t in self.spark.catalog.listTables(pattern=f"{self.name}_*"):
            self.spark.sql(f"DROP TABLE IF EXISTS {t.name}")
