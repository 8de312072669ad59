"""From raw movement to the canonical panel, with every exclusion counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemill.config import Config
from pricemill.functions.columns import unit_price

GRAIN = ["upc", "store", "week"]
# Promotion codes.
PROMOTIONS = {"B": "BONUS_BUY", "C": "COUPON", "S": "SALE"}


def with_calendar(df: DataFrame, week1: str) -> DataFrame:
    start = F.date_add(F.lit(week1).cast("date"), ((F.col("week") - 1) * 7).cast("int"))
    return df.withColumn("week_start_date", start).withColumns({
        "year": F.year("week_start_date"), "month": F.month("week_start_date"), "quarter": F.quarter("week_start_date"), "week_of_year": F.weekofyear("week_start_date"),
    })


def with_promotion(df: DataFrame) -> DataFrame:
    code = F.nullif(F.upper(F.trim("sale")), F.lit(""))
    kind = F.when(code.isNull(), "NONE_RECORDED")
    for c, name in PROMOTIONS.items():
        kind = kind.when(code == c, name)
    return df.withColumns({
        "sale": code, "recorded_promotion_flag": F.coalesce(code.isin(*PROMOTIONS), F.lit(False)).cast("int"), "recorded_promotion_type": kind.otherwise("UNKNOWN_CODE"),
    })


def with_economics(df: DataFrame) -> DataFrame:
    """Unit price, revenue, margin rate, implied unit cost, gross profit and margin of a unit."""
    p, rate = unit_price(F.col("price"), F.col("qty")), F.col("profit") / 100
    return df.withColumns({
        "effective_unit_price": p, "revenue": p * F.col("move"), "gross_margin_rate": rate, "estimated_unit_aac": p * (1 - rate), "gross_profit": p * F.col("move") * rate, "unit_gross_margin": p * rate,
    })


def with_flags(df: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rate = F.col("gross_margin_rate")
    return df.withColumns({
        "margin_implausible_flag": F.coalesce((rate >= 1) | (rate <= -1), F.lit(True)).cast("int"), "aac_nonpositive_flag": flag(F.col("estimated_unit_aac") <= 0),
        "zero_move_flag": flag(F.col("move") == 0), "bundle_flag": flag(F.col("qty") > 1),
    })


def first_failed_rule(config: Config) -> Column:
    """The first validity rule that a row breaks, or null; a null predicate counts as broken."""
    null = lambda *cs: F.greatest(*(F.col(c).isNull() for c in cs))
    rules = {
        "missing_key": null(*GRAIN), "missing_core_measure": null("price", "qty", "move"), "ok_flag_zero": F.col("ok") == 0,
        "non_positive_price": F.col("price") < config["data.min_price"], "non_positive_qty": F.col("qty") < config["data.min_qty"], "negative_move": F.col("move") < 0,
    }
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        out = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(out)
    return out


def exclusions(movement: DataFrame, config: Config | None = None) -> DataFrame:
    """(rule, n_rows) of the rows each rule removes from those that earlier rules left; `exact_duplicate` for further
    copies of a row, which count before all rules, and `kept` for the rest."""
    rule = F.coalesce(first_failed_rule(config or Config()), F.lit("kept"))
    each = movement.groupBy(*movement.columns).agg(F.count("*").alias("__n"))
    entries = F.array(F.struct(rule.alias("rule"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("exact_duplicate").alias("rule"), (F.col("__n") - 1).alias("n")))
    return each.select(F.explode(entries).alias("e")).where("e.n > 0").groupBy("e.rule").agg(F.sum("e.n").alias("n_rows"))


def raw_audit(movement: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """(measure, value) of raw movement: rows, nulls by column, exact copies, rows beyond one a grain, distinct keys,
    the span of weeks, and rows by suspect flag and promotion code; with the damaged records of the reader also their number, and
    how many have each reason."""
    one = movement.agg(
        F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in movement.columns),
        F.countDistinct("upc").alias("n_upc"), F.countDistinct("store").alias("n_store"), F.countDistinct("week").alias("n_week"), F.min("week").cast("long").alias("week_min"), F.max("week").cast("long").alias("week_max"),
    )
    extra = lambda cols, name: movement.groupBy(*cols).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    one = one.crossJoin(extra(movement.columns, "exact_duplicates")).crossJoin(extra(GRAIN, "grain_duplicates"))
    cells = ", ".join(f"'{c}', cast(`{c}` as bigint)" for c in one.columns)
    long = one.selectExpr(f"stack({len(one.columns)}, {cells}) as (measure, value)")
    for c in ("ok", "sale"):
        name = F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null")))
        long = long.unionByName(movement.groupBy(name.alias("measure")).agg(F.count("*").alias("value")))
    if damaged is not None:
        long = long.unionByName(damaged.agg(F.lit("damaged").alias("measure"), F.count("*").alias("value")))
        by = damaged.select(F.explode("reasons").alias("reason")).groupBy(F.concat(F.lit("damaged:"), "reason").alias("measure"))
        long = long.unionByName(by.agg(F.count("*").alias("value")))
    return long


def canonical(movement: DataFrame, products: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """The canonical panel: valid, distinct rows, one a grain (of several the least by all measures), with
    promotion, calendar, economics, flags and product data (first row of a product by description)."""
    config = config or Config()
    valid = movement.dropDuplicates().where(first_failed_rule(config).isNull())
    order = Window.partitionBy(*GRAIN).orderBy("price", "qty", "move", "profit", "sale")
    one = valid.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    out = with_flags(with_economics(with_calendar(with_promotion(one), config["data.week1_start_date"])))
    if products is not None:  # one row a product, so the join keeps the number of rows
        first = Window.partitionBy("upc").orderBy("descrip", "size", "com_code")
        products = products.where("upc is not null").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        out = out.join(products.withColumn("has_metadata_flag", F.lit(1)), "upc", "left").fillna({"has_metadata_flag": 0})
    return out


def join_report(movement: DataFrame, products: DataFrame) -> DataFrame:
    """One row: products on either side, those that the other side lacks, and described rows beyond one a product."""
    left, right = movement.select("upc").distinct(), products.select("upc").distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return (
        count(left, "moved").crossJoin(count(right, "described"))
        .crossJoin(products.agg((F.count("*") - F.countDistinct("upc")).alias("described_again")))
        .crossJoin(count(left.join(right, "upc", "left_anti"), "moved_only")).crossJoin(count(right.join(left, "upc", "left_anti"), "described_only"))
    )


def validation(panel: DataFrame, tolerance: float = 1e-6, dates: tuple[str, str] = ("1989-01-01", "2009-12-31")) -> DataFrame:
    """(check, value, passed): deviations from the defining formulas, ranges, uniqueness of the grain."""
    col = F.col
    worst = {
        "revenue_formula": F.max(F.abs(col("revenue") - col("effective_unit_price") * col("move"))),
        "aac_formula": F.max(F.abs(col("estimated_unit_aac") - col("effective_unit_price") * (1 - col("gross_margin_rate")))),
        "gross_profit_formula": F.max(F.abs(col("gross_profit") - col("revenue") * col("gross_margin_rate"))),
        "unit_price_formula": F.max(F.abs(col("effective_unit_price") - col("price") / col("qty"))),
        "negative_units": F.count_if(col("move") < 0), "non_positive_price": F.count_if(col("effective_unit_price") <= 0), "null_keys": F.count_if(col("upc").isNull() | col("store").isNull() | col("week").isNull()),
        "promotion_flag_range": F.count_if(~col("recorded_promotion_flag").isin(0, 1)), "margin_rate_formula": F.max(F.abs(col("gross_margin_rate") - col("profit") / 100)),
        "non_positive_qty": F.count_if(col("qty") <= 0), "infinite_unit_price": F.count_if(F.abs(col("effective_unit_price")) == float("inf")),
        "not_ok_rows": F.count_if(col("ok") != 1), "empty_panel": F.when(F.count("*") == 0, 1).otherwise(0),
        "implausible_dates": F.count_if(~col("week_start_date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date"))),
    }
    one = panel.agg(*(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in worst.items()))
    doubled = panel.groupBy(*GRAIN).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("duplicate_grain"))
    many = panel.groupBy("week").agg(F.countDistinct("week_start_date").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("dates_by_week"))
    names = [*worst, "duplicate_grain", "dates_by_week"]
    long = one.crossJoin(doubled).crossJoin(many).selectExpr(f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) as (check, value)")
    return long.select("check", F.round("value", 6).alias("value"), (F.col("value") <= tolerance).alias("passed"))
