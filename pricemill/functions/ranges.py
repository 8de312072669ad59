"""Running totals and exact quantiles over a whole table or large groups, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, key: Column, order: list[Column], totals: dict[str, Column], by: tuple[str, ...] = (), parts: int = 200) -> DataFrame:
    """df with running sums (the row itself included) in the given order within the groups of by, which are few.

    key is a number that never falls along the order. Its approximate quantiles part each group into ranges; a row's
    range follows from the row alone, so a task that runs again deals alike. Keys are held against these bounds in
    single precision, as a sum of doubles that is computed again may differ in its last bits. Each range sums its
    own rows and adds what the ranges before it hold; only the sums of the ranges meet in one place.
    """
    values = {f"__v{i}": c for i, c in enumerate(totals.values())}
    own = df.withColumns(values).withColumn("__key", key.cast("float"))
    bounds = own.groupBy(*by).agg(F.percentile_approx("__key", [i / parts for i in range(1, parts)], 10_000).alias("__bounds"))
    place = F.coalesce(F.size(F.filter(F.array_distinct("__bounds"), lambda b: b < F.col("__key"))), F.lit(0))
    dealt = own.join(F.broadcast(bounds), list(by)) if by else own.crossJoin(F.broadcast(bounds))
    dealt = dealt.withColumn("__range", place).drop("__bounds", "__key")
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "__range").agg(*(F.sum(v).alias(v) for v in values))
    sums = sums.select(*by, "__range", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values))
    out = dealt.withColumns({f"{v}_upto": F.sum(v).over(inside) for v in values}).join(F.broadcast(sums), [*by, "__range"])
    return out.select(*df.columns, *((F.col(f"{v}_before") + F.col(f"{v}_upto")).alias(name) for v, name in zip(values, totals)))


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, *shares): exact quantiles of a value by group, between neighbours in proportion. Values are counted first,
    so that no buffer holds all of a group; nulls are not counted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    return counted_quantiles(counts, group, "__x", "__n", shares)


def counted_quantiles(counts: DataFrame, group: str, value: str, count: str, shares: dict[str, float]) -> DataFrame:
    """The same of values that are counted already: a row a group and value. The table is read several times."""
    counts = counts.where(F.col(count) > 0).select(group, F.col(value).alias("__x"), F.col(count).alias("__c"))
    ranked = running_totals(counts, F.col("__x"), [F.col("__x")], {"__upto": F.col("__c")}, by=(group,))
    totals = counts.groupBy(group).agg(F.sum("__c").alias("__n"))
    rows = ranked.join(F.broadcast(totals), group)
    first, upto = F.col("__upto") - F.col("__c"), F.col("__upto")

    def at(place: Column) -> Column:
        return F.max(F.when((place >= first) & (place < upto), F.col("__x")))

    place = {k: F.lit(float(s)) * (F.col("__n") - 1) for k, s in shares.items()}
    ends = [x for k, p in place.items() for x in (at(F.floor(p)).alias(f"__lo_{k}"), at(F.ceil(p)).alias(f"__hi_{k}"), F.max(p - F.floor(p)).alias(f"__part_{k}"))]
    lo, hi, part = (lambda k: F.col(f"__lo_{k}")), (lambda k: F.col(f"__hi_{k}")), (lambda k: F.col(f"__part_{k}"))
    return rows.groupBy(group).agg(*ends).select(group, *((lo(k) + (hi(k) - lo(k)) * part(k)).alias(k) for k in shares))
