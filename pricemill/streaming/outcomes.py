"""Recommendations and the sales that come in later, matched as both arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["upc", "store", "week"]


def matched(recommendations: DataFrame, sales: DataFrame, within: str = "14 days", late: str = "7 days") -> DataFrame:
    """Each recommendation (rec_id, upc, store, week, decided_for, predicted) with the units of the sale (upc, store,
    week, sold_at, move) of its context that falls within so long after the time it was made for; actual is null
    where none has come once the watermarks of both streams have passed the span.

    Rows of either stream may be late by `late` behind its newest one; those later still are dropped, and counted
    in the query's progress. A match is given as soon as both rows are there. Repeated sales match each. State
    is kept for the span and the lateness only. With tables in place of streams this is the batch join.
    """
    own = recommendations.withWatermark("decided_for", late)
    sold = sales.select(*(F.col(k).alias(f"sold_{k}") for k in KEYS), "sold_at", F.col("move").alias("actual")).withWatermark("sold_at", late)
    same = [F.col(k) == F.col(f"sold_{k}") for k in KEYS]
    span = (F.col("sold_at") >= F.col("decided_for")) & (F.col("sold_at") < F.col("decided_for") + F.expr(f"INTERVAL {within}"))
    found = own.join(sold, [*same, span], "left_outer")
    return found.select("rec_id", *KEYS, "decided_for", "predicted", "sold_at", "actual")
