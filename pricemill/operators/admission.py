"""Admission of requests: at most so many a client in any sliding window, and so many a day in all.

Whether a request is admitted depends on those admitted before it, so a client's requests are folded in their
order. Where a client has none for longer than the window, what comes after does not depend on what came before:
its requests are parted into such sessions, found from their numbers by client and slot of the window's length. They
are dealt by session, sorted within the task, and pass through as a stream of which only the times of the last admitted
requests are remembered; only a client that is never silent is one task's. The day's cap is a place in the order of all admitted requests of the
day, found by ranges. What comes after it is not admitted and so not remembered for its client either, which can
only change the day after; folding is repeated with the days' last places until they stay. The first day's is
right after one round, each next one after one more at most; as a rule two or three rounds do.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemill.functions.kept import keep
from pricemill.functions.ranges import running_totals

_DAY = 86_400_000_000


def with_sessions(rows: DataFrame, window: int) -> DataFrame:
    """rows (client, at, ...) with the session of each: the slot in which its run of slots with requests begins. Between two
    sessions of a client there is an empty slot, so more than the window. The runs come from one row a client and slot."""
    slot = F.floor(F.col("at") / window).cast("long")
    order = Window.partitionBy("client").orderBy("slot")
    slots = rows.groupBy("client", slot.alias("slot")).agg(F.count("*").alias("n"))
    begins = F.when(F.coalesce(F.col("slot") - F.lag("slot").over(order) > 1, F.lit(True)), F.col("slot"))
    slots = slots.withColumn("begins", begins).select(F.col("client").alias("__client"), F.col("slot").alias("__slot"), F.last("begins", ignorenulls=True).over(order).alias("session"))
    found = rows.withColumn("__at_slot", slot).join(slots, F.col("client").eqNullSafe(F.col("__client")) & (F.col("__at_slot") == F.col("__slot")))
    return found.select(*rows.columns, "session")


def _fold(per_client: int, window: int, ends: dict[int, tuple[int, int]]):
    """Adds to each row (client, at, id, day, session), sorted by client, time and id, whether its client admits it: not after
    the day's end, and not while the window holds per_client admitted ones. Sessions of a client that meet in a task
    don't disturb each other, as they are further apart than the window."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, hits = None, deque(maxlen=per_client or 1)
        for b in batches:
            own = np.zeros(b.num_rows, bool)
            for i, (c, at, key, day) in enumerate(zip(*(b.column(n).to_pylist() for n in ("client", "at", "id", "day")))):
                if c != client:
                    client = c
                    hits.clear()
                if (day in ends and (at, key) > ends[day]) or not per_client:
                    continue
                if len(hits) < per_client or at - hits[0] > window:
                    hits.append(at)
                    own[i] = True
            yield b.append_column("own", pa.array(own))

    return make


def _day_ends(admitted: DataFrame, cap: int) -> dict[int, tuple[int, int]]:
    """By day, the time and id of the request that fills the cap; one row a day."""
    into = (F.col("at") - F.col("day") * _DAY) / 1e6
    ranked = running_totals(admitted.select("day", "at", "id"), into, [F.col("at"), F.col("id")], {"place": F.lit(1)}, by=("day",))
    return {r["day"]: (r["at"], r["id"]) for r in ranked.where(F.col("place") == cap).collect()}


def admissions(requests: DataFrame, per_client: int, per_day: int, client: str = "client", at: str = "ts", key: str = "id", window_seconds: int = 3600) -> DataFrame:
    """(id, client, at, admitted, reason): each request once. reason is null for those admitted, else client_limit,
    daily_limit or no_time.

    at is a timestamp (without a zone: in the session's), key a number that orders requests of the same time; days are those of UTC. An admitted request
    counts for its client while it is not more than the window old. Null clients count as one client; requests
    without a time are not admitted and count for nothing. Requests of the same client, time and key are folded one
    after the other. An empty table gives an empty result.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.select(F.col(client).cast("string").alias("client"), micros.alias("at"), F.col(key).cast("long").alias("id"), F.floor(micros / _DAY).cast("long").alias("day"))
    timed = keep(with_sessions(rows.where("at is not null and id is not null"), window_seconds * 1_000_000), "requests")
    sorted_ = timed.rows.repartition("client", "session").sortWithinPartitions("client", "at", "id")
    schema = "client string, at long, id long, day long, session long, own boolean"
    ends: dict[int, tuple[int, int]] = {}
    while True:
        folded = keep(sorted_.mapInArrow(_fold(per_client, window_seconds * 1_000_000, ends), schema), "admitted")
        # with the ends so far, no day has more than its cap; without them, this finds them
        found = _day_ends(folded.rows.where("own"), per_day) if per_day > 0 else {}
        if found == ends:
            break
        ends = found
        folded.drop()
    timed.drop()
    out = folded.rows
    if ends:  # one row a day
        spread = requests.sparkSession.createDataFrame([(d, a, i) for d, (a, i) in sorted(ends.items())], "day long, end_at long, end_id long")
        after = (F.col("at") > F.col("end_at")) | ((F.col("at") == F.col("end_at")) & (F.col("id") > F.col("end_id")))
        out = out.join(F.broadcast(spread), "day", "left").withColumn("closed", F.coalesce(after, F.lit(False)))
    else:
        out = out.withColumn("closed", F.lit(per_day <= 0))
    reason = F.when(F.col("closed"), "daily_limit").when(~F.col("own"), "client_limit")
    rest = rows.where("at is null or id is null").select("id", "client", F.timestamp_micros("at").alias("at"), F.lit(False).alias("admitted"), F.lit("no_time").alias("reason"))
    return out.select("id", "client", F.timestamp_micros("at").alias("at"), (F.col("own") & ~F.col("closed")).alias("admitted"), reason.alias("reason")).unionByName(rest)
