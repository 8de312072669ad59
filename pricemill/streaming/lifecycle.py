"""The life of recommendations as keyed state: transitions are applied in the order of their times, whatever order they
arrive in, and those that a state does not allow go to a table beside."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricemill.operators.audit import TRANSITIONS, first_state

STEPS = "rec_id string, at timestamp, from_state string, to_state string, actor string, note string, accepted boolean, reason string"
_STATE = "state string, waiting string"


def _plain(value: Any) -> Any:
    return None if value is None or value != value else value


def _settle(state: str, waiting: list[list], upto: int) -> tuple[str, list[list], list[tuple]]:
    """Applies what waits up to a time, in order: (the state after it, what still waits, the steps)."""
    rows, rest = [], []
    for at, to, actor, note in sorted(waiting, key=lambda w: (w[0], *(x or "" for x in w[1:]))):
        if at > upto:
            rest.append([at, to, actor, note])
            continue
        allowed = to in TRANSITIONS.get(state, ())
        rows.append((at, state, to, actor, note, allowed, None if allowed else "illegal"))
        state = to if allowed else state
    return state, rest, rows


def _step(key: tuple[str], batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    state, waiting = group.get if group.exists else (first_state(), "[]")
    waiting = json.loads(waiting)
    if not group.hasTimedOut:
        for b in batches:
            for at, to, actor, note in zip(b["at"], b["to_state"], b["actor"], b["note"]):
                row = [int(pd.Timestamp(at).value // 1000), _plain(to), _plain(actor), _plain(note)]
                if row not in waiting:  # the same transition sent again
                    waiting.append(row)
    watermark = group.getCurrentWatermarkMs()
    state, waiting, rows = _settle(state, waiting, watermark * 1000)
    group.update((state, json.dumps(waiting)))
    if waiting:
        group.setTimeoutTimestamp(max(-(-min(w[0] for w in waiting) // 1000), watermark + 1))
    if rows:
        at, old, to, actor, note, accepted, reason = map(list, zip(*rows))
        yield pd.DataFrame({"rec_id": key[0], "at": pd.to_datetime(at, unit="us"), "from_state": old, "to_state": to, "actor": actor, "note": note, "accepted": accepted, "reason": reason})


def steps(transitions: DataFrame, log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each transition (rec_id, at, to_state, actor, note) of a stream once, with the state it met, whether it was accepted, and
    why not: illegal, or unknown where the log (a table) has no such rec_id. A transition waits until the watermark has passed
    its time, so that one that happened before it but arrives later is applied first; what is later than `late` is
    dropped and counted in the query's progress. The same row sent again counts once. Of equal times the lower state
    by name comes first. Rows without a rec_id or a time are unknown."""
    known = log.select("rec_id", F.lit(True).alias("__known")).distinct()
    seen = transitions.select("rec_id", "at", "to_state", "actor", "note").withWatermark("at", late).join(known, "rec_id", "left")
    good = F.col("__known").isNotNull() & F.col("at").isNotNull()
    applied = seen.where(good).drop("__known").groupBy("rec_id").applyInPandasWithState(_step, STEPS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    unknown = seen.where(~good).select(
        "rec_id", "at", F.lit(None).cast("string").alias("from_state"), "to_state", "actor", "note", F.lit(False).alias("accepted"), F.lit("unknown").alias("reason")
    )
    return applied.unionByName(unknown)


def keep_steps(stream: DataFrame, accepted: str, refused: str, checkpoint: str):
    """Writes accepted steps below one path and the others below another, each micro-batch in a folder of its number, so
    that a batch which is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # read twice
        try:
            rows.where("accepted").drop("accepted", "reason").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
            rows.where("not accepted").drop("accepted").write.mode("overwrite").parquet(f"{refused}/batch={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
