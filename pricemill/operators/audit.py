"""The recommendation log, its states, and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states and where each may lead.
TRANSITIONS = {"GENERATED": ("REVIEWED",), "REVIEWED": ("APPROVED", "REJECTED"), "APPROVED": ("PUBLISHED",), "REJECTED": (), "PUBLISHED": ()}


class TransitionError(ValueError):
    """A state does not lead to the one asked for."""


def check_transition(old: str, new: str) -> None:
    if new not in TRANSITIONS.get(old, ()):
        raise TransitionError(f"{old} does not lead to {new}")


def log_rows(recommendations: DataFrame, generated_at: str) -> DataFrame:
    """Recommendations as log rows; rec_id is text and the same for the same context and time."""
    rec_id = F.substring(F.sha2(F.concat_ws("|", F.lit(generated_at), "upc", "store", "week"), 256), 1, 12)
    return recommendations.select(rec_id.alias("rec_id"), F.lit(generated_at).alias("generated_at"), "*")


def current_state(log: DataFrame, transitions: DataFrame) -> DataFrame:
    """log with the state of the latest transition of each row, GENERATED without one."""
    latest = transitions.groupBy("rec_id").agg(F.max_by("to_state", F.struct("transitioned_at_utc", "to_state")).alias("state"))
    return log.join(latest, "rec_id", "left").withColumn("state", F.coalesce("state", F.lit("GENERATED")))


def review_queue(log: DataFrame, transitions: DataFrame) -> DataFrame:
    """Rows whose state is not final."""
    final = [s for s, to in TRANSITIONS.items() if not to]
    return current_state(log, transitions).where(~F.col("state").isin(*final))


TRANSITION = "transitioned_at_utc string, rec_id string, from_state string, to_state string, actor string, note string"


def append_transition(log: DataFrame, transitions: DataFrame, rec_id: str, to_state: str, at: str, actor: str | None = None, note: str | None = None) -> DataFrame:
    """The one row to append to the transitions: an unknown rec_id or a step that the states don't allow is an error."""
    row = current_state(log.where(F.col("rec_id") == rec_id).select("rec_id"), transitions).first()
    if row is None:
        raise TransitionError(f"no recommendation {rec_id}")
    check_transition(row["state"], to_state)
    return log.sparkSession.createDataFrame([(at, rec_id, row["state"], to_state, actor, note)], TRANSITION)


def first_state() -> str:
    """The state that none leads to."""
    return next(s for s in TRANSITIONS if not any(s in to for to in TRANSITIONS.values()))


def fold_transitions(log: DataFrame, transitions: DataFrame) -> DataFrame:
    """(rec_id, at, from_state, to_state, actor, note, accepted, reason): each transition once, applied in the order of its
    time to the state that those before it left. What a state does not allow, or is of a rec_id the log lacks, is
    not accepted, with reason illegal or unknown, and changes nothing. The same row sent again counts once; of equal
    times the lower state by name comes first. Rows without a rec_id or a time are unknown."""
    kind = "array<struct<at timestamp, from_state string, to_state string, actor string, note string, accepted boolean>>"
    known = log.select("rec_id", F.lit(True).alias("__known")).distinct()
    seen = transitions.select("rec_id", "at", "to_state", "actor", "note").join(known, "rec_id", "left")
    good = F.col("__known").isNotNull() & F.col("at").isNotNull()
    allowed = F.create_map(*(x for s, to in TRANSITIONS.items() for x in (F.lit(s), F.array(*map(F.lit, to)).cast("array<string>"))))

    def apply(done, step):
        fits = F.coalesce(F.array_contains(F.try_element_at(allowed, done.state), step.to_state), F.lit(False))
        row = F.struct(step.at.alias("at"), done.state.alias("from_state"), step.to_state.alias("to_state"), step.actor.alias("actor"), step.note.alias("note"), fits.alias("accepted"))
        return F.struct(F.when(fits, step.to_state).otherwise(done.state).alias("state"), F.concat(done.rows, F.array(row)).alias("rows"))

    start = F.struct(F.lit(first_state()).alias("state"), F.array().cast(kind).alias("rows"))
    by = seen.where(good).groupBy("rec_id").agg(F.array_sort(F.collect_set(F.struct("at", "to_state", "actor", "note"))).alias("s"))
    applied = by.select("rec_id", F.explode(F.aggregate("s", start, apply, lambda done: done.rows)).alias("r")).select("rec_id", "r.*")
    applied = applied.withColumn("reason", F.when(~F.col("accepted"), "illegal"))
    unknown = seen.where(~good).distinct().select("rec_id", "at", F.lit(None).cast("string").alias("from_state"), "to_state", "actor", "note", F.lit(False).alias("accepted"), F.lit("unknown").alias("reason"))
    return applied.unionByName(unknown)


def as_documents(log: DataFrame) -> DataFrame:
    """(rec_id, document): each log row as JSON, its codes as a map to their places; nulls are left out."""
    fields = [c for c in log.columns if c not in ("rec_id", "reason_codes")]
    codes = F.map_from_entries(F.transform("reason_codes", lambda c, i: F.struct(c, i + 1)))
    return log.select("rec_id", F.to_json(F.struct(*fields, F.map_from_entries(F.array_distinct(F.map_entries(codes))).alias("reason_codes"))).alias("document"))


def from_documents(documents: DataFrame) -> DataFrame:
    """(rec_id, decision, recommended_price, codes) read back from as_documents, the codes in their order."""
    parsed = F.from_json("document", "decision string, recommended_price double, reason_codes map<string,int>")
    rows = documents.withColumn("__d", parsed)
    ordered = F.transform(F.array_sort(F.transform(F.map_entries("__d.reason_codes"), lambda e: F.struct(e.value.alias("at"), e.key.alias("code")))), lambda x: x.code)
    return rows.select("rec_id", "__d.decision", "__d.recommended_price", ordered.alias("codes"))
