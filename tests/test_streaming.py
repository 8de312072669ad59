"""Streams give the rows of the batch, after late rows, disorder and a restart too."""

import random
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pricemill.operators import audit
from pricemill.streaming import lifecycle, outcomes, weekly

START = datetime(2024, 1, 1)


def test_windows_of_a_stream_equal_the_batch(spark, sf_dir, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in/events.parquet")
    stream = weekly.windowed_totals(weekly.read_events(spark, f"file://{tmp_path}/in"))
    weekly.append_batches(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = weekly.windowed_totals(events)
    last = got.agg(F.max("end")).first()[0]
    assert got.count() > 0 and last <= events.agg(F.max("ts")).first()[0]
    key = lambda r: (r["start"], r["event_type"], r["n"], round(r["total"], 4))
    assert sorted(map(key, got.collect())) == sorted(key(r) for r in batch.collect() if r["end"] <= last)


def test_late_outcomes_equal_the_batch_join(spark, tmp_path):
    made = [(f"r{i}", i % 7, i % 3, i // 21, START + timedelta(days=7 * (i // 21)), float(i)) for i in range(21 * 6)]
    sold = [(u, s, w, at + timedelta(days=6), p + 1) for r, u, s, w, at, p in made if int(r[1:]) % 5]
    sold.append((*sold[0][:3], made[0][4] + timedelta(days=40), 99.0))  # beyond the span: no outcome
    recs = spark.createDataFrame(made, "rec_id string, upc long, store long, week long, decided_for timestamp, predicted double")
    sales = spark.createDataFrame(sold, "upc long, store long, week long, sold_at timestamp, move double")
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/{name}")
    for wave in range(3):  # the odd sales of a wave come a wave later; each wave is a run of its own, from the checkpoint
        recs.where(F.floor(F.col("week") / 2) == wave).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/recs")
        late = F.floor(F.col("week") / 2) + F.when(F.col("upc") % 2 == 1, 1).otherwise(0)
        sales.where(F.least(late, F.lit(2)) == wave).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/sales")
        stream = outcomes.matched(read("recs", recs), read("sales", sales), late="28 days")
        weekly.append_batches(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    # rows far ahead move the watermarks past everything
    end = START + timedelta(days=400)
    for name, rows, kind in (("recs", [("end", 99, 0, 99, end, 0.0)], recs), ("sales", [(99, 0, 99, end + timedelta(days=1), 0.0)], sales)):
        spark.createDataFrame(rows, kind.schema).write.mode("append").parquet(f"file://{tmp_path}/{name}")
    for _ in range(2):
        stream = outcomes.matched(read("recs", recs), read("sales", sales), late="28 days")
        weekly.append_batches(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    found = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").drop("batch").where("rec_id <> 'end'").collect()]
    expected = [tuple(r) for r in outcomes.matched(recs, sales).collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert sum(r[-1] is None for r in found) == len([r for r in made if int(r[0][1:]) % 5 == 0])


def _plain(log, rows):
    out = []
    states = {}
    for rec, at, to, actor, note in sorted(set(rows), key=lambda r: (r[1], r[2], r[3])):
        if rec not in log:
            out.append((rec, at, None, to, actor, note, False, "unknown"))
            continue
        old = states.get(rec, "GENERATED")
        good = to in audit.TRANSITIONS[old]
        states[rec] = to if good else old
        out.append((rec, at, old, to, actor, note, good, None if good else "illegal"))
    return out


KIND = "rec_id string, at timestamp, to_state string, actor string, note string"


def _transitions():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        life = ["REVIEWED", "APPROVED", "PUBLISHED"] if i % 3 else ["REVIEWED", "REJECTED", "PUBLISHED"]
        for k, to in enumerate(life):
            rows.append((f"r{i}", START + timedelta(minutes=i + 20 * k), to if rng.random() < 0.8 else rng.choice(list(audit.TRANSITIONS)), f"a{k}", None))
    rows += rng.sample(rows, 40)  # sent again
    rng.shuffle(rows)
    return rows


def test_batch_fold_of_transitions(spark):
    rows, log = _transitions(), {f"r{i}" for i in range(55)}
    known = spark.createDataFrame([(r, "x") for r in sorted(log)] * 2, "rec_id string, at string")
    found = [tuple(r) for r in audit.fold_transitions(known, spark.createDataFrame(rows, KIND).repartition(5)).collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(found, key=key) == sorted(_plain(log, rows), key=key)
    assert {r[-1] for r in found} == {None, "illegal", "unknown"}
    odd = spark.createDataFrame([("r1", None, "REVIEWED", "a", None), (None, START, "REVIEWED", "a", None), ("r1", START, None, None, None)], KIND)
    assert sorted(r["reason"] for r in audit.fold_transitions(known, odd).collect()) == ["illegal", "unknown", "unknown"]
    assert audit.fold_transitions(known, odd.limit(0)).count() == 0


def test_keyed_state_equals_the_batch_fold(spark, tmp_path):
    rows, log = _transitions(), {f"r{i}" for i in range(55)}
    known = spark.createDataFrame([(r,) for r in sorted(log)], "rec_id string")
    # a wave holds later times than the one before, but out of order within it and with some up to an hour late
    rng = random.Random(12)
    arrives = [(r, (r[1] - START).total_seconds() / 60 + rng.random() * 45) for r in rows]
    steps = lambda: lifecycle.steps(spark.readStream.schema(KIND).parquet(f"file://{tmp_path}/in"), known, late="1 hour")
    run = lambda: lifecycle.keep_steps(steps(), f"file://{tmp_path}/good", f"file://{tmp_path}/bad", f"file://{tmp_path}/ck").awaitTermination()
    for wave in range(3):  # each run goes on from the checkpoint of the one before
        own = [r for r, at in arrives if min(int(at // 40), 2) == wave]
        spark.createDataFrame(own, KIND).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        run()
    spark.createDataFrame([("none", START + timedelta(days=9), "REVIEWED", "end", None)], KIND).write.mode("append").parquet(f"file://{tmp_path}/in")
    run()
    run()
    good = [(*tuple(r)[:6], True, None) for r in spark.read.parquet(f"file://{tmp_path}/good").drop("batch").collect()]
    bad = [(*tuple(r)[:6], False, r["reason"]) for r in spark.read.parquet(f"file://{tmp_path}/bad").drop("batch").where("rec_id <> 'none'").collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    # an unknown recommendation has no state, so its repeats are not told apart
    assert sorted({*good, *bad}, key=key) == sorted(_plain(log, rows), key=key)
    assert len(good) == len(set(good)) and good and bad
