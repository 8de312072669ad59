"""Admission against the plain limiter that sees all requests in order."""

import random
from collections import defaultdict, deque
from datetime import UTC, datetime, timedelta

import pytest

from pricemill.operators.admission import admissions, with_sessions
from pricemill.plans import queries

START = datetime(2024, 1, 1, tzinfo=UTC)
COLUMNS = "id long, client string, ts timestamp"


def _plain(rows, per_client, per_day, window=3600):
    """Request by request, as they come."""
    hits, today, out = defaultdict(deque), defaultdict(int), {}
    for i, c, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        own, day = hits[c], t.date()
        while own and (t - own[0]).total_seconds() > window:
            own.popleft()
        if today[day] >= per_day:
            out[i] = "daily_limit"
        elif len(own) >= per_client:
            out[i] = "client_limit"
        else:
            own.append(t)
            today[day] += 1
            out[i] = None
    return out | {r[0]: "no_time" for r in rows if r[2] is None}


@pytest.mark.parametrize(("per_client", "per_day"), [(1, 40), (3, 60), (2, 10_000), (5, 1), (2, 0)])
def test_admission_equals_the_plain_limiter(spark, per_client, per_day):
    rng = random.Random(per_day)
    rows = []
    for i in range(1500):
        # close to midnight, so that a day that is full leaves its mark on the next
        at = START + timedelta(days=rng.randrange(4), seconds=rng.choice([rng.randrange(86400), 86399 - rng.randrange(1500), rng.randrange(1500)]))
        rows.append((i, rng.choice(["hot", "hot", "a", "b", "c", None]), at if i % 97 else None))
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    found = admissions(df, per_client, per_day).collect()
    assert len(found) == len(rows) and all(r["admitted"] == (r["reason"] is None) for r in found)
    assert {r["id"]: r["reason"] for r in found} == _plain([(i, c, t) for i, c, t in rows], per_client, per_day)


def test_sessions_are_further_apart_than_the_window(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([0, 50, 51, 52, 400]) * 1000 + rng.randrange(3000)) for c in ("a", "b", None) for _ in range(60)]
    found = with_sessions(spark.createDataFrame(rows, "client string, at long"), 1000).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r["client"], r["session"]].append(r["at"])
    assert len(by) == 9
    for (client, _), own in by.items():
        others = [at for (c, _), x in by.items() if c == client and x is not own for at in x]
        assert all(abs(a - b) > 1000 for a in own for b in others)


def test_no_requests(spark):
    assert admissions(spark.createDataFrame([], COLUMNS), 3, 5).count() == 0
    only = spark.createDataFrame([(1, "a", None)], COLUMNS)
    assert [r["reason"] for r in admissions(only, 3, 5).collect()] == ["no_time"]


def test_events_are_admitted_as_by_the_plain_limiter(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts").collect()
    found = {r["event_id"]: r["reason"] for r in queries.admitted_events(spark, sf_dir).collect()}
    expected = _plain([(r["event_id"], r["user_id"], r["ts"]) for r in events], queries.PER_CLIENT, queries.PER_DAY)
    assert found == expected and len(set(expected.values())) == 3
