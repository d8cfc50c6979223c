"""Sessions against a plain loop over sorted events."""

import random

import pytest

from siltstone.operators import sessions
from siltstone.operators.sessions import SessionStore, arrival_batches

GAP = 1_800_000
SCHEMA = "who string, at long, id string, user string, start long, n_events long"


def brute(rows):
    """{(user, start, end, n)}; rows of one id are one event, the earliest (time, user)."""
    by_id = {}
    for who, at, id_, *_ in rows:
        u = who.strip().lower() if who is not None else ""
        if u and at is not None:
            key = ("id", id_) if id_ is not None else ("none", u, at)
            by_id[key] = min(by_id.get(key, (at, u)), (at, u))
    out, users = set(), {}
    for at, u in by_id.values():
        users.setdefault(u, []).append(at)
    for u, times in users.items():
        times.sort()
        first = last = times[0]
        n = 0
        for t in times:
            if t - last > GAP:
                out.add((u, first, last, n))
                first, n = t, 0
            last, n = t, n + 1
        out.add((u, first, last, n))
    return out


def frame(spark, rows):
    # Other columns carry names that the operator uses itself.
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def result(store):
    return {(r["user"], r["start_ms"], r["end_ms"], r["n_events"]) for r in store.sessions().collect()}


@pytest.mark.parametrize("seed", range(3))
def test_batches_in_any_order(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["A", " a ", "b", "B\t", "", None, "  "]), r.choice([None, *[r.randrange(0, 40) * GAP // 2 + r.randrange(3) for _ in range(9)]]), r.choice([None, *map(str, range(60))])) for _ in range(150)]
    # An id keeps its user and time, as in the data.
    seen = {}
    rows = [(*seen.setdefault(i, (u, t)), i) if i is not None else (u, t, i) for u, t, i in rows]
    store = SessionStore(spark)
    r.shuffle(rows)
    for k in range(0, 150, 50):
        store.apply(frame(spark, rows[k : k + 50]), "who", "at", "id")
    assert result(store) == brute(rows)


def test_gap_is_inclusive_and_bridges_merge(spark):
    store = SessionStore(spark)
    store.apply(frame(spark, [("u", 0, "1"), ("u", 2 * GAP, "2"), ("u", -GAP - 1, "0")]), "who", "at", "id")
    assert len(result(store)) == 3
    store.apply(frame(spark, [("u", GAP, "3"), ("u", GAP, "4")]), "who", "at", "id")
    assert result(store) == {("u", 0, 2 * GAP, 4), ("u", -GAP - 1, -GAP - 1, 1)}


def test_repeated_batch_changes_nothing(spark):
    store = SessionStore(spark)
    for _ in range(2):
        store.apply(frame(spark, [("u", 5, "1"), ("u", 5, "1"), ("u", 6, None)]), "who", "at", "id")
    assert result(store) == {("u", 5, 6, 2)}


def test_empty(spark):
    store = SessionStore(spark)
    store.apply(frame(spark, [(None, 1, "1"), ("u", None, "2")]), "who", "at", "id")
    assert result(store) == set() and store.store.version == 0


def test_extreme_times_and_long_names(spark):
    low, high = -(2**63), 2**63 - 1
    store = SessionStore(spark)
    store.apply(frame(spark, [("u" * 100_000, low, "1"), ("u" * 100_000, high, "2"), ("u" * 100_000, low + 1, "3")]), "who", "at", "id")
    assert {r[1:] for r in result(store)} == {(low, low + 1, 2), (high, high, 1)}


def test_old_periods_keep_their_files(spark):
    store = SessionStore(spark, period_ms=GAP * 10)
    store.apply(frame(spark, [("u", 0, "1")]), "who", "at", "id")
    before = store.store.parts("sessions")["0/0@1"]["dir"]
    store.apply(frame(spark, [("u", GAP * 100, "2"), ("u", -GAP * 100, "3")]), "who", "at", "id")
    assert store.store.parts("sessions")["0/0@1"]["dir"] == before and len(result(store)) == 3
    store.store.vacuum()
    assert len(result(store)) == 3


def test_buckets_of_other_users_keep_their_files(spark):
    store = SessionStore(spark, buckets=64)
    store.apply(frame(spark, [(f"u{i}", i, str(i)) for i in range(40)]), "who", "at", "id")
    before = {p["dir"] for p in store.store.parts("sessions").values()}
    store.apply(frame(spark, [("u0", GAP // 2, "x")]), "who", "at", "id")
    assert len(before & {p["dir"] for p in store.store.parts("sessions").values()}) == len(before) - 1
    assert ("u0", 0, GAP // 2, 2) in result(store) and len(result(store)) == 40


def test_many_batches(spark, monkeypatch):
    """Folders of ids stay few, and a batch replaces the sessions of its own period only."""
    monkeypatch.setattr(sessions, "FOLDERS", 3)
    store, rows = SessionStore(spark, period_ms=GAP * 10), []
    for k in [0, 0, 0, 0, 5, 9]:
        batch = [(r, GAP * 5 * k + 10 * i + len(rows), f"{len(rows)}-{i}") for i, r in enumerate("abc")]
        rows += batch
        store.apply(frame(spark, batch + batch[:1]), "who", "at", "id")
        assert sum(p.startswith("0@") for p in store.store.parts("events")) < 3
    assert result(store) == brute(rows)


def test_two_writers(spark):
    a = SessionStore(spark)
    b = SessionStore(spark, a.store.path)
    a.apply(frame(spark, [("u", 0, "1")]), "who", "at", "id")
    with pytest.raises(RuntimeError):
        b.apply(frame(spark, [("u", 1, "2")]), "who", "at", "id")
    assert result(SessionStore(spark, a.store.path)) == {("u", 0, 0, 1)}


def test_arrival_batches(spark):
    df = spark.sql("SELECT id, CAST(IF(id = 3, NULL, timestamp_seconds(id)) AS timestamp_ntz) AS t FROM range(10)")
    parts = arrival_batches(df, "t", 3)
    assert sorted(r["id"] for p in parts for r in p.collect()) == list(range(10)) and len(parts) == 3
    assert len(arrival_batches(df.where("false"), "t", 3)) == 1
