"""Change feeds against applying changes one by one."""

import random

import pytest

from siltstone.operators import changefeed
from siltstone.operators.changefeed import ChangeStore, contiguous
from siltstone.storage import children

SCHEMA = "e long, s long, adds array<string>, removes array<string>, f boolean, seq string, entry long, flag int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 1) for r in rows], SCHEMA)


def brute(rows):
    changes, flagged = {}, set()
    for e, s, adds, removes, f in rows:
        if e is None or s is None:
            continue
        c = changes.setdefault((e, s), (set(), set()))
        c[0].update(x for x in adds or [] if x is not None)
        c[1].update(x for x in removes or [] if x is not None)
        if f:
            flagged.add(e)
    state = {}
    for (e, _), (adds, removes) in sorted(changes.items(), key=lambda x: x[0]):
        held = state.setdefault(e, set())
        held -= removes
        held |= adds - removes
    return {(e, u) for e, us in state.items() if e not in flagged for u in us}


def apply(store, spark, rows):
    store.apply(frame(spark, rows), "e", "s", "adds", "removes", "f")


def current(store):
    return {(r["entry"], r["uid"]) for r in store.current().collect()}


@pytest.mark.parametrize("seed", range(3))
def test_any_order(spark, seed):
    r = random.Random(seed)
    some = lambda: r.choice([None, [], [r.choice("abcd") for _ in range(r.randrange(1, 4))], ["a", None]])
    changes = {(e, s): (e, s, some(), some(), r.random() < 0.01) for e in range(4) for s in r.sample(range(1, 60), 30)}
    rows = [r.choice(list(changes.values())) for _ in range(60)] + list(changes.values()) + [(None, 1, ["x"], None, None), (1, None, ["x"], None, None)]
    r.shuffle(rows)
    store = ChangeStore(spark)
    for k in range(0, len(rows), 70):
        apply(store, spark, rows[k : k + 70])
    store.close()
    assert current(store) == brute(rows)
    store.compact()
    assert current(store) == brute(rows)
    store.store.vacuum()
    assert current(store) == brute(rows)


def test_gaps_are_held(spark):
    store = ChangeStore(spark)
    apply(store, spark, [(1, 1, ["a"], None, None), (1, 3, ["c"], ["a"], None), (2, 2, ["z"], None, None)])
    assert current(store) == {(1, "a")}
    assert {(r["entry"], r["watermark"]) for r in store.entries().collect()} >= {(1, 1)}
    apply(store, spark, [(1, 2, ["b"], None, None)])
    assert current(store) == {(1, "b"), (1, "c")}
    store.close()
    assert current(store) == {(1, "b"), (1, "c"), (2, "z")}


def test_removed_wins_within_a_change(spark):
    store = ChangeStore(spark)
    apply(store, spark, [(1, 1, ["a", "b"], ["a"], False), (1, 1, ["b", "a"], ["a"], False)])
    assert current(store) == {(1, "b")}


def test_flag_empties(spark):
    store = ChangeStore(spark)
    apply(store, spark, [(1, 1, ["a"], None, None), (1, 2, None, None, True), (2, 1, ["q"], None, False)])
    assert current(store) == {(2, "q")}


def test_empty(spark):
    store = ChangeStore(spark)
    apply(store, spark, [(None, None, None, None, None)])
    store.close()
    assert current(store) == set()


@pytest.mark.parametrize("have", [[1, 2, 3], [2, 3], list(range(1, 40)), list(range(1, 1025)), list(range(1, 1100)), [*range(1, 1050), *range(1051, 3000)], [1, 2, *range(2000, 2040)], list(range(1, 33)), [0, -4, 1]])
def test_contiguous(spark, have):
    want = 0
    while want + 1 in have:
        want += 1
    df = spark.createDataFrame([(9, s) for s in have * 2], "entry long, seq long")
    assert [r["watermark"] for r in contiguous(df, 0).collect()] in ([want], [] if want == 0 else [want])


def test_folders_stay_few(spark, monkeypatch):
    """What a batch reads is level however many there were: old folders are rewritten as one and removed."""
    monkeypatch.setattr(changefeed, "FOLDERS", 3)
    store, rows = ChangeStore(spark), []
    for k in range(1, 8):
        batch = [(1, k, [f"u{k % 3}", "x"], [f"u{(k + 1) % 3}"], False)] + ([(9, 1, ["y"], None, None)] if k == 1 else [])
        rows += batch
        apply(store, spark, batch + rows[:1])
        assert len(store.store.parts("state")) <= 3 and len(children(spark, f"{store.store.path}/state")) <= 3
        if k in (2, 3):  # an entry without changes is not written again
            newest = max(store.store.parts("entries").items(), key=lambda x: int(x[0]))[1]["dir"]
            assert {r["entry"] for r in spark.read.parquet(newest).collect()} == {1}
    assert current(store) == brute(rows)
    assert {(r["entry"], r["watermark"]) for r in store.entries().collect()} == {(1, 7), (9, 1)}


def test_text_keys(spark):
    store = ChangeStore(spark, key="string")
    df = spark.createDataFrame([("a/b", 1, ["x"], None, None), ("", 1, ["y"], None, None)], "k string, s long, adds array<string>, removes array<string>, f boolean")
    store.apply(df, "k", "s", "adds", "removes", "f")
    again = ChangeStore(spark, store.store.path)
    assert again.key == "string" and current(again) == {("a/b", "x"), ("", "y")}
