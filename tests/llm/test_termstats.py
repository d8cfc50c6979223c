"""Term frequencies against plain counting, with heavy and light terms."""

import random

import pytest

from siltstone.llm import termstats

SCHEMA = "f string, v string, fid long, w long, items array<string>, heavy int, k1 string, kind int"


def brute(rows):
    out = {}
    for f, v, fid, w, items in rows:
        o = out.setdefault((f, v), [{}, 0, set()])
        if fid is None:
            o[1] += w or 0
        else:
            o[0][fid] = max(o[0].get(fid, -(2**62)), w or 0)
        o[2].update(x for x in items or [] if x is not None)
    return {(*k, sum(ids.values()) + loose, len(items)) for k, (ids, loose, items) in out.items()}


def make(spark, rows):
    return spark.createDataFrame([(*x, 1, "x", 2) for x in rows], SCHEMA)


@pytest.mark.parametrize("share", [3, 1000])
def test_terms(spark, monkeypatch, share):
    monkeypatch.setattr(termstats, "HEAVY_SHARE", share)
    r = random.Random(share)
    rows = [(r.choice(["F", "F", None]), r.choice(["hot", "hot", "a", None, ""]), r.choice([None, *range(100)]), r.choice([None, 1, 2]), r.choice([None, [], ["u", None, str(r.randrange(9))]])) for _ in range(500)]
    owner = {}
    rows = [(*owner.setdefault(fid, (f, v)), fid, w, i) if fid is not None else (f, v, fid, w, i) for f, v, fid, w, i in rows]
    df = make(spark, rows)
    got, total = termstats.term_frequencies(df, ("f", "v"), "fid", "w", "items")
    assert {tuple(x) for x in got.collect()} == brute(rows)
    assert total == len({x for *_, i in rows for x in i or [] if x is not None})


def test_marks(spark):
    df = spark.createDataFrame([("a", "x", 2, 0), ("b", "x", 3, 5), ("c", "x", 1, 4), ("d", "x", 9, 6)], "k1 string, k2 string, occurrences long, records long")
    got = {r["k1"]: (r["rare"], r["common"]) for r in termstats.mark_terms(df, 100).collect()}
    assert got == {"a": (True, False), "b": (False, True), "c": (True, False), "d": (False, True)}
    assert not any(r["common"] for r in termstats.mark_terms(df.where("records = 0"), 0).collect())


def test_empty_and_long(spark):
    assert termstats.term_frequencies(make(spark, []), ("f", "v"), "fid", "w", "items")[0].count() == 0
    long = "y" * 100_000  # heavy, too: long names are listed by their digest
    rows = [("F", long, 1, 2, [long])] * 2 + [("F", long + "z", i, 1, None) for i in range(9)]
    got, total = termstats.term_frequencies(make(spark, rows), ("f", "v"), "fid", "w", "items")
    assert {tuple(r) for r in got.collect()} == {("F", long, 2, 1), ("F", long + "z", 9, 0)} and total == 1


def test_few_rows_with_long_lists_are_heavy(spark):
    """Many heavy terms that share items: more than one word of bits."""
    rows = [("F", f"t{k}", k, 1, [str(i) for i in range(k, k + 40)] + ["0"]) for k in range(100)] + [("G", "light", 1000 + i, 1, ["0", f"g{i}"]) for i in range(3)]
    got, total = termstats.term_frequencies(make(spark, rows * 2), ("f", "v"), "fid", "w", "items")
    assert {tuple(x) for x in got.collect()} == brute(rows) and total == 139 + 3
