"""Per-key totals against plain counting, with keys that fill several partitions."""

import random

import pytest

from siltstone.operators.skew import key_totals

SCHEMA = "f string, v string, fid long, w long, items array<string>, k1 string, kind int, edge boolean"


def brute(rows):
    out = {}
    for f, v, fid, w, items in rows:
        o = out.setdefault((f, v), [0, {}, 0, 0, set()])
        o[0] += 1
        if fid is None:
            o[2] += 1
            o[3] += w or 0
        else:
            o[1][fid] = max(o[1].get(fid, -(2**62)), w or 0)
        o[4].update(x for x in items or [] if x is not None)
    return {(*k, n, len(ids) + loose, sum(ids.values()) + lw, len(items)) for k, (n, ids, loose, lw, items) in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_heavy_keys(spark, seed):
    r = random.Random(seed)
    key = lambda: ("F", "hot") if r.random() < 0.5 else (r.choice(["F", "G", None, ""]), r.choice(["hot", "a", "b", None, "", "=", "-"]))
    rows = [(*key(), r.choice([None, *range(300)]), r.choice([None, 1, 2, 3]), r.choice([None, [], [str(r.randrange(50)), str(r.randrange(50)), None]])) for _ in range(2000)]
    # One id belongs to one key.
    owner = {}
    rows = [(*owner.setdefault(fid, (f, v)), fid, w, i) if fid is not None else (f, v, fid, w, i) for f, v, fid, w, i in rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*x, "x", 1, True) for x in rows], SCHEMA).repartition(5)
        got = {tuple(x) for x in key_totals(df, ("f", "v"), "fid", "w", "items").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert key_totals(df, ("f", "v"), "fid", "w", "items").count() == 0
    long = "x" * 200_000
    df = spark.createDataFrame([("F", long, 1, 2, [long, long], "x", 1, True)] * 3, SCHEMA)
    assert [tuple(x) for x in key_totals(df, ("f", "v"), "fid", "w", "items").collect()] == [("F", long, 3, 1, 2, 1)]


def test_rows_without_id_of_one_key(spark):
    """However many there are, they reach the ordered step as a few rows."""
    df = spark.range(20_000).selectExpr("'F' AS f", "'hot' AS v", "CAST(NULL AS BIGINT) AS fid", "2L AS w", "array('a') AS items", "'x' AS k1", "1 AS kind", "true AS edge")
    got = key_totals(df, ("f", "v"), "fid", "w", "items")
    assert [tuple(x) for x in got.collect()] == [("F", "hot", 20_000, 20_000, 40_000, 1)]
