"""Linear counting: sizing, error, merging and the lattice of combinations."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import bitmaps


@pytest.mark.parametrize("capacity", [0, 1, 1000, 10**6, 10**9])
def test_sizing(capacity):
    bits = bitmaps.size_bits(capacity, 0.01)
    n = max(1, capacity)
    while n >= 1:
        assert bitmaps.relative_error(n, bits) <= 0.0101
        n //= 3


def test_estimates_and_merging(spark):
    ids = spark.range(200_000).selectExpr("concat('u', id % 50000) as id", "if(id % 3 = 0, 'a', if(id % 3 = 1, null, 'b')) as g", "cast(id % 2 as string) as h", "id as word", "id as at")
    bits = bitmaps.size_bits(200_000)
    cube = bitmaps.cube(bitmaps.build(ids, ["g", "h"], bits), ["g", "h"])
    got = {(r["level"], r["g"], r["h"]): r for r in bitmaps.estimate(cube, ["level", "g", "h"]).collect()}
    exact = {}
    for r in ids.cube("g", "h").agg(F.grouping_id().alias("gid"), F.count_distinct("id").alias("n")).collect():
        exact[{0: "g,h", 1: "g", 2: "h", 3: "all"}[r["gid"]], r["g"], r["h"]] = r["n"]
    assert set(got) == set(exact)
    for k, n in exact.items():
        assert abs(got[k]["estimate"] - n) <= 0.03 * n and got[k]["lower"] <= got[k]["estimate"] <= got[k]["upper"]
    halves = [bitmaps.build(ids.where(f"word % 2 = {i}"), ["g"], bits) for i in (0, 1)]
    merged = bitmaps.merge(halves[0].unionByName(halves[1]), ["g"])
    whole = bitmaps.build(ids, ["g"], bits)
    assert merged.exceptAll(whole).count() == whole.exceptAll(merged).count() == 0


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("b", "x")], "g string, id string")
    maps = bitmaps.build(df, ["g"], 8192)
    assert {r["g"]: r["estimate"] for r in bitmaps.estimate(maps, ["g"]).collect()} == {"b": 1}
    assert bitmaps.estimate(bitmaps.cube(bitmaps.build(df.where("false"), ["g"], 8192), ["g"]), ["level", "g"]).collect() == []


def test_parts_of_other_sizes_unite(spark):
    """A day sized for few and one sized for many: the union is what building both at the smaller size gives."""
    ids = spark.range(30_000).selectExpr("concat('u', id) as id", "if(id % 2 = 0, 'a', null) as g")
    first, second = ids.where("hash(id) % 3 = 0"), ids.where("hash(id) % 3 <> 0 or hash(id) % 7 = 0")
    got = bitmaps.unite([bitmaps.build(first, ["g"], 8192), bitmaps.build(second, ["g"], 1 << 17)], ["g"])
    want = bitmaps.build(ids, ["g"], 8192)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    for r in bitmaps.estimate(got, ["g"]).collect():
        assert abs(r["estimate"] - 15_000) <= 5 * r["std_error"] * 15_000
    none = bitmaps.build(ids.where("false"), ["g"], 8192)
    assert bitmaps.unite([none, none], ["g"]).collect() == []
