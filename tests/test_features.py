"""Feature rows against plain counting."""

import random

from pyspark.sql import functions as F

import pytest

from siltstone.operators import features
from siltstone.plans import core_problems

SCHEMA = "u string, t string, at long, amount long, id string, salt int, n long, entity string"


def brute(rows, types, as_of):
    out = {}
    for u, t, at, amount, _ in rows:
        if u is not None:
            out.setdefault(u, []).append((t, at, amount or 0))
    def cell(es):
        times = [a for _, a, _ in es if a is not None]
        return [len(es), as_of - max(times) if times else None, sum(x for _, _, x in es)]

    return {(u, *cell(es), *[x for t in types for x in cell([e for e in es if e[0] == t])]) for u, es in out.items()}


def test_features(spark, monkeypatch):
    monkeypatch.setattr(features, "HEAVY_SHARE", 5)
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", None]), r.choice(["X", "X", "Y", "it's `odd`", None, "unlisted"]), r.choice([None, r.randrange(1000)]), r.choice([None, 1, 5]), str(i)) for i in range(400)]
    types = ["X", "Y", "it's `odd`", "never"]
    df = spark.createDataFrame([(*x, 1, 2, "z") for x in rows], SCHEMA)
    got = features.feature_table(df, F.col("u"), "t", "at", "amount", "id", types, 1000)
    assert {tuple(x) for x in got.collect()} == brute(rows, types, 1000)
    assert "n_it's `odd`" in got.columns


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert features.feature_table(df, F.col("u"), "t", "at", "amount", "id", ["X"], None).collect() == []
    one = spark.createDataFrame([("a", None, None, None, None, 1, 2, "z")], SCHEMA)
    assert [tuple(x) for x in features.feature_table(one, F.col("u"), "t", "at", "amount", "id", [], None).collect()] == [("a", 1, None, 0)]


def test_too_many_types_are_an_error(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/query_metric.parquet").write.parquet(str(tmp_path / "query_metric.parquet"))
    spark.range(5001).selectExpr("concat('t', id) AS query_type").write.parquet(str(tmp_path / "query_kind.parquet"))
    with pytest.raises(ValueError, match="5000 types"):
        core_problems.p7_features(spark, str(tmp_path))
