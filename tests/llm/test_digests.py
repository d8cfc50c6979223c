"""Percentiles: exactness where clusters are values, rank errors elsewhere, merging, and the certificate."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.llm import digests

QS = [0.01, 0.25, 0.5, 0.9, 0.99]


def rank_error(values, q, v):
    values = np.sort(values)
    return max(0.0, np.searchsorted(values, v) / len(values) - q, q - np.searchsorted(values, v, "right") / len(values))


def run(spark, groups, parts=3):
    pdf = pd.concat([pd.DataFrame({"g": g, "value": v}) for g, v in groups.items()])
    df = spark.createDataFrame(pdf).withColumn("mean", F.lit("x")).drop("mean").repartition(parts)
    d = digests.digest(df, ["g"])
    return df, d, digests.estimates(d, ["g"], QS)


def test_rank_error_of_skewed_groups(spark):
    r = np.random.default_rng(0)
    groups = {"log": r.lognormal(5, 2, 30_000), "few": r.integers(0, 5, 5000).astype(float), "one": np.array([7.0]), "small": np.arange(40.0)}
    df, d, est = run(spark, groups)
    got = {x["g"]: x for x in est.collect()}
    for g, v in groups.items():
        assert got[g]["n"] == len(v)
        assert max(rank_error(v, q, e) for q, e in zip(QS, got[g]["est"])) <= (0.0 if len(v) < 50 else 0.012)
    assert got["one"]["est"] == [7.0] * 5
    assert d.groupBy("g").count().agg(F.max("count")).first()[0] <= digests.DELTA // 2 + 2
    exact = digests.certify(df, est.withColumn("level", F.lit("g")), ["g"], {"g": ["g"]}, QS)
    for x in exact.collect():
        want = [rank_error(groups[x["g"]], q, e) for q, e in zip(QS, got[x["g"]]["est"])]
        assert np.allclose(x["errors"], want) and x["n_exact"] == len(groups[x["g"]])


def test_digests_of_days_merge(spark):
    r = np.random.default_rng(1)
    days = {f"d{i}": r.exponential(100 * (i + 1), 8000) for i in range(6)}
    _, d, _ = run(spark, days)
    whole = digests.estimates(digests.digest(d.select(F.lit("all").alias("g"), "mean", "weight"), ["g"]), ["g"], QS).first()
    every = np.concatenate(list(days.values()))
    assert whole["n"] == len(every)
    assert max(rank_error(every, q, e) for q, e in zip(QS, whole["est"])) <= 0.015


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", float("nan")), ("b", 2.0)], "g string, value double")
    est = digests.estimates(digests.digest(df, ["g"]), ["g"], QS)
    assert {x["g"]: x["n"] for x in est.collect()} == {None: 2, "b": 1}
    assert digests.estimates(digests.digest(df.where("false"), ["g"]), ["g"], QS).collect() == []


def batches(pa, groups, values, size=1000):
    schema = pa.schema({"g": pa.string(), "mean": pa.float64(), "weight": pa.int64()})
    return [pa.RecordBatch.from_pydict({"g": groups[i : i + size], "mean": values[i : i + size], "weight": np.ones(len(values[i : i + size]), np.int64)}, schema) for i in range(0, len(values), size)]


def test_buffer_limit(monkeypatch):
    """One group over many buffers: sorted rows give one digest, others several that merge."""
    import pyarrow as pa

    monkeypatch.setattr(digests, "BUFFER_ROWS", 500)
    r = np.random.default_rng(2)
    v = r.normal(size=20_000)
    for ordered in (True, False):
        out = list(digests._clustering(["g"], digests.DELTA, ordered)(iter(batches(pa, ["x"] * 20_000, v))))
        if not ordered:
            out = list(digests._clustering(["g"], digests.DELTA, True)(iter(out)))
        t = pa.Table.from_batches(out)
        weights, means = t.column("weight").to_numpy(), t.column("mean").to_numpy()
        assert weights.sum() == 20_000 and len(weights) <= digests.DELTA
        e = digests.quantiles(means, weights, np.zeros(len(means), int), means[:1], means[-1:], [0.5])[0, 0]
        assert rank_error(v, 0.5, e) < 0.02


def test_many_groups_pass_through(monkeypatch):
    """More groups than a buffer has rows, null among them: every group gives one digest with all its rows."""
    import pyarrow as pa

    monkeypatch.setattr(digests, "BUFFER_ROWS", 300)
    groups = sorted([f"g{i % 700:03d}" for i in range(5000)]) + [None] * 500
    out = pa.Table.from_batches(list(digests._clustering(["g"], digests.DELTA, True)(iter(batches(pa, groups, np.arange(5500.0), 170))))).to_pandas()
    sizes = out.fillna({"g": "none"}).groupby("g")["weight"].sum()
    assert sizes.to_dict() == pd.Series(groups, dtype=object).fillna("none").value_counts().to_dict()
    assert out["mean"].is_monotonic_increasing


def test_levels_are_certified_by_sums(spark, monkeypatch):
    monkeypatch.setattr(digests, "BUFFER_ROWS", 200)
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": r.choice(["x", "y", None], 3000), "b": r.choice(["1", "2", None], 3000), "value": r.lognormal(3, 1, 3000)})
    df = spark.createDataFrame(pdf)
    levels = {"a,b": ["a", "b"], "a": ["a"]}
    fine = digests.digest(df, ["a", "b"])
    wide = digests.digest(fine.select(F.lit("a").alias("level"), "a", F.lit(None).cast("string").alias("b"), "mean", "weight"), ["level", "a", "b"])
    est = digests.estimates(fine.select(F.lit("a,b").alias("level"), "a", "b", "mean", "weight").unionByName(wide), ["level", "a", "b"], QS)
    got = {(x["level"], x["a"], x["b"]): x for x in digests.certify(df, est, ["a", "b"], levels, QS).collect()}
    assert len(got) == 12
    for x in est.collect():
        rows = pdf[(pdf.a == x["a"]) if x["a"] else pdf.a.isna()]
        rows = rows if x["level"] == "a" else rows[(rows.b == x["b"]) if x["b"] else rows.b.isna()]
        y = got[x["level"], x["a"], x["b"]]
        assert y["n_exact"] == x["n"] == len(rows) and np.allclose(y["errors"], [rank_error(rows.value.to_numpy(), q, e) for q, e in zip(QS, x["est"])])
