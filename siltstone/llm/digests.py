"""Mergeable percentiles with certified rank error (problem 4).

Merging centroid digests. Sorted values are clustered under the size function
k(q) = delta / (2 pi) * asin(2 q - 1): values whose mid-quantiles fall into one unit of k form a cluster, so
clusters are wide at the median and single values at the tails, and a digest has at most delta / 2 + 1 of
them. A digest of a union is the clustering of all clusters, so partitions, days and types merge in any
order. Each task clusters its own rows first; what is shuffled per group and task is one small digest,
which keeps a group with most of the rows harmless.

The error of a digest can't be bounded in advance for all inputs, so it is certified: a second pass counts,
for each reported percentile, the values below and up to it, which gives its exact rank. Each value meets the
estimates of its finest group, which carry those of the wider groups along, by a join on the group; groups with more
than 1 / ``HEAVY_SHARE`` of all values, so fewer than that many, are spread over salts, so no task gets most of the
values whichever join Spark takes by size; the counts of wider groups are sums of those.

Memory is bounded whatever the number of groups: a task clusters ``BUFFER_ROWS`` rows at a time and passes them on, and
where digests are finished the rows come sorted by group, so that only the last group stays open.

Defined results: null values don't count. Null group columns form groups. A group of one value gives that
value for every percentile. Ties are exact ranks: an estimate within a run of ties has error 0. NaN is left
out. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stage
from siltstone.workers import with_code

DELTA = 400
BUFFER_ROWS = 400_000
HEAVY_SHARE = 1000
SALTS = 16


def _codes(keys: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row, and for each group the position of one of its rows."""
    code = np.zeros(len(keys), np.int64)
    for c in keys:
        part, names = pd.factorize(keys[c])
        code = code * (len(names) + 1) + part + 1
        code = np.unique(code, return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def cluster(keys: pd.DataFrame, mean: np.ndarray, weight: np.ndarray, delta: int = DELTA) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Digest of every group at once: keys, means, weights of its clusters in order, and the group numbers."""
    code, _ = _codes(keys)
    order = np.lexsort((mean, code))
    code, mean, weight = code[order], mean[order], weight[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    sizes = np.diff(np.append(starts, len(code)))
    upto = np.cumsum(weight)
    total = np.repeat(np.add.reduceat(weight, starts), sizes)
    before = upto - weight - np.repeat(upto[starts] - weight[starts], sizes)
    q = (before + weight / 2) / total
    unit = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1))).astype(np.int64)
    cut = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(unit, prepend=unit[0] - 1) != 0))
    weights = np.add.reduceat(weight, cut)
    # The weighted mean, kept within the cluster's own bounds against rounding.
    means = np.add.reduceat(mean * (weight / np.repeat(weights, np.diff(np.append(cut, len(code))))), cut)
    last = np.append(cut[1:], len(code)) - 1
    means = np.clip(means, mean[cut], mean[last])
    return keys.iloc[order[cut]].reset_index(drop=True), means, weights, code[cut]


def quantiles(means: np.ndarray, weights: np.ndarray, code: np.ndarray, low: np.ndarray, high: np.ndarray, qs: list[float]) -> np.ndarray:
    """Estimates, one row per group: exact where a cluster is one value, else interpolated between clusters."""
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    sizes = np.diff(np.append(starts, len(code)))
    totals = np.add.reduceat(weights, starts)
    group = np.repeat(np.arange(len(starts)), sizes)
    upto = np.cumsum(weights)
    before = upto - weights - np.repeat(upto[starts] - weights[starts], sizes)
    middle = (before + weights / 2) / totals[group]
    out = np.empty((len(starts), len(qs)))
    for j, q in enumerate(qs):
        at = np.searchsorted(group + middle, np.arange(len(starts)) + q)
        left, right = at - 1, at
        no_left, no_right = left < starts, right >= starts + sizes
        left, right = np.where(no_left, starts, left), np.where(no_right, starts + sizes - 1, right)
        x0, y0 = np.where(no_left, 0.0, middle[left]), np.where(no_left, low, means[left])
        x1, y1 = np.where(no_right, 1.0, middle[right]), np.where(no_right, high, means[right])
        share = np.divide(q - x0, x1 - x0, out=np.zeros(len(starts)), where=x1 > x0)
        between = y0 + np.clip(share, 0, 1) * (y1 - y0)
        # The cluster that holds rank ceil(q n): a single value is the exact percentile.
        rank = np.clip(np.ceil(q * totals), 1, totals)
        holder = np.searchsorted(upto, rank + (upto[starts] - weights[starts]))
        out[:, j] = np.where(weights[holder] == 1, means[holder], between)
    return out


def _batch(keys: pd.DataFrame, columns: dict[str, pa.Array], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([*(pa.array(keys[n], type=schema.field(n).type, from_pandas=True) for n in keys), *columns.values()], names=[*keys, *columns])
    for at in range(0, whole.num_rows, 50_000):
        yield whole.slice(at, 50_000)


def _clustering(names: list[str], delta: int, ordered: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: rows (names..., mean, weight) to clusters.

    Rows that are ``ordered`` by group give one digest per group; others give one per group and ``BUFFER_ROWS`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, schema = 0, None

        def done(keep_last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            keys = pd.concat([h[0] for h in held], ignore_index=True)
            given, _ = _codes(keys)
            keys, means, weights, code = cluster(keys, *(np.concatenate([h[i] for h in held]) for i in (1, 2)), delta)
            out = code != given[-1] if keep_last else np.ones(len(code), bool)
            held = [] if out.all() else [(keys[~out], means[~out], weights[~out])]
            rows = 0
            if out.any():
                yield from _batch(keys[out], {"mean": pa.array(means[out]), "weight": pa.array(weights[out])}, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            held.append((batch.select(names).to_pandas(), batch.column("mean").to_numpy(), batch.column("weight").to_numpy()))
            rows += batch.num_rows
            if rows > BUFFER_ROWS:
                yield from done(ordered)
        if held:
            yield from done(False)

    return run


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def digest(df: DataFrame, by: list[str], delta: int = DELTA) -> DataFrame:
    """The digest of every group, one row (by..., mean, weight) per cluster.

    ``df`` has the columns ``by`` with either ``value`` (raw numbers) or ``mean`` and ``weight`` (digests,
    which are merged).
    """
    if "value" in df.columns:
        df = df.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select(*by, F.col("value").cast("double").alias("mean"), F.lit(1).cast("long").alias("weight"))
    else:
        df = df.select(*by, "mean", "weight")
    schema = f"{_schema(df, by)}, mean double, weight long"
    local = with_code(df).mapInArrow(_clustering(by, delta), schema)
    return local.repartition(*by).sortWithinPartitions(*by).mapInArrow(_clustering(by, delta, True), schema)


def estimates(clusters: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """by..., n, est (array): percentiles of every digest. The outermost clusters stand for the extremes."""
    schema = f"{_schema(clusters, by)}, n long, est array<double>"

    def figures(t: pa.Table, keep_last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
        keys = t.select(by).to_pandas()
        mean, weight = t.column("mean").to_numpy(), t.column("weight").to_numpy()
        code, _ = _codes(keys)
        left = None
        if keep_last:
            open_ = code == code[-1]
            left, shut = t.filter(pa.array(open_)), ~open_
            if not shut.any():
                return [], left
            keys, mean, weight, code = keys[shut], mean[shut], weight[shut], np.unique(code[shut], return_inverse=True)[1]
        order = np.lexsort((mean, code))
        code, mean, weight = code[order], mean[order], weight[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        ends = np.append(starts[1:], len(code)) - 1
        est = quantiles(mean, weight, code, mean[starts], mean[ends], qs)
        lists = pa.ListArray.from_arrays(np.arange(0, est.size + 1, len(qs), dtype=np.int32), pa.array(est.ravel()))
        return list(_batch(keys.iloc[order[starts]], {"n": pa.array(np.add.reduceat(weight, starts)), "est": lists}, t.schema)), left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > BUFFER_ROWS:
                out, left = figures(pa.Table.from_batches(held), True)
                yield from out
                held, rows = left.to_batches(), 0
        if held:
            yield from figures(pa.Table.from_batches(held), False)[0]

    return with_code(clusters).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def certify(values: DataFrame, est: DataFrame, fine: list[str], levels: dict[str, list[str]], qs: list[float]) -> DataFrame:
    """level, fine..., n_exact, errors: for each percentile how far its exact rank, as a share of n, lies from the wanted one.

    ``values`` has ``fine`` and ``value``. ``levels`` names the columns of ``fine`` that each level keeps, the finest
    first; ``est`` has ``level``, ``fine``, with nulls for what a level doesn't keep, and ``est``.
    """
    same = lambda a, b, cs: [a[c].eqNullSafe(b[f"_{c}"]) for c in cs]
    finest = est.where(F.col("level") == next(iter(levels)))
    total = finest.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") * HEAVY_SHARE > total
    wide: DataFrame | None = None
    for i, (level, keep) in enumerate(levels.items()):
        e = est.where(F.col("level") == level).select(*[F.col(c).alias(f"_{c}" if i else c) for c in keep], *(["n"] if i == 0 else []), F.col("est").alias(f"est_{i}"))
        wide = e if wide is None else wide.join(e, same(wide, e, keep) if keep else F.lit(True), "left").drop(*[f"_{c}" for c in keep])
    salts = F.sequence(F.lit(0), F.when(is_heavy, F.lit(SALTS - 1)).otherwise(F.lit(0)))
    groups = wide.select(*[F.col(c).alias(f"_{c}") for c in fine], *[f"est_{i}" for i in range(len(levels))], F.explode(salts).alias("_salt"))
    heavy = finest.where(is_heavy).select(*[F.col(c).alias(f"_{c}") for c in fine], F.lit(True).alias("heavy"))
    rows = values.select(*fine, F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value)")
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    rows = rows.join(F.broadcast(heavy), same(rows, heavy, fine), "left").select(*fine, "value", salt.alias("salt"))
    joined = rows.join(groups, [*same(rows, groups, fine), F.col("salt") == F.col("_salt")])
    name = lambda kind, i, j: f"{kind}_{i}_{j}"
    test = {"lt": lambda e: F.col("value") < e, "le": lambda e: F.col("value") <= e}
    counts = [F.count_if(t(F.col(f"est_{i}")[j])).alias(name(k, i, j)) for k, t in test.items() for i in range(len(levels)) for j in range(len(qs))]
    counted = stage(joined.groupBy(*fine).agg(F.count("*").alias("n"), *counts), "rank-counts")
    out: DataFrame | None = None
    n = F.col("n_exact")
    for i, (level, keep) in enumerate(levels.items()):
        sums = counted.groupBy(*keep).agg(F.sum("n").alias("n_exact"), *[F.sum(name(k, i, j)).alias(f"{k}_{j}") for k in test for j in range(len(qs))])
        error = lambda j, q: F.greatest(F.lit(0.0), F.col(f"lt_{j}") / n - q, F.lit(q) - F.col(f"le_{j}") / n)
        columns = [F.col(c) if c in keep else F.lit(None).cast(counted.schema[c].dataType).alias(c) for c in fine]
        part = sums.where("n_exact > 0").select(F.lit(level).alias("level"), *columns, "n_exact", F.array(*[error(j, q) for j, q in enumerate(qs)]).alias("errors"))
        out = part if out is None else out.unionByName(part)
    return out
