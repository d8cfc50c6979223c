"""Per-key results when a few keys hold most records (problem 6).

Rows are range-partitioned on the composite key followed by a secondary order, with bounds from sampled
quantiles. A heavy key therefore spans as many partitions as its rows need, and no task gets more than its
share. Inside a sorted partition all figures are run lengths, taken in one pass over Arrow batches. A key
that lies wholly inside a partition is finished there; only the first and the last key of a partition may
go on next door, and just these partial states, two per partition, are shuffled and stitched.

The secondary order makes the figures additive across partitions: equal (key, item) rows have equal sort
keys, so they never lie in different partitions and each distinct item is counted in exactly one. Rows without
record id need no such order: their number and weights are added up per key beforehand, which leaves
a few rows of them per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stage
from siltstone.workers import with_code

RECORD, ITEM, LOOSE = 0, 1, 2  # kinds of rows: a record with id, an item of a list, some records without id
PARTIAL = "k1 string, k2 string, n_rows long, n_records long, total long, n_items long, edge boolean"


def _changes(batch: pa.RecordBatch, names: list[str], last: dict) -> np.ndarray:
    out = np.zeros(batch.num_rows, bool)
    for name in names:
        col = batch.column(name)
        out[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        out[0] |= name not in last or last[name] != col[0].as_py()
    return out


def run_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each run of equal keys in a sorted partition; the partition's first and last are edges."""
    last: dict = {}
    carry: list | None = None  # key and sums of the run that is still open
    first = True
    fields = ["k1", "k2", "n_rows", "n_records", "total", "n_items", "edge"]

    def emit(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=fields)

    for batch in batches:
        if not batch.num_rows:
            continue
        new_key = _changes(batch, ["k1", "k2"], last)
        kind, weight, n = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("kind", "weight", "n"))
        new_item = new_key | (kind == LOOSE) | _changes(batch, ["kind", "item"], last)
        last = {n: batch.column(n)[batch.num_rows - 1].as_py() for n in ("k1", "k2", "kind", "item")}
        starts = np.flatnonzero(new_key)
        if not len(starts) or starts[0]:
            starts = np.concatenate([[0], starts])
        record = (kind != ITEM) & new_item
        sums = np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (np.where(kind != ITEM, n, 0), np.where(record, np.where(kind == LOOSE, n, 1), 0), np.where(record, weight, 0), (kind == ITEM) & new_item)], 1)
        keys = list(zip(batch.column("k1").take(pa.array(starts)).to_pylist(), batch.column("k2").take(pa.array(starts)).to_pylist()))
        runs = [[*k, *map(int, s)] for k, s in zip(keys, sums)]
        if carry is not None and not new_key[0]:
            runs[0] = [*carry[:2], *(a + b for a, b in zip(carry[2:], runs[0][2:]))]
        elif carry is not None:
            runs.insert(0, carry)
        carry = runs.pop()
        if runs:
            yield emit([[*r, first and i == 0] for i, r in enumerate(runs)])
            first = False
    if carry is not None:
        yield emit([[*carry, True]])


def key_totals(df: DataFrame, key: tuple[str, str], record_id: str, weight: str, items: str) -> DataFrame:
    """k1, k2, n_rows, n_records, total, n_items of every key.

    n_rows counts all rows; n_records and total count and sum ``weight`` over distinct ``record_id``;
    n_items counts the distinct values in the lists ``items``.

    Defined results: null key parts form keys of their own. Rows without record id are each a record. Rows
    of one record id are one record of their key with the largest weight; a null weight is 0. Null and empty
    lists have no items, null items are left out. An empty table gives no row.
    """
    # Key parts are kept apart from null by a leading sign, which keeps comparing them simple.
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    none, one = F.array().cast("array<string>"), F.lit(1).cast("long")
    row = lambda kind, item, w: F.struct(F.lit(kind).alias("kind"), item.alias("item"), w.alias("weight"), one.alias("n"))
    base = df.select(
        part(key[0]).alias("k1"),
        part(key[1]).alias("k2"),
        F.col(record_id).cast("string").alias("rid"),
        F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("w"),
        F.array_distinct(F.filter(F.coalesce(F.col(items), none), lambda x: x.isNotNull())).alias("items"),
    )
    record = F.when(F.col("rid").isNotNull(), F.array(row(RECORD, F.col("rid"), F.col("w")))).otherwise(F.array().cast("array<struct<kind:int,item:string,weight:bigint,n:bigint>>"))
    rows = base.select("k1", "k2", F.explode(F.concat(record, F.transform("items", lambda x: row(ITEM, x, F.lit(0).cast("long"))))).alias("r")).select("k1", "k2", "r.*")
    # An aggregation that combines map-side; the part that the row's hash gives keeps its result spread, too.
    loose = base.where("rid is null").groupBy("k1", "k2", F.pmod(F.xxhash64("w", "items"), F.lit(64)).cast("string").alias("item")).agg(F.sum("w").alias("weight"), F.count("*").alias("n"))
    rows = rows.unionByName(loose.select("k1", "k2", F.lit(LOOSE).alias("kind"), "item", "weight", "n"))
    order = ["k1", "k2", "kind", "item", F.desc("weight")]
    runs = with_code(rows).repartitionByRange(*order[:4]).sortWithinPartitions(*order).mapInArrow(run_totals, PARTIAL)
    runs = stage(runs, "key-runs")
    sums = ["n_rows", "n_records", "total", "n_items"]
    stitched = runs.where("edge").groupBy("k1", "k2").agg(*[F.sum(c).alias(c) for c in sums])
    whole = runs.where("not edge").select("k1", "k2", *sums).unionByName(stitched)
    value = lambda c: F.when(F.col(c) != "-", F.substring(c, 2, 2**31 - 1)).alias(c)
    return whole.select(value("k1"), value("k2"), *sums)
