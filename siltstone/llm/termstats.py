"""Frequency of every distinct term (problem 3).

Heavy-light aggregation. Terms with more than 1/``HEAVY_SHARE`` of all rows and items are heavy; there are fewer than
``HEAVY_SHARE`` of them, and each is listed by at most 130 characters, which bounds the broadcast list whatever the
input. A heavy term is from then on a number:

* every item goes to its own task with a bit for each heavy term that has it, so bits of repeated items fall together
  before the exchange, and the task counts set bits in exact local counters, one per heavy term. The same pass counts
  the distinct items of the whole collection;
* the records of a heavy term are spread by record id and added up in a local counter, too.

What leaves a task is one row of counters per heavy term. Only the remaining terms are shuffled by term, once, and none
of them can fill more than a small share of a task. The two count tables are then united.

Defined results: null key parts form keys of their own. Rows of one record id are one record with the
largest weight; rows without record id are each a record; a null weight is 0. Null items are left out, null
and empty lists have none. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.features import short
from siltstone.storage import stage

HEAVY_SHARE = 512
RECORD, ITEM, LOOSE = 0, 1, 2


def _rows(items_too: bool) -> Column:
    """The record and the items of a row as structs (kind, item, w)."""
    rid = F.col("rid").cast("string")
    record = F.struct(F.when(rid.isNull(), F.lit(LOOSE)).otherwise(F.lit(RECORD)).alias("kind"), F.coalesce(rid, F.lit("")).alias("item"), F.col("w"))
    item = lambda x: F.struct(F.lit(ITEM).alias("kind"), x.alias("item"), F.lit(0).cast("long").alias("w"))
    return F.concat(F.array(record), F.transform("items", item)) if items_too else F.transform("items", item)


def _weight() -> Column:
    """What a distinct row of (kind, item) adds to the occurrences: records without id are all added."""
    return F.when(F.col("kind") == LOOSE, F.col("every")).otherwise(F.col("w"))


def term_frequencies(df: DataFrame, key: tuple[str, str], record_id: str, weight: str, items: str) -> tuple[DataFrame, int]:
    """k1, k2, occurrences (sum of ``weight`` over distinct records), records (distinct ``items``); and the number of
    distinct items of the whole collection."""
    spark = df.sparkSession
    base = df.select(
        F.col(key[0]).alias("k1"), F.col(key[1]).alias("k2"), F.col(record_id).alias("rid"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("w"),
        F.array_distinct(F.filter(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("items"),
    )
    load = F.size("items") + 1
    total = base.agg(F.sum(load)).first()[0] or 0
    name = lambda c: F.coalesce(short(c), F.lit("-")).alias(f"s_{c}")
    heavy = stage(base.groupBy("k1", "k2").agg(F.sum(load).alias("load")).where(F.col("load") * HEAVY_SHARE > total).select("k1", "k2", name("k1"), name("k2")), "heavy-terms")
    listed = sorted((r["s_k1"], r["s_k2"]) for r in heavy.select("s_k1", "s_k2").collect())  # fewer than HEAVY_SHARE rows
    numbers = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(listed)], "s_k1 string, s_k2 string, heavy int")
    marked = base.withColumns({"s_k1": name("k1"), "s_k2": name("k2")}).join(F.broadcast(numbers), ["s_k1", "s_k2"], "left")

    # Heavy terms, and the items of all.
    words = [f"b{j}" for j in range(-(-len(listed) // 64))]
    rows = marked.select("heavy", F.explode(F.when(F.col("heavy").isNotNull(), _rows(True)).otherwise(_rows(False))).alias("r")).select("heavy", "r.*")
    bits = {b: F.when((F.col("heavy") >= 64 * j) & (F.col("heavy") < 64 * j + 64) & (F.col("kind") == ITEM), F.expr("shiftleft(1L, heavy % 64)")).otherwise(F.lit(0).cast("long")) for j, b in enumerate(words)}
    rows = rows.select("kind", "item", "w", F.when(F.col("kind") != ITEM, F.col("heavy")).alias("of"), *[c.alias(b) for b, c in bits.items()])
    distinct = rows.groupBy("kind", "of", "item").agg(F.max("w").alias("w"), F.sum("w").alias("every"), *[F.bit_or(b).alias(b) for b in words])
    counters = distinct.groupBy("of").agg(
        F.sum(_weight()).alias("occurrences"), F.count_if(F.col("kind") == ITEM).alias("n"),
        *[F.count_if(F.expr(f"bit_get({words[i // 64]}, {i % 64}) = 1")).alias(f"n{i}") for i in range(len(listed))],
    )
    got = {r["of"]: r for r in counters.collect()}  # a row per heavy term and one for the items
    every = got.get(None)
    counts = [(a, b, got[i]["occurrences"], every[f"n{i}"] if every else 0) for i, (a, b) in enumerate(listed)]
    dense = spark.createDataFrame(counts, "s_k1 string, s_k2 string, occurrences long, records long").join(heavy, ["s_k1", "s_k2"])

    light = marked.where("heavy is null").select("k1", "k2", F.explode(_rows(True)).alias("r")).select("k1", "k2", "r.*").repartition("k1", "k2")
    light = light.groupBy("k1", "k2", "kind", "item").agg(F.max("w").alias("w"), F.sum("w").alias("every"))
    light = light.groupBy("k1", "k2").agg(F.sum(_weight()).alias("occurrences"), F.count_if(F.col("kind") == ITEM).alias("records"))
    return light.unionByName(dense.select("k1", "k2", "occurrences", "records")), every["n"] if every else 0


def mark_terms(terms: DataFrame, total: int, rare_at_most: int = 2, common_share: tuple[int, int] = (1, 20)) -> DataFrame:
    """Adds ``rare`` and ``common``: common terms occur in at least the share of all records, and in one at least."""
    share, of = common_share
    return terms.withColumns({"rare": F.col("occurrences") <= rare_at_most, "common": (F.col("records") > 0) & (F.col("records") * of >= F.lit(total) * share)})
