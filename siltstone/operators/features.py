"""One wide row per entity with figures for each of many event types (problem 7).

Two-stage salted aggregation. Entity-type groups that hold more than 1/``HEAVY_SHARE`` of all rows (so at
most ``HEAVY_SHARE`` of them: a bounded list, the only thing besides the types that is broadcast) are spread over salts; the
partial statistics of all salts are merged per entity and type; then each entity's few statistics are laid
out over the complete list of types. The merge needs one shuffle, on the entity, of at most types x salts
small rows per entity; the raw events are never shuffled by entity. Laying out puts each statistic into its
type's position of an array, one step per statistic.

Defined results: events without entity are left out. Events whose type is null or not in the list count in
the entity's totals only. An event without time counts but gives no recency. A type that an entity never
had gives 0 events, totals 0 and null recency. Null amounts are 0. An empty list of types gives the totals
alone; an empty table gives no row. A type named twice is one type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1000
SALTS = 16
#: Names of heavy groups up to this length are compared as they are, longer ones by their SHA-256: this bounds the broadcast list in bytes.
MOST_CHARS = 64


def short(c: str) -> Column:
    """A key part in at most ``MOST_CHARS`` + 1 characters; equal for equal parts only."""
    text = F.col(c).cast("string")
    return F.when(F.length(text) <= MOST_CHARS, F.concat(F.lit("="), text)).otherwise(F.sha2(text, 256))


def statistics(events: DataFrame, entity: Column, kind: str, ts: str, amount: str, event_id: str) -> DataFrame:
    """entity, kind, salt, n, last, total: partial statistics; a heavy group has one row per salt."""
    e = events.select(entity.alias("entity"), F.col(kind).alias("kind"), F.col(ts).cast("long").alias("ts"), F.coalesce(F.col(amount).cast("long"), F.lit(0)).alias("amount"), F.col(event_id).alias("id"))
    e = e.where("entity is not null").withColumns({"e": short("entity"), "k": F.coalesce(short("kind"), F.lit("-"))})
    total = e.count()
    heavy = e.groupBy("e", "k").count().where(F.col("count") * HEAVY_SHARE > total).select(F.col("e").alias("h1"), F.col("k").alias("h2"), F.lit(True).alias("heavy"))
    salted = e.join(F.broadcast(heavy), (F.col("e") == F.col("h1")) & (F.col("k") == F.col("h2")), "left").select(
        "entity", "kind", "ts", "amount", F.when(F.col("heavy"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).alias("salt")
    )
    return salted.groupBy("entity", "kind", "salt").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.sum("amount").alias("total"))


def feature_cells(events: DataFrame, entity: Column, kind: str, ts: str, amount: str, event_id: str, as_of: int | None) -> DataFrame:
    """entity, kind, n, ago_ms, total of every type that an entity had: the long form, for any number of types."""
    partial = statistics(events, entity, kind, ts, amount, event_id)
    merged = partial.groupBy("entity", "kind").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("total").alias("total"))
    return merged.select("entity", "kind", "n", (F.lit(as_of).cast("long") - F.col("last")).alias("ago_ms"), "total")


def feature_table(events: DataFrame, entity: Column, kind: str, ts: str, amount: str, event_id: str, types: list[str], as_of: int | None) -> DataFrame:
    """entity, n_all, ago_ms_all, total_all and, per type T, n_T, ago_ms_T, total_T.

    ``ago_ms`` is ``as_of`` minus the time of the last event of the type. ``types`` is the complete list.
    """
    types = list(dict.fromkeys(types))
    listed = events.sparkSession.createDataFrame([(t, i) for i, t in enumerate(types)], "listed string, at int")
    partial = statistics(events, entity, kind, ts, amount, event_id).join(F.broadcast(listed), F.col("kind") == F.col("listed"), "left").select("entity", "at", "n", "last", "total")
    merged = partial.repartition("entity").groupBy("entity", "at").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("total").alias("total"))
    # One entity has at most one row per listed type, so its list is bounded; other types only add to totals.
    wide = merged.groupBy("entity").agg(
        F.sum("n").alias("n_all"), F.max("last").alias("last_all"), F.sum("total").alias("total_all"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n", "last", "total")))).alias("had"),
    )
    # Each figure behind as many nulls as types were skipped since the one before.
    none = lambda n: F.array_repeat(F.lit(None).cast("struct<at:int,n:bigint,last:bigint,total:bigint>"), n)
    since = lambda i: F.coalesce(F.get("had", i - 1)["at"], F.lit(-1))
    wide = wide.withColumn("cells", F.flatten(F.transform("had", lambda x, i: F.concat(none(x["at"] - since(i) - 1), F.array(x)))))
    ago = lambda last: f"{int(as_of)}L - {last}" if as_of is not None else "cast(null as bigint)"
    columns = ["entity", "n_all", f"{ago('last_all')} AS ago_ms_all", "total_all"]
    for i, t in enumerate(types):
        name, cell = t.replace("`", "``"), f"get(cells, {i})"  # null beyond the last type that was had
        columns += [f"coalesce({cell}.n, 0L) AS `n_{name}`", f"{ago(f'{cell}.last')} AS `ago_ms_{name}`", f"coalesce({cell}.total, 0L) AS `total_{name}`"]
    return wide.selectExpr(*columns)
