"""Retention and changes of stored values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def ttl_ms(ttl: int, unit: str = "d") -> int:
    return ttl * UNITS[unit]


def age_off(df: DataFrame, ts_ms: Column, anchor_ms: int, default_ms: int | None = None, by: str | None = None, rules: dict[str, int] | None = None) -> DataFrame:
    """Rows younger than their time to live: kept only if ts > anchor - ttl. A rule of ``by`` beats the default; no ttl keeps all."""
    ttl: Column = F.lit(default_ms).cast("bigint")
    if by and rules:
        table = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
        ttl = F.coalesce(F.try_element_at(table, F.col(by)), ttl)
    return df.where(ttl.isNull() | (ts_ms > F.lit(anchor_ms) - ttl))


def age_off_pattern(df: DataFrame, value: str, ts_ms: Column, anchor_ms: int, rules: list[tuple[str, int]]) -> DataFrame:
    """The first rule whose pattern occurs in the value gives the time to live."""
    ttl = F.coalesce(*[F.when(F.col(value).rlike(p), F.lit(ms).cast("bigint")) for p, ms in rules], F.lit(None).cast("bigint"))
    return df.where(ttl.isNull() | (ts_ms > F.lit(anchor_ms) - ttl))


def modify(df: DataFrame, key: str, changes: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Field values after changes (key, action, old, new), applied by copying: INSERT, UPDATE, DELETE, REPLACE.

    ``df`` has key and an array of values. UPDATE and DELETE touch the value ``old`` only, REPLACE puts new in
    place of all values. Several changes of one key are made one after the other, by the column ``order`` of the
    changes if there is one; those that tie, by action, old and new value. Documents without changes stay as they are.
    """
    given = F.struct(*([F.col(order).alias("at")] if order else []), "action", "old", "new")
    todo = changes.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(given)).alias("_todo"))

    def step(v: Column, c: Column) -> Column:
        return (
            F.when(c["action"] == "INSERT", F.array_union(v, F.array(c["new"])))
            .when(c["action"] == "UPDATE", F.transform(v, lambda x: F.when(x == c["old"], c["new"]).otherwise(x)))
            .when(c["action"] == "DELETE", F.filter(v, lambda x: ~x.eqNullSafe(c["old"])))
            .when(c["action"] == "REPLACE", F.array(c["new"]))
            .otherwise(v)
        )

    j = df.join(todo, F.col(key) == F.col("_key"), "left")
    start = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return j.withColumn(column, F.when(F.col("_todo").isNull(), F.col(column)).otherwise(F.aggregate("_todo", start, step))).drop("_key", "_todo")


def age_off_visibility(df: DataFrame, visibility: str, ts_ms: Column, anchor_ms: int, rules: list[tuple[list[str], bool, int]]) -> DataFrame:
    """Rules (labels, all of them or any, time to live) on the labels that a visibility names; the first that holds counts."""
    labels = F.transform(F.split(F.regexp_replace(F.coalesce(visibility, F.lit("")), r"[&|()\"\s]+", " "), " "), F.trim)
    holds = lambda names, every: _joined([F.array_contains(labels, n) for n in names], every)
    ttl = F.coalesce(*[F.when(holds(names, every), F.lit(ms).cast("bigint")) for names, every, ms in rules], F.lit(None).cast("bigint"))
    return df.where(ttl.isNull() | (ts_ms > F.lit(anchor_ms) - ttl))


def age_off_token(df: DataFrame, value: str, ts_ms: Column, anchor_ms: int, rules: dict[str, int], delimiters: str = ";,:/ ") -> DataFrame:
    """The first token of the value that a rule names gives the time to live; tokens lie between delimiters."""
    ttl_of = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    tokens = F.split(F.col(value), "[" + "".join(f"\\{d}" if not d.isspace() else d for d in delimiters) + "]")
    ttl = F.get(F.filter(F.transform(tokens, lambda t: F.try_element_at(ttl_of, t)), lambda x: x.isNotNull()), F.lit(0))
    return df.where(ttl.isNull() | (ts_ms > F.lit(anchor_ms) - ttl))


def _joined(parts: list[Column], every: bool) -> Column:
    return reduce(lambda a, b: a & b if every else a | b, parts)


def history(before: DataFrame, after: DataFrame, key: str, column: str, at: str) -> DataFrame:
    """key, removed, added, at of every key whose values a modification changed."""
    b = before.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias("_old"))
    a = after.groupBy(F.col(key)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias("_new"))
    both = a.join(b, F.col(key) == F.col("_key"))
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, F.array_except("_old", "_new").alias("removed"), F.array_except("_new", "_old").alias("added"), F.lit(at).alias("at"))
