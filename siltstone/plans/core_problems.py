"""Queries of the general data-pipeline problems (1, 2, 6, 7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.changefeed import ChangeStore
from siltstone.operators.features import feature_cells, feature_table
from siltstone.operators.sessions import SessionStore, arrival_batches, clean_user
from siltstone.operators.skew import key_totals
from siltstone.sources.tables import table
from siltstone.storage import stage

SESSION_BATCHES = 3
CHANGE_BATCHES = 3


def _session_store(spark: SparkSession, sf: str) -> SessionStore:
    metrics = table(spark, sf, "query_metric").select("query_user", "create_date", "query_id", "received_at")
    store = SessionStore(spark)
    for batch in arrival_batches(metrics, "received_at", SESSION_BATCHES):
        store.apply(batch, "query_user", "create_date", "query_id")
    return store


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _session_store(spark, sf).sessions().select(F.col("user").alias("query_user"), "start_ms", "end_ms")


def p1_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _session_store(spark, sf).sessions().select(F.col("user").alias("query_user"), "start_ms", "end_ms", "duration_ms", F.col("n_events").alias("n_queries"))


def _change_store(spark: SparkSession, sf: str) -> ChangeStore:
    feed = table(spark, sf, "index_change").select("entry_id", "change_seq", "uid_list", "removeduid_list", "ignore_flag", "arrival_ts")
    store = ChangeStore(spark)
    for batch in arrival_batches(feed, "arrival_ts", CHANGE_BATCHES):
        store.apply(batch, "entry_id", "change_seq", "uid_list", "removeduid_list", "ignore_flag")
    store.close()
    return store


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _change_store(spark, sf).current().select(F.col("entry").alias("entry_id"), "uid")


def p2_entries(spark: SparkSession, sf: str) -> DataFrame:
    """How many UIDs each entry holds, or that it keeps a count only."""
    store = _change_store(spark, sf)
    held = store.current().groupBy("entry").agg(F.count("*").alias("n_uids"))
    return store.entries().join(held, "entry", "left").select(
        F.col("entry").alias("entry_id"), F.col("watermark").alias("last_seq"), F.col("flagged").alias("count_only"), F.coalesce("n_uids", F.lit(0)).alias("n_uids")
    )


def p6_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "term_index").where("norm_value is not null")
    out = key_totals(t, ("field_name", "norm_value"), "fragment_id", "uid_count", "uid_list")
    return out.select(
        F.col("k1").alias("field_name"), F.col("k2").alias("norm_value"), F.col("n_rows"), F.col("n_records").alias("n_fragments"), F.col("total").alias("uid_count"), F.col("n_items").alias("n_uids")
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms with more than 1 % of all rows as delivered."""
    total = table(spark, sf, "term_index").count()
    return p6_terms(spark, sf).where(F.col("n_rows") * 100 > total).select("field_name", "norm_value")


def current_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One row per query of query_metric: the version with the most updates."""
    m = table(spark, sf, "query_metric").select("query_id", "query_user", "query_type", "create_date", "setup_time", "num_pages", "num_results", "num_updates", "last_updated")
    rank = F.struct(F.col("num_updates"), F.col("last_updated"), F.col("num_results"), F.col("setup_time"))
    rows = F.struct("query_user", "query_type", "create_date", "setup_time", "num_results")
    named = m.where("query_id is not null").groupBy("query_id").agg(F.max_by(rows, rank).alias("r"))
    return named.select("query_id", "r.*").unionByName(m.where("query_id is null").select("query_id", "query_user", "query_type", "create_date", "setup_time", "num_results"))


MOST_TYPES = 5000


def _as_of(queries: DataFrame) -> int | None:
    return queries.agg(F.max("create_date")).first()[0]


def p7_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The features in long form: number of queries, time since the last and number of results per user and type."""
    queries = stage(current_queries(spark, sf), "current-queries")
    return feature_cells(queries, clean_user(F.col("query_user")), "query_type", "create_date", "num_results", "query_id", _as_of(queries)).withColumnsRenamed({"entity": "query_user", "kind": "query_type"})


def p7_features(spark: SparkSession, sf: str) -> DataFrame:
    queries = stage(current_queries(spark, sf), "current-queries")
    types = sorted(r[0] for r in table(spark, sf, "query_kind").select("query_type").where("query_type is not null").distinct().limit(MOST_TYPES + 1).collect())
    if len(types) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types of queries")
    return feature_table(queries, clean_user(F.col("query_user")), "query_type", "create_date", "num_results", "query_id", types, _as_of(queries)).withColumnRenamed("entity", "query_user")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_sessions": p1_sessions,
    "p2_found": p2_found,
    "p2_entries": p2_entries,
    "p6_found": p6_found,
    "p6_terms": p6_terms,
    "p7_cells": p7_cells,
    "p7_features": p7_features,
}

_CURRENT = """
WITH q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY num_updates DESC, last_updated DESC, num_results DESC) AS rn FROM query_metric) AS v WHERE rn = 1)
"""

# The types of query_kind are these pairs.
_TYPES = [a + b for a in "Event Edge Discovery Facet Count Content Term Lookup Index Hit Graph Shape".split() for b in "Query Scan Stream Batch Preview Export Sample Audit Probe Replay Digest Watch Trace Merge Page Window Rollup Match Range Summary".split()]
_WIDE = ", ".join(
    f"count(*) FILTER (k = '{t}') AS n_{t}, (SELECT as_of FROM m) - max(t) FILTER (k = '{t}') AS ago_ms_{t}, CAST(coalesce(sum(r) FILTER (k = '{t}'), 0) AS BIGINT) AS total_{t}" for t in _TYPES
)

ORACLES: dict[str, str] = {
    "p1_found": """
WITH q AS (
  SELECT query_id, min(lower(trim(query_user))) AS u, min(create_date) AS t FROM query_metric
  WHERE trim(query_user) <> '' AND create_date IS NOT NULL GROUP BY query_id),
o AS (SELECT u, t, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t) <= 1800000 THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT u, t FROM q) AS d),
s AS (SELECT u, t, sum(opens) OVER (PARTITION BY u ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT u AS query_user, min(t) AS start_ms, max(t) AS end_ms FROM s GROUP BY u, k""",
    "p1_sessions": """
WITH q AS (
  SELECT query_id, min(lower(trim(query_user))) AS u, min(create_date) AS t FROM query_metric
  WHERE trim(query_user) <> '' AND create_date IS NOT NULL GROUP BY query_id),
c AS (SELECT u, t, count(*) AS n FROM q GROUP BY u, t),
o AS (SELECT u, t, n, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t) <= 1800000 THEN 0 ELSE 1 END AS opens FROM c),
s AS (SELECT u, t, n, sum(opens) OVER (PARTITION BY u ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT u AS query_user, min(t) AS start_ms, max(t) AS end_ms, max(t) - min(t) AS duration_ms, CAST(sum(n) AS BIGINT) AS n_queries FROM s GROUP BY u, k""",
    "p2_found": """
WITH d AS (
  SELECT entry_id, change_seq, unnest(uid_list) AS uid, 0 AS removed FROM index_change
  UNION ALL SELECT entry_id, change_seq, unnest(removeduid_list) AS uid, 1 AS removed FROM index_change),
r AS (SELECT entry_id, uid, removed, row_number() OVER (PARTITION BY entry_id, uid ORDER BY change_seq DESC, removed DESC) AS rn FROM d WHERE uid IS NOT NULL)
SELECT entry_id, uid FROM r WHERE rn = 1 AND removed = 0 AND entry_id NOT IN (SELECT entry_id FROM index_change WHERE ignore_flag AND entry_id IS NOT NULL)""",
    "p2_entries": """
WITH d AS (
  SELECT entry_id, change_seq, unnest(uid_list) AS uid, 0 AS removed FROM index_change
  UNION ALL SELECT entry_id, change_seq, unnest(removeduid_list) AS uid, 1 AS removed FROM index_change),
r AS (SELECT entry_id, uid, removed, row_number() OVER (PARTITION BY entry_id, uid ORDER BY change_seq DESC, removed DESC) AS rn FROM d WHERE uid IS NOT NULL),
e AS (SELECT entry_id, max(change_seq) AS last_seq, bool_or(coalesce(ignore_flag, false)) AS count_only FROM index_change GROUP BY entry_id),
h AS (SELECT entry_id, count(*) AS n FROM r WHERE rn = 1 AND removed = 0 GROUP BY entry_id)
SELECT e.entry_id, last_seq, count_only, CASE WHEN count_only THEN CAST(0 AS BIGINT) ELSE coalesce(n, 0) END AS n_uids FROM e LEFT JOIN h ON e.entry_id = h.entry_id""",
    "p6_found": """
SELECT field_name, norm_value FROM term_index WHERE norm_value IS NOT NULL
GROUP BY field_name, norm_value HAVING count(*) * 100 > (SELECT count(*) FROM term_index)""",
    "p6_terms": """
WITH f AS (SELECT fragment_id, min(field_name) AS field_name, min(norm_value) AS norm_value, max(uid_count) AS uid_count, count(*) AS n_rows FROM term_index WHERE norm_value IS NOT NULL GROUP BY fragment_id),
u AS (SELECT field_name, norm_value, count(DISTINCT uid) AS n_uids FROM (SELECT field_name, norm_value, unnest(uid_list) AS uid FROM term_index) AS x GROUP BY field_name, norm_value)
SELECT f.field_name, f.norm_value, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_fragments, CAST(sum(uid_count) AS BIGINT) AS uid_count, coalesce(max(u.n_uids), 0) AS n_uids
FROM f LEFT JOIN u ON f.field_name = u.field_name AND f.norm_value = u.norm_value GROUP BY f.field_name, f.norm_value""",
    "p7_cells": _CURRENT + """,
g AS (SELECT lower(trim(query_user)) AS query_user, query_type, count(*) AS n, max(create_date) AS last, sum(coalesce(num_results, 0)) AS total FROM q WHERE trim(query_user) <> '' GROUP BY 1, 2)
SELECT query_user, query_type, n, (SELECT max(create_date) FROM q) - last AS ago_ms, CAST(total AS BIGINT) AS total FROM g""",
    "p7_features": _CURRENT + f""",
m AS (SELECT max(create_date) AS as_of FROM q),
u AS (SELECT lower(trim(query_user)) AS query_user, query_type AS k, create_date AS t, coalesce(num_results, 0) AS r FROM q WHERE trim(query_user) <> '')
SELECT query_user, count(*) AS n_all, (SELECT as_of FROM m) - max(t) AS ago_ms_all, CAST(sum(r) AS BIGINT) AS total_all,
{_WIDE} FROM u GROUP BY query_user""",
}
