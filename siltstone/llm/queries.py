"""Queries of problems 3, 4 and 5 and their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bitmaps, digests, termstats
from siltstone.operators.sessions import clean_user
from siltstone.plans.core_problems import current_queries
from siltstone.sources.tables import table
from siltstone.storage import stage

PERCENTILES = [0.5, 0.75, 0.9, 0.95, 0.99]


def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and records of every term, and whether it is too rare or too common to be useful."""
    t = table(spark, sf, "term_index")
    terms, total = termstats.term_frequencies(t, ("field_name", "norm_value"), "fragment_id", "uid_count", "uid_list")
    marked = termstats.mark_terms(terms.where("k2 is not null"), total)
    return marked.select(F.col("k1").alias("field_name"), F.col("k2").alias("norm_value"), "occurrences", "records", "rare", "common")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.filter(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))), lambda x: x.isNotNull())
    return p3_terms(spark, sf).select("field_name", "norm_value", F.explode(marks).alias("mark"))


def _day(ms: str) -> F.Column:
    return F.expr(f"date_from_unix_date(cast(`{ms}` div 86400000 - CASE WHEN `{ms}` % 86400000 < 0 THEN 1 ELSE 0 END AS int))")


def timed_values(spark: SparkSession, sf: str) -> DataFrame:
    """metric, query_type, day, value: measured setup times of queries and return times of their pages.

    A query counts once, in its current version; a page (query, number) once, in its latest request. Pages
    whose query isn't known keep null type and day; of those without a query every distinct row counts.
    """
    queries = current_queries(spark, sf).select("query_id", "query_type", _day("create_date").alias("day"), "setup_time")
    setup = queries.where("setup_time >= 0").select(F.lit("setup_time").alias("metric"), "query_type", "day", F.col("setup_time").alias("value"))
    rows = table(spark, sf, "page_metric")
    pages = rows.where("query_id is not null").groupBy("query_id", "page_number").agg(F.max(F.struct("page_requested", "return_time")).alias("p")).select("query_id", F.col("p.return_time").alias("value")).where("value >= 0")
    page = lambda df: df.select(F.lit("return_time").alias("metric"), "query_type", "day", "value")
    known = pages.join(queries.where("query_id is not null").select("query_id", "query_type", "day"), "query_id", "left")
    orphans = rows.where("query_id is null").distinct().where("return_time >= 0").select(F.col("return_time").alias("value"), F.lit(None).cast("string").alias("query_type"), F.lit(None).cast("date").alias("day"))
    return setup.unionByName(page(known)).unionByName(page(orphans))


FINE = ["metric", "query_type", "day"]
LEVEL = ["metric", "level", "query_type", "day"]
LEVELS = {"type,day": FINE, "type": ["metric", "query_type"], "day": ["metric", "day"], "all": ["metric"]}
#: The stated bound on the error of a rank, as a share of n.
MOST_RANK_ERROR = 0.015


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per type and day, per type, per day and overall, with the certified error of their ranks.

    The digests per type and day are the stored form; the other levels are merged from them.
    """
    values = stage(timed_values(spark, sf), "timed-values")
    daily = stage(digests.digest(values, FINE), "daily-digests")
    null = {"query_type": "cast(null as string)", "day": "cast(null as date)"}
    wider = F.array(*[F.struct("metric", F.lit(level).alias("level"), *[F.col(c) if c in keep else F.expr(null[c]).alias(c) for c in FINE[1:]]) for level, keep in list(LEVELS.items())[1:]])
    rolled = digests.digest(daily.select(F.inline(wider), "mean", "weight"), LEVEL)
    every = daily.select("metric", F.lit("type,day").alias("level"), "query_type", "day", "mean", "weight").unionByName(rolled)
    est = stage(digests.estimates(every, LEVEL, PERCENTILES), "percentiles")
    exact = digests.certify(values, est, FINE, LEVELS, PERCENTILES)
    e = est.select(*[F.col(c).alias(f"e_{c}") for c in LEVEL], "n", "est")
    joined = exact.join(e, [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in LEVEL])
    names = [f"p{round(100 * q)}" for q in PERCENTILES]
    return joined.select(*LEVEL, "n", *[F.col("est")[j].alias(p) for j, p in enumerate(names)], F.array_max("errors").alias("max_rank_error"))


def p4_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Per metric and level: groups, values, and how many groups have a percentile whose exact rank is off by more than the stated bound."""
    return p4_percentiles(spark, sf).groupBy("metric", "level").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_values"), F.count_if(F.col("max_rank_error") > MOST_RANK_ERROR).alias("beyond"))


def _uids(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    t = table(spark, sf, "term_index")
    return t.select(F.substring("shard_id", 1, 8).alias("day"), "datatype", "field_name", F.explode("uid_list").alias("id")), ["day", "datatype", "field_name"]


def _users(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    m = table(spark, sf, "query_metric")
    return m.select(_day("create_date").alias("day"), "query_type", clean_user(F.col("query_user")).alias("id")), ["day", "query_type"]


def _counted(ids: DataFrame, dims: list[str]) -> DataFrame:
    bits = bitmaps.size_bits(ids.where("id is not null").count())
    return bitmaps.estimate(bitmaps.cube(bitmaps.build(ids, dims, bits), dims), ["level", *dims])


def p5_uid_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct UIDs per shard day, datatype, field and all their combinations."""
    return _counted(*_uids(spark, sf))


def p5_user_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users (trimmed, lower-cased) per day of create_date, query type and their combinations."""
    return _counted(*_users(spark, sf))


def _bounds(ids: DataFrame, dims: list[str]) -> DataFrame:
    """Per level the estimates against exact counts: groups, exact counts added up, estimates six standard errors off or more."""
    est = _counted(ids, dims)
    cube = ids.where("id is not null").cube(*dims).agg(F.grouping_id().alias("gid"), F.count_distinct("id").alias("exact"))
    name = F.coalesce(F.concat_ws(",", *[F.when(F.col("gid").bitwiseAND(F.lit(1 << (len(dims) - 1 - i))) == 0, F.lit(d)) for i, d in enumerate(dims)]), F.lit(""))
    exact = cube.select(F.when(name == "", F.lit("all")).otherwise(name).alias("l"), *[F.col(d).alias(f"_{d}") for d in dims], "exact")
    both = est.join(exact, [F.col("level") == F.col("l"), *[F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims]], "full")
    off = F.coalesce(F.abs(F.col("estimate") - F.col("exact")) > 6 * F.col("std_error") * F.col("estimate") + 1, F.lit(True))
    return both.groupBy(F.coalesce("level", "l").alias("level")).agg(F.count("*").alias("n_groups"), F.sum("exact").alias("n_exact"), F.count_if(off).alias("beyond"))


def p5_uid_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _bounds(*_uids(spark, sf))


def p5_user_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _bounds(*_users(spark, sf))


QUERIES = {
    "p3_found": p3_found, "p3_terms": p3_terms, "p4_percentiles": p4_percentiles, "p4_bounds": p4_bounds,
    "p5_uid_counts": p5_uid_counts, "p5_uid_bounds": p5_uid_bounds, "p5_user_counts": p5_user_counts, "p5_user_bounds": p5_user_bounds,
}

_TERMS = """
WITH f AS (SELECT fragment_id, min(field_name) AS field_name, min(norm_value) AS norm_value, max(uid_count) AS uid_count FROM term_index WHERE norm_value IS NOT NULL GROUP BY fragment_id),
x AS (SELECT field_name, norm_value, unnest(uid_list) AS uid FROM term_index),
u AS (SELECT field_name, norm_value, count(DISTINCT uid) AS records FROM x GROUP BY field_name, norm_value),
t AS (SELECT count(DISTINCT uid) AS n FROM x),
c AS (SELECT f.field_name, f.norm_value, CAST(sum(uid_count) AS BIGINT) AS occurrences, coalesce(max(u.records), 0) AS records
  FROM f LEFT JOIN u ON f.field_name = u.field_name AND f.norm_value = u.norm_value GROUP BY f.field_name, f.norm_value),
m AS (SELECT c.*, occurrences <= 2 AS rare, records > 0 AND records * 20 >= (SELECT n FROM t) AS common FROM c)
"""


def _cubed(ids: str, dims: list[str]) -> str:
    parts = []
    for n in range(len(dims) + 1):
        for keep in combinations(dims, n):
            by = f"SELECT count(DISTINCT id) AS n FROM {ids} AS i WHERE id IS NOT NULL GROUP BY {', '.join(keep) or 'true'}"
            parts.append(f"SELECT '{','.join(keep) or 'all'}' AS level, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_exact, CAST(0 AS BIGINT) AS beyond FROM ({by}) AS x")
    return " UNION ALL ".join(parts)


ORACLES = {
    "p3_found": _TERMS + "SELECT field_name, norm_value, 'rare' AS mark FROM m WHERE rare UNION ALL SELECT field_name, norm_value, 'common' FROM m WHERE common",
    "p3_terms": _TERMS + "SELECT * FROM m",
    "p4_bounds": f"""
WITH q AS (SELECT query_id, query_type, setup_time, floor(create_date / 86400000.0) AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY num_updates DESC, last_updated DESC, num_results DESC) AS rn FROM query_metric) AS x WHERE rn = 1),
p AS (SELECT query_id, return_time FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, page_number ORDER BY page_requested DESC, return_time DESC) AS rn FROM page_metric) AS x WHERE rn = 1 AND return_time >= 0),
v AS (SELECT 'setup_time' AS metric, query_type, day FROM q WHERE setup_time >= 0
  UNION ALL SELECT 'return_time', query_type, day FROM p LEFT JOIN q ON p.query_id = q.query_id),
g AS (SELECT metric, query_type, day, count(*) AS n FROM v GROUP BY metric, query_type, day)
{' UNION ALL '.join(f"SELECT metric, '{level}' AS level, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_values, CAST(0 AS BIGINT) AS beyond FROM (SELECT sum(n) AS n, {', '.join(keep)} FROM g GROUP BY {', '.join(keep)}) AS x GROUP BY metric" for level, keep in LEVELS.items())}""",
    "p5_uid_bounds": _cubed("(SELECT substr(shard_id, 1, 8) AS day, datatype, field_name, unnest(uid_list) AS id FROM term_index)", ["day", "datatype", "field_name"]),
    "p5_user_bounds": _cubed("(SELECT floor(create_date / 86400000.0) AS day, query_type, CASE WHEN trim(query_user) <> '' THEN lower(trim(query_user)) END AS id FROM query_metric)", ["day", "query_type"]),
}
