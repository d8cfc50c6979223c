"""Queries on terms, edges, hierarchies, similar hashes, cached results and ingested data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.lang import jexl, lucene
from siltstone.functions.content import tokens
from siltstone.operators import cachedsql, discovery, edges, indexsearch, joins, lifecycle, services, shaping, similarity
from siltstone.operators.results import CachedResult
from siltstone.plans.catalog import Catalog, pad_ipv4
from siltstone.plans.query_documents import Run
from siltstone.plans.query_predicates import on
from siltstone.sources import ingest
from siltstone.sources.tables import table

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- discovery and facets -------------------------------------------------------------------------

FRAGMENTS = "(SELECT fragment_id, any_value(norm_value) AS norm_value, any_value(field_name) AS field_name, any_value(shard_id) AS shard_id, any_value(datatype) AS datatype, any_value(uid_count) AS uid_count FROM term_index GROUP BY fragment_id) AS f"


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "term_index").select("fragment_id", "norm_value", "field_name", "shard_id", "datatype", "uid_count")


def _discovered(condition: str) -> str:
    return f"SELECT norm_value, field_name, datatype, substr(shard_id, 1, 8) AS date, CAST(sum(uid_count) AS BIGINT) AS count FROM {FRAGMENTS} WHERE {condition} GROUP BY ALL HAVING sum(uid_count) > 0"


@query(_discovered("norm_value = 'aurbren' OR (field_name = 'CITY' AND norm_value = 'nadel')"))
def discovery_term(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.discover(_index(spark, sf), jexl.parse("_ANYFIELD_ == 'aurbren' || CITY == 'nadel'"))


@query(_discovered("field_name = 'COUNTRY' AND regexp_full_match(norm_value, 'ba.*ia', 'is')"))
def discovery_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.discover(_index(spark, sf), jexl.parse("COUNTRY =~ 'ba.*ia'"))


@query(_discovered("field_name = 'CITY' AND norm_value >= 'na' AND norm_value < 'nb'"))
def discovery_range(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.discover(_index(spark, sf), jexl.parse("((_Bounded_ = true) && (CITY >= 'na' && CITY < 'nb'))"))


@query(f"SELECT norm_value, field_name, CAST(sum(uid_count) AS BIGINT) AS count FROM {FRAGMENTS} WHERE norm_value LIKE '%land' GROUP BY ALL")
def discovery_reverse(spark: SparkSession, sf: str) -> DataFrame:
    hits = discovery.reverse_discover(_index(spark, sf), "land")
    return discovery.fragments(hits, ["norm_value", "field_name", "uid_count"]).groupBy("norm_value", "field_name").agg(F.sum("uid_count").alias("count"))


@query("SELECT access_level, lower(country) AS norm_value, 'COUNTRY' AS field_name, datatype, substr(shard_id, 1, 8) AS date, count(*) AS count FROM (SELECT DISTINCT uid, shard_id, datatype, access_level, country FROM city_event) AS d WHERE lower(country) = 'pabeia' GROUP BY ALL")
def discovery_by_vis(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.discover(_own_index(spark, sf), jexl.parse("COUNTRY == 'pabeia'"), fragment_id="uid", visibility="access_level")


@query("SELECT lower(country) AS norm_value, 'COUNTRY' AS field_name, datatype, substr(shard_id, 1, 8) AS date, count(DISTINCT (uid, access_level)) AS count FROM city_event WHERE lower(country) = 'pabeia' GROUP BY ALL")
def discovery_references(spark: SparkSession, sf: str) -> DataFrame:
    index = _own_index(spark, sf).withColumn("uid", F.concat_ws("/", "uid", F.coalesce("access_level", F.lit("-"))))
    return discovery.discover(index, jexl.parse("COUNTRY == 'pabeia'"), fragment_id="uid", references=True)


def _own_index(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of countries with their visibility; every document counts once."""
    docs = table(spark, sf, "city_event").where("country is not null")
    return docs.select("uid", "shard_id", "datatype", "access_level", F.lower("country").alias("norm_value"), F.lit("COUNTRY").alias("field_name"), F.lit(1).cast("long").alias("uid_count")).distinct()


@query(f"SELECT field_name, datatype, shard_id, CAST(sum(uid_count) AS BIGINT) AS count FROM {FRAGMENTS} WHERE norm_value = 'draldozimia' GROUP BY ALL")
def term_index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = discovery.fragments(_index(spark, sf).where("norm_value = 'draldozimia'"), ["field_name", "datatype", "shard_id", "uid_count"])
    return rows.groupBy("field_name", "datatype", "shard_id").agg(F.sum("uid_count").alias("count"))


@query(f"SELECT field_name, norm_value, datatype, count(*) AS entries, CAST(sum(uid_count) AS BIGINT) AS count FROM {FRAGMENTS} WHERE field_name IN ('CONTINENT', 'ACCESS') OR (field_name IN ('CITY', 'STATE') AND norm_value = 'nadel') GROUP BY ALL")
def index_count(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.count_fields(_index(spark, sf), "CONTINENT access PLACE:Nadel", {"PLACE": ["CITY", "STATE"]})


@query("SELECT field_name, datatype, count(*) AS entries, count(DISTINCT norm_value) AS terms, min(substr(shard_id, 1, 8)) AS first_day, max(substr(shard_id, 1, 8)) AS last_day FROM term_index GROUP BY field_name, datatype")
def data_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.dictionary(table(spark, sf, "term_index"))


@query("SELECT 'COUNTRY' AS field, country AS value, count(*) AS count FROM city_event WHERE num >= 500 AND country IS NOT NULL GROUP BY country HAVING count(*) >= 2")
def facet_field(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.facets(on(spark, sf, "city_event").matching("NUM >= 500"), {"COUNTRY": "country"}, least=2)


@query("""
SELECT field, value, count(*) AS count FROM (
  SELECT 'CITY' AS field, unnest(list_distinct(city)) AS value FROM city_event WHERE num >= 500
  UNION ALL SELECT 'STATE', unnest(list_distinct(state)) FROM city_event WHERE num >= 500
  UNION ALL SELECT 'CONTINENT', continent FROM city_event WHERE num >= 500) AS d WHERE value IS NOT NULL GROUP BY field, value""")
def facet_field_value(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.facets(on(spark, sf, "city_event").matching("NUM >= 500"), {"CITY": "city", "STATE": "state", "CONTINENT": "continent"})


@query("SELECT 'CONTINENT' AS field, continent AS value, start_date, count(*) AS count FROM city_event WHERE continent IS NOT NULL GROUP BY continent, start_date")
def facet_day_count(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.facets(table(spark, sf, "city_event"), {"CONTINENT": "continent"}, day="start_date")


@query("SELECT 'CONTINENT' AS field, continent AS value, shard_id, count(*) AS count FROM city_event WHERE continent IS NOT NULL GROUP BY continent, shard_id")
def facet_shard_count(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.facets(table(spark, sf, "city_event"), {"CONTINENT": "continent"}, day="shard_id")


# ---- edges ----------------------------------------------------------------------------------------

IN_STATE = edges.EdgeDefinition("LocatedIn", "CITY", "STATE", "CITY", "STATE", "GAZETTEER", "GAZETTEER", both_ways=True, precondition="NUM >= 0", attribute2="CODE", attribute3="CONTINENT")


def _edge_rows(source: str, sink: str, relation: str) -> str:
    return f"""SELECT {source} AS source, {sink} AS sink, 'LocatedIn' AS type, '{relation}' AS relation, 'GAZETTEER-GAZETTEER' AS attribute1, coalesce(code, '') AS attribute2, coalesce(continent, '') AS attribute3,
  unnest(CASE WHEN active IS NULL OR day = active THEN [day] ELSE [day, active] END) AS date, unnest(CASE WHEN active IS NULL THEN ['A'] WHEN day = active THEN ['B'] ELSE ['A', 'C'] END) AS date_type,
  'STANDARD' AS format, hour, day AS load_date, num AS seconds
 FROM (SELECT *, strftime(load_ts, '%Y%m%d') AS day, hour(load_ts) AS hour, strftime(try_strptime(start_date, '%Y%m%d'), '%Y%m%d') AS active FROM city_event) AS v, unnest(city) AS a(c), unnest(state) AS b(s) WHERE num >= 0 AND c IS NOT NULL AND s IS NOT NULL"""


EDGES_SQL = f"({_edge_rows('c', 's', 'CITY-STATE')} UNION ALL {_edge_rows('s', 'c', 'STATE-CITY')}) AS e"
EDGE_KEYS = ", ".join(edges.KEYS)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "city_event").withColumn("activity", F.try_to_timestamp("start_date", F.lit("yyyyMMdd")))
    return edges.build(docs, Catalog.of(docs), [IN_STATE], "load_ts", "activity", "load_ts", "num")


@query(f"SELECT source, sink, relation, date, date_type, count(*) AS count FROM {EDGES_SQL} GROUP BY ALL")
def edge_build(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).groupBy("source", "sink", "relation", "date", "date_type").agg(F.count("*").alias("count"))


@query(f"SELECT {EDGE_KEYS} FROM {EDGES_SQL} WHERE regexp_full_match(source, 'BE.*', 'is') AND regexp_full_match(sink, '.*land', 'is') AND date BETWEEN '20150105' AND '20150131' AND date_type <> 'C'")
def edge_query(spark: SparkSession, sf: str) -> DataFrame:
    return edges.query(_edges(spark, sf), "(SOURCE =~ 'BE.*') && (SINK =~ '.*LAND')", ("20150105", "20150131")).select(*edges.KEYS)


@query(f"SELECT source, sink, date FROM {EDGES_SQL} WHERE lower(source) = 'nadel' AND NOT lower(sink) = 'norta' AND lower(relation) = 'city-state' AND date_type <> 'C'")
def edge_query_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return edges.query(_edges(spark, sf), "SOURCE == 'NADEL' && SINK != 'NORTA' && RELATION == 'CITY-STATE'").select("source", "sink", "date")


@query(f"SELECT source, sink, attribute2, attribute3, date FROM {EDGES_SQL} WHERE regexp_full_match(source, 'n.*', 'is') AND lower(attribute3) = 'aurrira' AND attribute2 <> '' AND date_type <> 'C'")
def edge_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return edges.query(_edges(spark, sf), "SOURCE =~ 'N.*' && ATTRIBUTE3 == 'AURRIRA' && ATTRIBUTE2 != ''").select("source", "sink", "attribute2", "attribute3", "date")


@query(f"""SELECT {EDGE_KEYS}, count(*) AS count, bit_or(CAST(1 AS INTEGER) << CAST(hour AS INTEGER)) AS hour_mask, min(load_date) AS load_date, concat_ws(',', {', '.join(f'count(*) FILTER (WHERE hour = {h})' for h in range(24))}) AS hours,
concat_ws(',', {', '.join(f'count(*) FILTER (WHERE seconds >= {a} AND seconds < {b})' for a, b in zip([-(2**62), *edges.DURATIONS], [*edges.DURATIONS, 2**62]))}) AS durations FROM {EDGES_SQL} GROUP BY {EDGE_KEYS}""")
def edge_combine_hours(spark: SparkSession, sf: str) -> DataFrame:
    return edges.combine(_edges(spark, sf)).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("hours", "durations")})


@query(f"SELECT source, type, count(*) AS count, count(DISTINCT date) AS days FROM {EDGES_SQL} GROUP BY source, type")
def edge_stats(spark: SparkSession, sf: str) -> DataFrame:
    return edges.merge(edges.combine(_edges(spark, sf))).groupBy("source", "type").agg(F.sum("count").alias("count"), F.count_distinct("date").alias("days"))


@query(f"""
SELECT source, sink, relation, format, date, count(*) AS count FROM {EDGES_SQL} WHERE lower(source) = 'nadel' AND date_type <> 'C' GROUP BY ALL
UNION ALL SELECT source, NULL, split_part(relation, '-', 1), 'STATS', date, count(*) FROM {EDGES_SQL} WHERE lower(source) = 'nadel' AND date_type <> 'C' GROUP BY ALL""")
def edge_stats_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A source's edges with the stats edges of its days."""
    combined = edges.combine(_edges(spark, sf))
    both = combined.unionByName(edges.stats_edges(combined))
    return edges.query(both, "SOURCE == 'nadel'", include_stats=True).groupBy("source", "sink", "relation", "format", "date").agg(F.sum("count").alias("count"))


@query()
def edge_link_counts(spark: SparkSession, sf: str) -> DataFrame:
    return edges.link_counts(_edges(spark, sf)).select("source", "type", F.hll_sketch_estimate("links").alias("links"))


@query("SELECT DISTINCT uid, event_id, load_ts FROM city_event WHERE num >= 0 AND list_contains(city, 'Nadel') AND len(list_filter(state, lambda x: x IS NOT NULL)) > 0")
def edge_to_event(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "city_event")
    found = edges.query(_edges(spark, sf), "SOURCE == 'nadel' && RELATION == 'CITY-STATE'").where("source = 'Nadel'")
    return edges.to_documents(found, docs.where("num >= 0"), "city", "state").select("uid", "event_id", "load_ts").distinct()


@query(f"SELECT type, relation, attribute1, min(date) AS start_date, max(date) AS last_date, count(*) AS count FROM {EDGES_SQL} GROUP BY type, relation, attribute1")
def edge_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return edges.dictionary(_edges(spark, sf))


def _dated_edges(kind: str) -> None:
    loaded, sorts = edges.DATE_TYPES[kind]
    day = "load_date" if loaded else "date"
    sql = f"SELECT source, sink, date, date_type FROM {EDGES_SQL} WHERE lower(source) = 'nadel' AND {day} BETWEEN '20150105' AND '20150120'" + (f" AND date_type IN ({', '.join(repr(x) for x in sorts)})" if sorts else "")
    name = "edge_date_types" if kind == "ACTIVITY" else f"edge_date_{kind.lower()}"
    QUERIES[name] = lambda spark, sf: edges.query(_edges(spark, sf), "SOURCE == 'NADEL'", ("20150105", "20150120"), kind).select("source", "sink", "date", "date_type")
    ORACLES[name] = sql


for _kind in edges.DATE_TYPES:
    _dated_edges(_kind)

# ---- joins and hierarchies ------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def chained_query(spark: SparkSession, sf: str) -> DataFrame:
    first = on(spark, sf, "orders").matching("O_TOTALPRICE > 450000")
    return joins.chained(first, table(spark, sf, "customer"), {"o_custkey": "c_custkey"}).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 77)")
def lookup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return joins.lookup(table(spark, sf, "orders"), "o_orderkey", [1, 5, 77]).select("o_orderkey", "o_totalprice")


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations and customers as one hierarchy of documents."""
    id_ = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("double")
    region = table(spark, sf, "region").select(id_("r", "r_regionkey").alias("uid"), F.lit(None).cast("string").alias("parent"), none.alias("balance"))
    nation = table(spark, sf, "nation").select(id_("n", "n_nationkey").alias("uid"), id_("r", "n_regionkey").alias("parent"), none.alias("balance"))
    customer = table(spark, sf, "customer").select(id_("c", "c_custkey").alias("uid"), id_("n", "c_nationkey").alias("parent"), F.col("c_acctbal").alias("balance"))
    return region.unionByName(nation).unionByName(customer)


TREE = "(SELECT 'r' || r_regionkey AS uid, NULL AS parent, NULL AS balance FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, NULL FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer)"


@query(f"SELECT t.uid, count(k.uid) AS children FROM {TREE} AS t LEFT JOIN {TREE} AS k ON k.parent = t.uid GROUP BY t.uid")
def child_count(spark: SparkSession, sf: str) -> DataFrame:
    return joins.child_counts(_tree(spark, sf), "uid", "parent")


@query(f"SELECT uid FROM {TREE} AS t WHERE uid IN (SELECT parent FROM {TREE} AS k WHERE balance > 9900)")
def parent_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = _tree(spark, sf)
    return joins.parents(docs.where("balance > 9900"), docs, "uid", "parent").select("uid")


@query(f"""
WITH h AS (SELECT uid, parent FROM {TREE} AS t WHERE balance > 9900)
SELECT uid AS hit, uid AS ancestor FROM h UNION ALL SELECT h.uid, h.parent FROM h UNION ALL SELECT h.uid, n.parent FROM h JOIN {TREE} AS n ON n.uid = h.parent WHERE n.parent IS NOT NULL""")
def ancestor_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = _tree(spark, sf)
    return joins.with_ancestors(docs.where("balance > 9900"), docs, "uid", "parent", 2)


@query("SELECT l_orderkey AS root, count(*) AS children, sum(CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END)::BIGINT AS hits FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity = 50)")
def tld_query(spark: SparkSession, sf: str) -> DataFrame:
    """Top-level documents of which any child satisfies the query, with all of their children counted."""
    return services.top_level(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_quantity") == 50)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-01-08')")
def date_index_query(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "lineitem").select(F.lit("SHIP").alias("kind"), F.date_format("l_shipdate", "yyyyMMdd").alias("date"), F.col("l_orderkey").alias("uid"))
    return joins.by_date_index(table(spark, sf, "orders"), "o_orderkey", index, "SHIP", "19970101", "19970107").select("o_orderkey")


@query("SELECT c_custkey AS id, 'customer' AS kind, c_acctbal AS balance FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier WHERE s_acctbal > 9500")
def composite_union(spark: SparkSession, sf: str) -> DataFrame:
    a = on(spark, sf, "customer").matching("C_ACCTBAL > 9500").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf, "supplier").where("s_acctbal > 9500").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    return joins.composite([a, b])


@query("SELECT p_partkey FROM part WHERE p_size = 10")
def composite_first_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    q = on(spark, sf, "part")
    return joins.first_nonempty([lambda: q.matching("P_SIZE > 100000").select("p_partkey"), lambda: q.matching("P_SIZE == 10").select("p_partkey"), lambda: q.matching("P_SIZE == 11").select("p_partkey")])


@query("SELECT DISTINCT uid FROM city_event WHERE num > 900 OR lower(country) = 'pabeia'")
def dedupe_documents(spark: SparkSession, sf: str) -> DataFrame:
    q = on(spark, sf, "city_event")
    return joins.composite([q.matching("NUM > 900").select("uid"), q.matching("COUNTRY == 'pabeia'").select("uid")], ["uid"])


# ---- similarity -----------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CAST(CASE WHEN length(p_name) + length(p_type) = 0 THEN 0 ELSE greatest(0, least(100 - floor(floor(levenshtein(p_name, p_type) * 64 / (length(p_name) + length(p_type))) * 100 / 64), 16 * least(length(p_name), length(p_type)))) END AS INTEGER) AS score FROM part""")
def ssdeep_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", similarity.edit_score(F.col("p_name"), F.col("p_type"), F.lit(48)).alias("score"))


def _hashes(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.md5(F.col("text").cast("binary"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.lit("96:"), digest, F.lit(":"), F.substring(digest, 1, 16)).alias("hash"))


@query("""
WITH h AS (SELECT doc_id, '96:' || md5(text) || ':' || substr(md5(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT a.hash AS query, b.hash AS row, 100 AS score FROM h AS a JOIN h AS b ON a.hash = b.hash WHERE a.doc_id % 100 = 0""")
def ssdeep_ngram_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of every document whose id is divisible by 100, looked up among all."""
    rows = _hashes(spark, sf)
    return similarity.similar(rows.where("doc_id % 100 = 0"), rows, "hash", "hash", 95)


# ---- cached results -------------------------------------------------------------------------------


@query("SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_acctbal > 5000 AND lower(c_mktsegment) = 'building'")
def cached_select(spark: SparkSession, sf: str) -> DataFrame:
    return cachedsql.cached_query(table(spark, sf, "customer"), "c_custkey, UPPER(c_name) AS name", "c_acctbal > 5000 AND LOWER(c_mktsegment) = 'building'")


@query("SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_mktsegment")
def cached_group_order(spark: SparkSession, sf: str) -> DataFrame:
    return cachedsql.cached_query(table(spark, sf, "customer"), "c_mktsegment, COUNT(*) AS n, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high", group_by="c_mktsegment", order_by="c_mktsegment")


@query("SELECT c_custkey, CAST(10 * 16777216 + c_nationkey * 65536 + (c_custkey % 250) AS BIGINT) AS number, '10.' || c_nationkey || '.0.' || (c_custkey % 250) AS ip FROM customer")
def cached_inet(spark: SparkSession, sf: str) -> DataFrame:
    view = table(spark, sf, "customer").select("c_custkey", F.concat_ws(".", F.lit("10"), F.col("c_nationkey").cast("string"), F.lit("0"), (F.col("c_custkey") % 250).cast("string")).alias("ip"))
    once = cachedsql.cached_query(view, "c_custkey, INET_ATON(ip) AS number")
    return cachedsql.cached_query(once, "c_custkey, number, INET_NTOA(number) AS ip")


@query("SELECT event_id, uid, try_strptime(start_date, '%Y%m%d') AS day, CAST(num AS VARCHAR) AS num FROM city_event WHERE num > 800")
def cached_str_to_date(spark: SparkSession, sf: str) -> DataFrame:
    out = cachedsql.cached_query(table(spark, sf, "city_event"), "event_id, uid, STR_TO_DATE(start_date, '%Y%m%d') AS day, CONVERT(num, CHAR) AS num", "num > 800")
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


# ---- ingest ---------------------------------------------------------------------------------------


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten_simple(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.explode(ingest.simple_fields(table(spark, sf, "events"), "props")).alias("name", "value"))
    return rows.where("value is not null")


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    user = F.struct(F.col("user_id").alias("id"), F.array(F.col("event_type"), F.lit("x")).alias("tags"))
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.struct(user.alias("user"), F.col("value")).alias("event"))).alias("j"))


def _flat_sql(*names: str) -> str:
    columns = zip(names, ("CAST(user_id AS VARCHAR)", "event_type", "'x'", "CAST(value AS VARCHAR)"))
    return " UNION ALL ".join(f"SELECT event_id, '{n}' AS name, {c} AS value FROM events WHERE {c} IS NOT NULL" for n, c in columns)


@query(_flat_sql("event.user.id", "event.user.tags", "event.user.tags", "event.value"))
def json_flatten_normal(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.flatten_json(_nested(spark, sf), "j", "NORMAL").select("event_id", F.inline("fields"))


@query(_flat_sql("id.event_0.user_0.id_0", "tags.event_0.user_0.tags_0", "tags.event_0.user_0.tags_1", "value.event_0.value_0"))
def json_flatten_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.flatten_json(_nested(spark, sf), "j", "GROUPED").select("event_id", F.inline("fields"))


@query(_flat_sql("event.user.id.event_0.user_0.id_0", "event.user.tags.event_0.user_0.tags_0", "event.user.tags.event_0.user_0.tags_1", "event.value.event_0.value_0"))
def json_flatten_both(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.flatten_json(_nested(spark, sf), "j", "GROUPED_AND_NORMAL").select("event_id", F.inline("fields"))


@query("SELECT uid, event_id, load_ts, CASE WHEN country IS NOT NULL AND code IS NOT NULL THEN country || '_' || code END AS country_code FROM city_event")
def virtual_field(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.virtual_field(table(spark, sf, "city_event"), "country_code", ["country", "code"]).select("uid", "event_id", "load_ts", "country_code")


@query("SELECT uid, event_id, load_ts, nullif(concat_ws(':', country, code), '') AS place FROM city_event")
def composite_field(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.virtual_field(table(spark, sf, "city_event"), "place", ["country", "code"], ":", allow_missing=True).select("uid", "event_id", "load_ts", "place")


@query("SELECT uid, event_id, load_ts, CASE WHEN code IS NULL THEN continent END AS continent FROM city_event")
def field_filter(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.drop_if_present(table(spark, sf, "city_event"), {"code": "continent"}).select("uid", "event_id", "load_ts", "continent")


ANCHOR = 1_422_748_800_000  # 2015-02-01


@query(f"SELECT uid, event_id, load_ts FROM city_event WHERE epoch_ms(load_ts) > {ANCHOR} - 20 * 86400000")
def age_off_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.age_off(table(spark, sf, "city_event"), F.unix_millis(F.col("load_ts").cast("timestamp")), ANCHOR, lifecycle.ttl_ms(20)).select("uid", "event_id", "load_ts")


@query(f"SELECT uid, event_id, load_ts FROM city_event WHERE epoch_ms(load_ts) > {ANCHOR} - CASE datatype WHEN 'atlas' THEN 5 WHEN 'wire' THEN 40 ELSE 20 END * CAST(86400000 AS BIGINT)")
def age_off_datatype(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"atlas": lifecycle.ttl_ms(5), "wire": lifecycle.ttl_ms(40)}
    return lifecycle.age_off(table(spark, sf, "city_event"), F.unix_millis(F.col("load_ts").cast("timestamp")), ANCHOR, lifecycle.ttl_ms(20), "datatype", rules).select("uid", "event_id", "load_ts")


@query(f"SELECT fragment_id, load_ts FROM term_index WHERE field_name NOT IN ('CITY', 'CODE') OR epoch_ms(load_ts) > {ANCHOR} - CASE field_name WHEN 'CITY' THEN 240 ELSE 48 END * 3600000")
def age_off_field(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"CITY": lifecycle.ttl_ms(240, "h"), "CODE": lifecycle.ttl_ms(48, "h")}
    return lifecycle.age_off(table(spark, sf, "term_index"), F.unix_millis(F.col("load_ts").cast("timestamp")), ANCHOR, None, "field_name", rules).select("fragment_id", "load_ts")


@query(f"SELECT uid, event_id, load_ts FROM city_event WHERE (coalesce(regexp_matches(access_level, 'priv'), false) AND epoch_ms(load_ts) > {ANCHOR} - 10 * 86400000) OR NOT coalesce(regexp_matches(access_level, 'priv'), false)")
def age_off_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.age_off_pattern(table(spark, sf, "city_event"), "access_level", F.unix_millis(F.col("load_ts").cast("timestamp")), ANCHOR, [("priv", lifecycle.ttl_ms(10))]).select("uid", "event_id", "load_ts")


def _modified(spark: SparkSession, sf: str, action: str) -> DataFrame:
    docs = table(spark, sf, "city_event")
    changes = docs.where("num >= 500").select("uid").distinct().select("uid", F.lit(action).alias("action"), F.lit("Nadel").alias("old"), F.lit("Newtown").alias("new"))
    return lifecycle.modify(docs, "uid", changes, "city").select("uid", "event_id", "load_ts", F.array_join("city", ",").alias("cities"))


def _modify_sql(expression: str) -> str:
    return f"SELECT uid, event_id, load_ts, array_to_string(CASE WHEN uid IN (SELECT uid FROM city_event WHERE num >= 500) THEN {expression} ELSE city END, ',') AS cities FROM city_event"


@query(_modify_sql("list_concat(list_filter(coalesce(city, []), lambda x, i: list_position(city, x) = i), CASE WHEN list_contains(coalesce(city, []), 'Newtown') THEN [] ELSE ['Newtown'] END)"))
def modify_insert(spark: SparkSession, sf: str) -> DataFrame:
    return _modified(spark, sf, "INSERT")


@query(_modify_sql("list_transform(coalesce(city, []), lambda x: CASE WHEN x = 'Nadel' THEN 'Newtown' ELSE x END)"))
def modify_update(spark: SparkSession, sf: str) -> DataFrame:
    return _modified(spark, sf, "UPDATE")


@query(_modify_sql("list_filter(coalesce(city, []), lambda x: x <> 'Nadel')"))
def modify_delete(spark: SparkSession, sf: str) -> DataFrame:
    return _modified(spark, sf, "DELETE")


@query(_modify_sql("['Newtown']"))
def modify_replace(spark: SparkSession, sf: str) -> DataFrame:
    return _modified(spark, sf, "REPLACE")


@query("SELECT c_custkey, '010.' || lpad(c_nationkey::VARCHAR, 3, '0') || '.000.' || lpad((c_custkey % 250)::VARCHAR, 3, '0') AS ip FROM customer")
def ipv4_normalize(spark: SparkSession, sf: str) -> DataFrame:
    ip = F.concat_ws(".", F.lit("10"), F.col("c_nationkey").cast("string"), F.lit("0"), (F.col("c_custkey") % 250).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", pad_ipv4(ip).alias("ip"))


@query("SELECT field, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT 'CITY' AS field, unnest(city) AS value FROM city_event UNION ALL SELECT 'NUM', CAST(num AS VARCHAR) FROM city_event UNION ALL SELECT 'COUNTRY', country FROM city_event) AS d WHERE value IS NOT NULL GROUP BY field")
def event_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.event_fields(table(spark, sf, "city_event"), ["city", "num", "country"], ["uid"])
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    return services.metrics_summary(table(spark, sf, "events"), ["event_type"], "value")


@query("""
SELECT lifecycle, count(*) AS n, count(error_code) AS errors, count(*) FILTER (WHERE setup_time >= 0 AND setup_time < 1000) AS fast, CAST(sum(num_results) AS BIGINT) AS results FROM query_metric WHERE create_date >= 1420588800000 GROUP BY lifecycle""")
def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return services.dashboard(table(spark, sf, "query_metric"), ["lifecycle"], 1420588800000, "create_date", "error_code", "setup_time", "num_results")


@query("SELECT query_id, num_updates, received_at FROM query_metric WHERE lower(trim(query_user)) = 'hurntesk15' AND setup_time > 500")
def query_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return services.metrics_of(table(spark, sf, "query_metric"), "query_user", "Hurntesk15 ", F.col("setup_time") > 500).select("query_id", "num_updates", "received_at")


@query("SELECT source AS category, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_id DESC, doc_id DESC) AS n FROM documents WHERE source IS NOT NULL) AS d WHERE n <= 5")
def atom_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("source").alias("category"), "shard_id", "doc_id", "n_chars")
    return services.feed(rows, "category", ["shard_id", "doc_id"], 5).select("category", "doc_id", "n_chars")


POSTINGS = "(SELECT shard_id, datatype, field_name, norm_value, unnest(uid_list) AS uid FROM term_index) AS p"


def _holding(condition: str) -> str:
    return f"SELECT DISTINCT shard_id, datatype, uid FROM {POSTINGS} WHERE uid IS NOT NULL AND {condition}"


@query(f"{_holding("field_name = 'COUNTRY' AND norm_value = 'draldozimia'")} INTERSECT {_holding("field_name = 'ACCESS' AND norm_value = 'private'")}")
def index_and(spark: SparkSession, sf: str) -> DataFrame:
    return indexsearch.search(table(spark, sf, "term_index"), jexl.parse("COUNTRY == 'draldozimia' && ACCESS == 'private'"))


@query(f"(({_holding("field_name = 'CITY' AND regexp_full_match(norm_value, 'be.*', 'is')")}) UNION ({_holding("norm_value = 'pabeia'")})) EXCEPT {_holding("field_name = 'ACCESS' AND norm_value = 'public'")}")
def index_or_not(spark: SparkSession, sf: str) -> DataFrame:
    return indexsearch.search(table(spark, sf, "term_index"), jexl.parse("(CITY =~ 'be.*' || _ANYFIELD_ == 'pabeia') && !(ACCESS == 'public')"))


@query("SELECT doc_id, term, array_to_string(list(pos - 1 ORDER BY pos), ',') AS offsets FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM documents) AS d) AS e GROUP BY doc_id, term")
def term_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with positions of every document."""
    return _offsets(table(spark, sf, "documents"))


def _offsets(docs: DataFrame) -> DataFrame:
    once = indexsearch.terms(docs, ["doc_id"], tokens(F.col("text")), "TEXT")
    return indexsearch.merge_offsets(once.unionByName(once), ["doc_id"]).select("doc_id", "term", F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"))


@query("SELECT strftime(load_ts, '%Y%m%d') AS date, array_to_string(list_sort(list(DISTINCT start_date)), ',') AS days FROM city_event WHERE strftime(load_ts, '%Y%m%d') BETWEEN '20150110' AND '20150115' AND start_date IS NOT NULL GROUP BY 1")
def date_index(spark: SparkSession, sf: str) -> DataFrame:
    index = indexsearch.date_index(table(spark, sf, "city_event"), "uid", {"LOADED": "load_ts"}, "start_date")
    return indexsearch.days_of(index, "LOADED", "20150110", "20150115").select("date", F.array_join("days", ",").alias("days"))


@query(f"SELECT source, sink, date FROM {EDGES_SQL} WHERE lower(source) IN ('nadel', 'gorwen') AND (regexp_full_match(sink, '.*land', 'is') OR regexp_full_match(sink, 'nor.*', 'is'))")
def edge_extended_query(spark: SparkSession, sf: str) -> DataFrame:
    return edges.extended_query(_edges(spark, sf), ["NADEL", "Gorwen"], [".*LAND", "nor.*"]).select("source", "sink", "date")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE lower(o_orderpriority) = '1-urgent' ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def cached_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 101 to 150 of a kept result."""
    kept = CachedResult(spark).load(on(spark, sf, "orders").matching("O_ORDERPRIORITY == '1-URGENT'").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "urgent")
    return kept.get_rows(101, 150)


@query("SELECT c_custkey FROM customer WHERE c_custkey = 5 OR lower(c_name) = 'customer#000000007'")
def uuid_lookup(spark: SparkSession, sf: str) -> DataFrame:
    q = on(spark, sf, "customer")
    node = lucene.uuid_query("key:5 OR name:Customer#000000007", {"KEY": "C_CUSTKEY", "NAME": "C_NAME"})
    return q.matching(str(node)).select("c_custkey")


@query("""
SELECT uid, array_to_string(['Nadel'], ',') AS removed, CASE WHEN bool_or(list_contains(city, 'Newtown')) THEN '' ELSE 'Newtown' END AS added FROM city_event
WHERE uid IN (SELECT uid FROM city_event WHERE num >= 500) GROUP BY uid HAVING bool_or(coalesce(list_contains(city, 'Nadel'), false))""")
def modify_history(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "city_event").select("uid", "city", "num")
    changes = docs.where("num >= 500").select("uid").distinct().select("uid", F.lit("UPDATE").alias("action"), F.lit("Nadel").alias("old"), F.lit("Newtown").alias("new"))
    log = lifecycle.history(docs, lifecycle.modify(docs, "uid", changes, "city"), "uid", "city", "2015-02-01")
    return log.select("uid", F.array_join("removed", ",").alias("removed"), F.array_join("added", ",").alias("added"))


@query("""
WITH h AS (SELECT doc_id, source, '96:' || md5(text) || ':' || substr(md5(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL)
SELECT source, count(DISTINCT doc_id) AS n FROM h WHERE hash IN (SELECT hash FROM h WHERE doc_id % 100 = 0) GROUP BY source""")
def ssdeep_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of the documents that are similar to those looked up."""
    rows = _hashes(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    found = similarity.similar_rows(rows.where("doc_id % 100 = 0").select("hash"), rows, "hash", "hash", 95)
    return found.groupBy("source").agg(F.count_distinct("doc_id").alias("n"))
