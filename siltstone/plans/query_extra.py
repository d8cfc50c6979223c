"""Queries on options, index-first search, shapes, readers, writers, streams and kept results, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.content import analyse
from siltstone.operators import aggregate, discovery, indexsearch, joins, lifecycle, shaping, similarity
from siltstone.operators.results import CachedResult
from siltstone.operators.sessions import SessionStore
from siltstone.plans.catalog import EXACT, TEXT, Catalog, Field
from siltstone.plans.engine import EventQuery
from siltstone.plans.options import Options
from siltstone.plans.query_documents import Run, order_documents, with_options
from siltstone.plans.query_graph import TREE, _tree
from siltstone.plans.query_predicates import GEO_VIEW, KEYS, on
from siltstone.sources import ingest
from siltstone.sources.tables import table
from siltstone.storage import fresh_path, stage
from siltstone.streaming import ingest as live

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


EVENT = ", ".join(KEYS["city_event"])

# ---- index first ----------------------------------------------------------------------------------


def indexed_events(spark: SparkSession, sf: str) -> EventQuery:
    """City events that are looked up in an index of their countries, cities and codes first."""
    q = on(spark, sf, "city_event")
    fields = ["COUNTRY", "CITY", "CODE"]
    q.catalog = replace(q.catalog, indexed=set(fields))
    q.index = stage(indexsearch.postings(q.docs, q.catalog, fields, "uid", ["shard_id", "datatype"]), "postings")
    return q


@query(f"SELECT {EVENT} FROM city_event WHERE lower(country) = 'pabeia' AND num > 300")
def index_first_eq(spark: SparkSession, sf: str) -> DataFrame:
    return indexed_events(spark, sf).matching("COUNTRY == 'pabeia' && NUM > 300").select(*KEYS["city_event"])


@query(f"SELECT {EVENT} FROM city_event WHERE (lower(country) = 'pabeia' OR len(list_filter(city, lambda x: regexp_full_match(x, 'be.*', 'is'))) > 0) AND NOT coalesce(lower(continent) = 'aurrira', false)")
def index_first_or_not(spark: SparkSession, sf: str) -> DataFrame:
    return indexed_events(spark, sf).matching("(COUNTRY == 'pabeia' || CITY =~ 'be.*') && !(CONTINENT == 'aurrira')").select(*KEYS["city_event"])


@query(f"SELECT {EVENT} FROM city_event WHERE start_date BETWEEN '20150105' AND '20150120' AND lower(country) >= 'b' AND lower(country) < 'd'")
def index_first_range(spark: SparkSession, sf: str) -> DataFrame:
    text = "((_Bounded_ = true) && (COUNTRY >= 'b' && COUNTRY < 'd'))"
    return indexed_events(spark, sf).matching(text, dates=("20150105", "20150120")).select(*KEYS["city_event"])


# ---- options --------------------------------------------------------------------------------------


@query("SELECT least(count(*), 10) AS n FROM city_event WHERE num > 500")
def max_results(spark: SparkSession, sf: str) -> DataFrame:
    return on(spark, sf, "city_event").run("NUM > 500", options=with_options(max_results_override="10")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_quantity, l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'A')")
def strip_context(spark: SparkSession, sf: str) -> DataFrame:
    out = order_documents(spark, sf).run("FLAG == 'A'", options=with_options(include_grouping_context="false"))
    return out.select("l_orderkey", F.array_join("flag", ",").alias("flags"))


@query(f"""
WITH t AS (SELECT * FROM {TREE} AS x), c AS (SELECT parent, count(*) AS n FROM t WHERE parent IS NOT NULL GROUP BY parent)
SELECT uid, parent AS PARENT_UID, coalesce((SELECT n FROM c WHERE c.parent = t.uid), 0) AS CHILD_COUNT,
  coalesce((SELECT n FROM c WHERE c.parent = t.uid), 0) + coalesce((SELECT CAST(sum(c.n) AS BIGINT) FROM t AS k JOIN c ON c.parent = k.uid WHERE k.parent = t.uid), 0) AS DESCENDANT_COUNT
FROM t WHERE regexp_full_match(uid, '[rn].*')""")
def hierarchy_fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = _tree(spark, sf)
    q = EventQuery(docs, Catalog.of(docs), ["uid"], parent="parent")
    return q.run("UID =~ '[rn].*'", options=with_options(include_hierarchy_fields="true")).select("uid", "PARENT_UID", "CHILD_COUNT", "DESCENDANT_COUNT")


@query(f"SELECT uid FROM {TREE} AS t WHERE uid = 'r1' OR parent = 'r1' OR parent IN (SELECT uid FROM {TREE} AS k WHERE parent = 'r1')")
def content_with_children(spark: SparkSession, sf: str) -> DataFrame:
    docs = _tree(spark, sf)
    return joins.with_children(joins.lookup(docs, "uid", ["r1"]), docs, "uid", "parent").select("uid")


@query("SELECT doc_id, text FROM documents WHERE lang = 'pl'")
def content_view(spark: SparkSession, sf: str) -> DataFrame:
    """One of the views of a document's content."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", F.upper("text").alias("loud"))
    q = EventQuery(docs, Catalog.of(docs, {"LANG": EXACT}), ["doc_id"], views={"PLAIN": "text", "LOUD": "loud"})
    return q.run("LANG == 'pl'", options=Options(other={"content.view.name": "PLAIN"})).select("doc_id", F.col("text")).drop("loud")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE 'Customer' END AS c_name FROM customer WHERE c_acctbal > 5000")
def masked_option(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "customer").withColumn("masked", F.lit("Customer"))
    q = EventQuery(docs, Catalog.of(docs), ["c_custkey"], masked={"c_name": ("masked", F.col("c_mktsegment") == "BUILDING")})
    return q.run("C_ACCTBAL > 5000").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def raw_data_only(spark: SparkSession, sf: str) -> DataFrame:
    return on(spark, sf, "customer").run("C_ACCTBAL > 9000", options=with_options(raw_data_only="true", hit_list="true", include_record_id="true"))


@query("""
SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY n) AS flags FROM (
  SELECT l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) AS n FROM lineitem) AS d
WHERE l_linestatus = 'F' GROUP BY l_orderkey""")
def matching_field_option(spark: SparkSession, sf: str) -> DataFrame:
    out = order_documents(spark, sf).run("STATUS == 'F'", options=with_options(matching_field_sets="STATUS=FLAG"))
    return out.select("l_orderkey", F.array_join(F.transform("flag", lambda x: x["value"]), ",").alias("flags"))


# ---- grouping and uniqueness ----------------------------------------------------------------------


@query("""
WITH p AS (SELECT DISTINCT ON (i, v) i, v FROM (SELECT row_number() OVER () AS i, country, continent FROM city_event) AS e, unnest([country, continent]) AS a(v)),
g AS (SELECT i, v FROM p WHERE v IS NOT NULL OR i NOT IN (SELECT i FROM p WHERE v IS NOT NULL))
SELECT v AS PLACE, count(*) AS COUNT FROM g GROUP BY v""")
def group_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """A name that stands for two fields: the values of both, equal ones of a document once."""
    q = on(spark, sf, "city_event")
    q.catalog.model["PLACE"] = ["COUNTRY", "CONTINENT"]
    return q.run("f:groupby('PLACE')")


@query("SELECT list_sort(city) IS NULL AS none, len(city) AS n, count(*) AS found FROM (SELECT DISTINCT CASE WHEN len(city) > 0 THEN list_sort(city, 'ASC', 'NULLS FIRST') END AS city FROM city_event) AS d GROUP BY ALL")
def unique_multi_valued(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with different lists of cities: how many of each length."""
    out = on(spark, sf, "city_event").run("f:unique('CITY')")
    city = F.when(F.size("city") > 0, F.col("city"))
    return out.select(city.isNull().alias("none"), F.when(city.isNotNull(), F.size(city)).cast("bigint").alias("n")).groupBy("none", "n").agg(F.count("*").alias("found"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT code FROM city_event) AS d")
def unique_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the field are one group."""
    return on(spark, sf, "city_event").run("f:unique('CODE')").agg(F.count("*").alias("n"))


@query("SELECT l_linestatus AS L_LINESTATUS, count(*) AS COUNT, count(*) AS L_QUANTITY_COUNT, CAST(sum(l_quantity) AS DOUBLE) AS L_QUANTITY_SUM, round(avg(l_quantity), 4) AS L_QUANTITY_AVERAGE FROM lineitem WHERE l_quantity > 10 GROUP BY l_linestatus")
def grouped_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Results of two parts of the documents, grouped separately, as one."""
    q = on(spark, sf, "lineitem", ("L_RETURNFLAG", "L_LINESTATUS"))
    by, aggregates = ["L_LINESTATUS"], {"count": ["L_QUANTITY"], "sum": ["L_QUANTITY"], "average": ["L_QUANTITY"]}
    parts = [aggregate.group(q.matching(f"L_QUANTITY > 10 && L_LINENUMBER {c} 3"), q.catalog, by, aggregates) for c in ("<=", ">")]
    return aggregate.merge_groups(parts, by, aggregates).withColumn("L_QUANTITY_AVERAGE", F.round("L_QUANTITY_AVERAGE", 4))


def _lucene(name: str, text: str, sql: str, source: str, columns: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = on(spark, sf, source, ("L_RETURNFLAG", "L_LINESTATUS")).run(text, "LUCENE")
        return out.select(*columns) if columns else out

    QUERIES[name], ORACLES[name] = run, sql


_lucene("lucene_group_functions", "L_QUANTITY:[11 TO *] #GROUPBY(L_RETURNFLAG) #COUNT(L_TAX) #MAX(L_TAX) #MIN(L_TAX)", "SELECT l_returnflag AS L_RETURNFLAG, count(*) AS COUNT, count(l_tax) AS L_TAX_COUNT, max(l_tax) AS L_TAX_MAX, min(l_tax) AS L_TAX_MIN FROM lineitem WHERE l_quantity >= 11 GROUP BY l_returnflag", "lineitem")
_lucene("lucene_unique", "VALUE:[5 TO *] #UNIQUE(USER_ID, EVENT_TYPE)", "SELECT min(event_id) AS event_id FROM events WHERE value >= 5 GROUP BY user_id, event_type", "events", ["event_id"])
_lucene("lucene_unique_by_hour", "VALUE:[5 TO *] #UNIQUE_BY_HOUR(TS)", "SELECT min(event_id) AS event_id FROM events WHERE value >= 5 GROUP BY date_trunc('hour', ts)", "events", ["event_id"])
_lucene("lucene_rename", "C_ACCTBAL:[9000 TO *] #RENAME(C_NAME=TITLE)", "SELECT c_custkey, c_name AS TITLE FROM customer WHERE c_acctbal >= 9000", "customer", ["c_custkey", "TITLE"])
_lucene("lucene_options", "C_ACCTBAL:[9000 TO *] #OPTIONS('return.fields', 'C_NAME')", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 9000", "customer")
_lucene("lucene_excerpt", 'TEXT:"the reverse index" #EXCERPT_FIELDS(TEXT/2/before)', """
SELECT doc_id, trim(regexp_extract(line, '((?:[^ ]+ ){0,2})the reverse index', 0)) AS HIT_EXCERPT FROM (
  SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS line FROM documents) AS d WHERE contains(line, ' the reverse index ')""", "documents", ["doc_id", "HIT_EXCERPT"])


def _lucene_lines(name: str, text: str, sql: str) -> None:
    QUERIES[name], ORACLES[name] = lambda spark, sf: order_documents(spark, sf).matching(text, "LUCENE").select("l_orderkey"), sql


_lucene_lines("lucene_matches_in_group", "#MATCHES_IN_GROUP(FLAG, R, STATUS, O)", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'")
_lucene_lines("lucene_matches_in_group_left", "#MATCHES_IN_GROUP_LEFT(HFLAG, R, HSTATUS, O)", """
WITH r AS (SELECT DISTINCT l_orderkey, l_suppkey % 2 AS g FROM lineitem WHERE l_returnflag = 'R'),
x AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
y AS (SELECT l.l_orderkey, count(*) AS n FROM lineitem AS l JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_suppkey % 2 = r.g WHERE l_linestatus = 'O' GROUP BY l.l_orderkey)
SELECT x.l_orderkey FROM x LEFT JOIN y ON x.l_orderkey = y.l_orderkey WHERE x.n + coalesce(y.n, 0) >= 2""")
_lucene_lines("lucene_atom_values_match", "#ATOM_VALUES_MATCH(QTY, LINE)", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = l_linenumber")


# ---- content --------------------------------------------------------------------------------------

WORDS_SQL = "(SELECT doc_id, ' ' || array_to_string(list_transform(w, lambda x, i: x || '/' || ((i - 1) % 7)), ' ') || ' ' AS line FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) AS t) AS d"


def _analysed(spark: SparkSession, sf: str, **how) -> EventQuery:  # noqa: ANN003
    docs = table(spark, sf, "documents").select("doc_id", analyse(F.col("text"), **how).alias("tokens"))
    return EventQuery(docs, Catalog({}, analysed={"TOKENS": "tokens"}), ["doc_id"])


@query(f"SELECT doc_id FROM {WORDS_SQL} WHERE regexp_matches(line, ' the/[0-4] reverse/[0-4] index/[0-4] ')")
def content_scored_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens carry scores, here a number that their place gives; only those up to 4 count."""
    q = _analysed(spark, sf, accents=True, score=lambda w, i: i % 7)
    return q.matching("content:scoredPhrase(TOKENS, 4, termOffsetMap, 'the', 'reverse', 'index')").select("doc_id")


@query(f"SELECT doc_id FROM {WORDS_SQL} WHERE regexp_matches(line, ' (hold|carry)/\\d ((the|a|of)/\\d )*second/\\d ')")
def content_phrase_skips(spark: SparkSession, sf: str) -> DataFrame:
    """Stop words in between are skipped, and a synonym stands at its term's place."""
    q = _analysed(spark, sf, accents=True, stop_words={"the", "a", "of"}, synonyms={"carry": ["hold"]})
    return q.matching("content:phrase(TOKENS, termOffsetMap, 'hold', 'second')").select("doc_id")


# ---- shapes ---------------------------------------------------------------------------------------


def _shaped(spark: SparkSession, sf: str) -> EventQuery:
    """A square of side 10 and a line of length 10 at every point."""
    from siltstone.functions.geo import coordinates

    docs = table(spark, sf, "city_event")
    lat, lon = coordinates(F.col("geo"))
    docs = docs.select(*KEYS["city_event"], lat.alias("lat"), lon.alias("lon")).where("lat is not null and lon is not null")
    at = lambda x, y: F.concat_ws(" ", (F.col("lon") + x).cast("string"), (F.col("lat") + y).cast("string"))
    square = F.concat(F.lit("POLYGON(("), F.concat_ws(", ", at(-5, -5), at(5, -5), at(5, 5), at(-5, 5), at(-5, -5)), F.lit("))"))
    line = F.concat(F.lit("LINESTRING("), F.concat_ws(", ", at(0, 0), at(10, 0)), F.lit(")"))
    docs = docs.withColumns({"square": square, "line": line})
    return EventQuery(docs, Catalog({"SQUARE": Field("SQUARE", "square", TEXT), "LINE": Field("LINE", "line", TEXT), "LAT": Field("LAT", "lat", "number", "double"), "LON": Field("LON", "lon", "number", "double")}), KEYS["city_event"])


def _shape(name: str, text: str, condition: str) -> None:
    QUERIES[name] = lambda spark, sf: _shaped(spark, sf).matching(text).select(*KEYS["city_event"])
    ORACLES[name] = f"SELECT {EVENT} FROM {GEO_VIEW} WHERE {condition}"


BOX = "POLYGON((0 0, 41 0, 41 41, 0 41, 0 0))"
_shape("geowave_contains", "geowave:contains(SQUARE, 'POINT(20.3 20.7)')", "abs(g_lon - 20.3) < 5 AND abs(g_lat - 20.7) < 5")
_shape("geowave_covers", "geowave:covers(SQUARE, 'POLYGON((20.3 20.7, 22.3 20.7, 22.3 22.7, 20.3 22.7, 20.3 20.7))')", "g_lon - 5 <= 20.3 AND g_lon + 5 >= 22.3 AND g_lat - 5 <= 20.7 AND g_lat + 5 >= 22.7")
_shape("geowave_covered_by", f"geowave:covered_by(SQUARE, '{BOX}')", "g_lon - 5 >= 0 AND g_lon + 5 <= 41 AND g_lat - 5 >= 0 AND g_lat + 5 <= 41")
_shape("geowave_overlaps", f"geowave:overlaps(SQUARE, '{BOX}')", "g_lon + 5 > 0 AND g_lon - 5 < 41 AND g_lat + 5 > 0 AND g_lat - 5 < 41 AND NOT (g_lon - 5 >= 0 AND g_lon + 5 <= 41 AND g_lat - 5 >= 0 AND g_lat + 5 <= 41)")
_shape("geowave_crosses", f"geowave:crosses(LINE, '{BOX}')", "g_lat > 0 AND g_lat < 41 AND g_lon + 10 > 0 AND g_lon < 41 AND NOT (g_lon >= 0 AND g_lon + 10 <= 41)")
_shape("geo_split_fields", "geo:within_bounding_box(LON, LAT, -60.0, 0.0, 60.0, 45.5)", "g_lat BETWEEN 0 AND 45.5 AND g_lon BETWEEN -60 AND 60")

# ---- similarity -----------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CAST(len(list_intersect(list_distinct(list_transform(range(1, length(p_name) - 5), lambda i: substr(p_name, i, 7))), list_distinct(list_transform(range(1, length(p_type) - 5), lambda i: substr(p_type, i, 7))))) AS INTEGER) AS shared
FROM (SELECT p_partkey, p_name || p_type AS p_name, p_type || p_name AS p_type FROM part) AS p""")
def ngram_overlap_score(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.concat("p_name", "p_type"), F.concat("p_type", "p_name")
    return table(spark, sf, "part").select("p_partkey", similarity.overlap_score(a, b).alias("shared"))


# ---- retention ------------------------------------------------------------------------------------

ANCHOR = 1_422_748_800_000  # 2015-02-01


@query(f"SELECT {EVENT} FROM city_event WHERE epoch_ms(load_ts) > {ANCHOR} - CASE WHEN access_level = 'private' AND datatype = 'atlas' THEN 5 WHEN access_level = 'private' OR datatype = 'wire' THEN 15 ELSE 100000 END * CAST(86400000 AS BIGINT)")
def age_off_visibility(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "city_event").withColumn("vis", F.concat_ws("&", "access_level", "datatype"))
    days = lifecycle.ttl_ms
    rules = [(["private", "atlas"], True, days(5)), (["private", "wire"], False, days(15))]
    return lifecycle.age_off_visibility(rows, "vis", F.unix_millis(F.col("load_ts").cast("timestamp")), ANCHOR, rules).select(*KEYS["city_event"])


@query(f"SELECT {EVENT} FROM city_event WHERE epoch_ms(load_ts) > {ANCHOR} - CASE access_level WHEN 'private' THEN 5 WHEN 'public' THEN 15 ELSE 100000 END * CAST(86400000 AS BIGINT)")
def age_off_token(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "city_event").withColumn("note", F.concat_ws("; ", F.lit("x"), "access_level", F.lit("y")))
    rules = {"private": lifecycle.ttl_ms(5), "public": lifecycle.ttl_ms(15)}
    return lifecycle.age_off_token(rows, "note", F.unix_millis(F.col("load_ts").cast("timestamp")), ANCHOR, rules).select(*KEYS["city_event"])


# ---- facets and kept results ----------------------------------------------------------------------


@query("SELECT 'CODE' AS field, code AS value, count(*) AS count FROM city_event WHERE code IS NOT NULL GROUP BY code ORDER BY count DESC, value LIMIT 5")
def facet_top(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.facets(table(spark, sf, "city_event"), {"CODE": "code"}, most=5)


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent' ORDER BY o_totalprice, o_orderkey LIMIT 20")
def cached_previous(spark: SparkSession, sf: str) -> DataFrame:
    """The first page again, by a session that goes on where another stopped behind the second."""
    rows = on(spark, sf, "orders").matching("O_ORDERPRIORITY == '1-URGENT'").select("o_orderkey", "o_totalprice")
    kept = CachedResult(spark, page_size=20).load(rows, ["o_totalprice", "o_orderkey"], "urgent")
    kept.next(), kept.next()
    later = CachedResult(spark, kept.store.path, page_size=20)
    return spark.createDataFrame([(r["o_orderkey"],) for r in later.previous()], "o_orderkey bigint")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_totalprice > 300000")
def cached_query(spark: SparkSession, sf: str) -> DataFrame:
    kept = CachedResult(spark).load(on(spark, sf, "orders").matching("O_ORDERPRIORITY == '1-URGENT'").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "urgent")
    return kept.query("o_orderkey, o_totalprice", "o_totalprice > 300000", order_by="o_totalprice")


# ---- readers, writers, streams --------------------------------------------------------------------

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    return ingest.read_csv(spark, path, CUSTOMER)


@query("SELECT c_custkey, c_name FROM customer")
def read_xml(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "xml")
    table(spark, sf, "customer").select("c_custkey", "c_name").write.format("xml").option("rowTag", "page").option("rootTag", "pages").save(path)
    return ingest.read_xml(spark, path, "page", "c_custkey bigint, c_name string")


@query("SELECT c_custkey, c_name FROM customer")
def read_between_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Records of several lines, told apart by their first and last token."""
    path = fresh_path(spark, "records")
    record = F.concat(F.lit("BEGIN\n"), F.col("c_custkey").cast("string"), F.lit("\n"), F.col("c_name"), F.lit("\nEND"))
    table(spark, sf, "customer").select(record.alias("value")).write.text(path)
    lines = F.split("record", "\n")
    return ingest.read_between(spark, path, "BEGIN", "END").select(F.get(lines, F.lit(1)).cast("bigint").alias("c_custkey"), F.get(lines, F.lit(2)).alias("c_name"))


@query("SELECT doc_id, substr(text, 1, 100) AS line, length(text) > 100 AS cut FROM (SELECT doc_id, doc_id || ' ' || regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL) AS d")
def read_long_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    text = F.concat_ws(" ", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[ \t\n\f\r]+", " "))
    table(spark, sf, "documents").where("text is not null").select(text.alias("value")).write.text(path)
    return ingest.read_lines(spark, path, 100).select(F.split("line", " ")[0].cast("bigint").alias("doc_id"), "line", "cut")


@query("SELECT CAST(c_custkey AS VARCHAR) || ',' || CASE WHEN c_custkey % 7 = 0 THEN 'many' ELSE CAST(c_nationkey AS VARCHAR) END AS record FROM customer WHERE c_custkey % 7 = 0")
def error_records(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that don't fit the schema."""
    path = fresh_path(spark, "errors")
    nation = F.when(F.col("c_custkey") % 7 == 0, F.lit("many")).otherwise(F.col("c_nationkey").cast("string"))
    table(spark, sf, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), nation).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.IntegerType())])
    return ingest.read_with_errors(spark, path, schema)[1].select("record")


@query("SELECT continent, country, num FROM city_event WHERE num > 500 AND continent IS NOT NULL")
def bulk_results(spark: SparkSession, sf: str) -> DataFrame:
    """A result as files, a folder for every continent."""
    path = fresh_path(spark, "results")
    rows = on(spark, sf, "city_event").matching("NUM > 500 && CONTINENT =~ '.*'").select("continent", "country", "num")
    ingest.write_results(rows, path, partition_by=["continent"])
    return spark.read.schema("country string, num bigint, continent string").parquet(path)


@query("SELECT strftime(ts, '%Y%m%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def live_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """New files of a watched folder appended to a table."""
    inbox, store = fresh_path(spark, "inbox"), fresh_path(spark, "events")
    rows = table(spark, sf, "events")
    rows.write.parquet(inbox)
    live.append(live.watch(spark, inbox, rows.schema), store, fresh_path(spark, "progress")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(store).groupBy(F.date_format("ts", "yyyyMMdd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("""
WITH q AS (
  SELECT query_id, min(lower(trim(query_user))) AS u, min(create_date) AS t FROM query_metric
  WHERE trim(query_user) <> '' AND create_date IS NOT NULL GROUP BY query_id),
c AS (SELECT u, t, count(*) AS n FROM q GROUP BY u, t),
o AS (SELECT u, t, n, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t) <= 1800000 THEN 0 ELSE 1 END AS opens FROM c),
s AS (SELECT u, t, n, sum(opens) OVER (PARTITION BY u ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT u AS query_user, min(t) AS start_ms, max(t) AS end_ms, CAST(sum(n) AS BIGINT) AS n_queries FROM s GROUP BY u, k""")
def live_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions kept up to date by a stream."""
    inbox = fresh_path(spark, "inbox")
    rows = table(spark, sf, "query_metric").select("query_user", "create_date", "query_id")
    rows.repartition(2).write.parquet(inbox)
    store = SessionStore(spark)
    live.sessions(live.watch(spark, inbox, rows.schema, files_per_batch=1), store, fresh_path(spark, "progress"), "query_user", "create_date", "query_id").awaitTermination()
    return store.sessions().select(F.col("user").alias("query_user"), "start_ms", "end_ms", F.col("n_events").alias("n_queries"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN 'low' ELSE 'high' END AS half, CASE WHEN c_nationkey < 12 THEN c_name END AS c_name FROM customer")
def permuted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own transformations, one after the other."""
    half = lambda d: d.withColumn("half", F.when(F.col("c_nationkey") < 12, "low").otherwise("high"))
    blank = lambda d: d.withColumn("c_name", F.when(F.col("half") == "low", F.col("c_name")))
    return shaping.permute(table(spark, sf, "customer"), [half, blank]).select("c_custkey", "half", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def filtered_logic(spark: SparkSession, sf: str) -> DataFrame:
    """A logic that a caller may use; another, which they may not, gives nothing."""
    q = lambda: on(spark, sf, "customer").matching("C_ACCTBAL > 9000").select("c_custkey")
    none = spark.createDataFrame([], "c_custkey bigint")
    return joins.composite([joins.filtered(q, none, True), joins.filtered(q, none, False)])


@query("SELECT 'id-' || c_custkey AS c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_nationkey < 5")
def mapped_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers as a caller sees them, of a logic that lets nothing but some nations through."""
    q = replace(on(spark, sf, "customer"), mappers={"PUBLIC": lambda c: F.concat(F.lit("id-"), c.cast("string"))}, forced="C_NATIONKEY < 5")
    return q.run("C_ACCTBAL > 9000", options=with_options(return_uid_mapper="PUBLIC")).select("c_custkey", "c_acctbal")


@query(f"SELECT {EVENT} FROM city_event WHERE load_ts BETWEEN TIMESTAMP '2015-01-10' AND TIMESTAMP '2015-01-12'")
def time_filter(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.within_time(table(spark, sf, "city_event"), "load_ts", "2015-01-10 00:00:00", "2015-01-12 00:00:00").select(*KEYS["city_event"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer")
def read_sequence(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "sequence")
    table(spark, sf, "customer").select(F.col("c_custkey").cast("string"), "c_name").rdd.map(tuple).saveAsSequenceFile(path)
    return ingest.read_sequence(spark, path)
