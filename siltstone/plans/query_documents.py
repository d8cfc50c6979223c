"""Queries that shape, reduce, group and page event documents, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.content import tokens
from siltstone.operators import aggregate, services, shaping
from siltstone.operators.joins import lookup
from siltstone.plans.catalog import EXACT, NUMBER, Catalog, Field
from siltstone.plans.engine import EventQuery
from siltstone.plans.options import Options
from siltstone.plans.query_predicates import on
from siltstone.sources.tables import table

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    def keep(f: Run) -> Run:
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            ORACLES[n] = sql
        return f

    return keep


def with_options(**given: str) -> Options:
    o = Options()
    for k, v in given.items():
        o.set(k.replace("_", "."), v)
    return o


# ---- shaping --------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000")
def project_include(spark: SparkSession, sf: str) -> DataFrame:
    return on(spark, sf, "customer").run("C_ACCTBAL > 9000", options=with_options(return_fields="C_NAME,C_ACCTBAL"))


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def project_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return on(spark, sf, "customer").run("C_ACCTBAL > 9000", options=with_options(disallowlisted_fields="C_NAME,C_ACCTBAL"))


@query("SELECT c_custkey, c_name AS NAME, c_name AS TITLE FROM customer WHERE lower(c_mktsegment) = 'building'")
def rename_fields(spark: SparkSession, sf: str) -> DataFrame:
    return on(spark, sf, "customer").run("C_MKTSEGMENT == 'BUILDING' && f:rename('C_NAME=NAME', 'C_NAME=TITLE')", options=with_options(return_fields="C_NAME"))


@query("""
SELECT uid, event_id, load_ts, array_to_string(list_concat(list_filter(city, lambda x: lower(x) = 'nadel'), list_filter(city, lambda x: NOT lower(x) = 'nadel'))[1:greatest(1, len(list_filter(city, lambda x: lower(x) = 'nadel')))], ',') AS cities,
  CASE WHEN len(city) > greatest(1, len(list_filter(city, lambda x: lower(x) = 'nadel'))) THEN CAST(len(city) AS INTEGER) END AS original
FROM city_event WHERE len(list_filter(city, lambda x: lower(x) = 'nadel')) > 0""")
def limit_fields(spark: SparkSession, sf: str) -> DataFrame:
    out = on(spark, sf, "city_event").run("CITY == 'nadel'", options=with_options(limit_fields="CITY=1"))
    return out.select("uid", "event_id", "load_ts", F.array_join("city", ",").alias("cities"), F.col("CITY_ORIGINAL_COUNT").alias("original"))


@query("""
SELECT uid, event_id, load_ts, array_to_string(list_sort(list_distinct(list_concat(list_transform(list_filter(coalesce(city, []), lambda x: regexp_full_match(x, 'be.*', 'is')), lambda x: 'CITY:' || x), CASE WHEN lower(country) = 'pabeia' THEN ['COUNTRY:' || country] ELSE [] END))), ',') AS hits
FROM city_event WHERE coalesce(len(list_filter(city, lambda x: regexp_full_match(x, 'be.*', 'is'))), 0) > 0 OR lower(country) = 'pabeia'""")
def hit_terms(spark: SparkSession, sf: str) -> DataFrame:
    out = on(spark, sf, "city_event").run("CITY =~ 'be.*' || COUNTRY == 'pabeia'", options=with_options(hit_list="true"))
    return out.select("uid", "event_id", "load_ts", F.array_join("HIT_TERM", ",").alias("hits"))


@query("SELECT uid, event_id, load_ts, datatype AS EVENT_DATATYPE FROM city_event WHERE num > 900 AND datatype <> 'atlas'")
def datatype_field(spark: SparkSession, sf: str) -> DataFrame:
    out = on(spark, sf, "city_event").run("NUM > 900", options=with_options(include_datatype_as_field="true", datatype_filter_set="!atlas"))
    return out.select("uid", "event_id", "load_ts", "EVENT_DATATYPE")


@query("SELECT shard_id || '/' || datatype || '/' || uid AS record_id FROM city_event WHERE num > 900")
def record_id(spark: SparkSession, sf: str) -> DataFrame:
    out = on(spark, sf, "city_event").matching("NUM > 900")
    return out.select(shaping.record_id(F.col("shard_id"), F.col("datatype"), F.col("uid")).alias("record_id"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name ELSE 'Customer' END AS c_name FROM customer")
def masked_values(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit("Customer").alias("masked"))
    return shaping.mask(df, "c_name", "masked", shaping.visible(F.col("c_mktsegment"), {"BUILDING", "MACHINERY"})).select("c_custkey", "c_name")


@query("SELECT uid, event_id, load_ts FROM city_event WHERE access_level IS NULL OR access_level IN ('public', 'shared') OR (access_level = 'private' AND datatype = 'atlas')")
def visibility_filter(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("access_level") == "private", F.concat(F.lit("private&(atlas|"), F.col("datatype"), F.lit(")"))).otherwise(F.col("access_level"))
    rows = table(spark, sf, "city_event").withColumn("_vis", F.when(F.col("access_level") == "private", F.concat(F.lit("(public&"), F.col("datatype"), F.lit(")|none"))).otherwise(label))
    return rows.where(shaping.visible(F.col("_vis"), {"public", "shared", "atlas"})).select("uid", "event_id", "load_ts")


@query("SELECT uid, event_id, load_ts FROM city_event WHERE lower(country) = 'pabeia' OR coalesce(len(list_filter(city, lambda x: lower(x) = 'pabeia')), 0) > 0")
def query_model(spark: SparkSession, sf: str) -> DataFrame:
    q = on(spark, sf, "city_event")
    q.catalog.model["PLACE"] = ["CITY", "COUNTRY"]
    return q.matching("PLACE == 'pabeia'").select("uid", "event_id", "load_ts")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 100 AND c_acctbal < 200")
def query_macro(spark: SparkSession, sf: str) -> DataFrame:
    q = on(spark, sf, "customer")
    q.macros["BALANCE"] = "((_Bounded_ = true) && (C_ACCTBAL >= $0 && C_ACCTBAL < $1))"
    return q.matching("BALANCE(100, 200)").select("c_custkey")


@query("SELECT uid, event_id, load_ts FROM city_event WHERE start_date BETWEEN '20150110' AND '20150112' AND lower(continent) = 'aurrira'")
def date_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return on(spark, sf, "city_event").matching("CONTINENT == 'aurrira'", dates=("20150110", "20150112")).select("uid", "event_id", "load_ts")


@query("SELECT entry_id, change_seq, uid_count FROM (SELECT DISTINCT entry_id, change_seq, uid_count FROM index_change) AS d QUALIFY change_seq = max(change_seq) OVER (PARTITION BY entry_id)")
def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "index_change").select("entry_id", "change_seq", "uid_count").distinct()
    return shaping.latest_versions(rows, ["entry_id"], "change_seq")


# ---- documents with grouping context: an order and its lines ---------------------------------------


def order_documents(spark: SparkSession, sf: str) -> EventQuery:
    """One document per order; a line's place in it is the context that links its values."""
    columns = {"line": "l_linenumber", "qty": "l_quantity", "flag": "l_returnflag", "status": "l_linestatus"}
    line = F.struct(*[F.col(c).alias(n) for n, c in columns.items()], F.pmod("l_suppkey", F.lit(2)).alias("half"))
    docs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    own = lambda n: F.transform("lines", lambda x, i: F.struct(x[n].alias("value"), i.cast("string").alias("ctx"))).alias(n)
    in_half = lambda n: F.transform("lines", lambda x, i: F.struct(x[n].alias("value"), F.concat(F.lit("G"), x["half"].cast("string"), F.lit("."), i.cast("string")).alias("ctx"))).alias(f"h{n}")
    docs = docs.select("l_orderkey", *map(own, columns), in_half("flag"), in_half("status"))
    field = lambda n, t, s: Field(n.upper(), n, t, s, True, True)
    fields = {f.name: f for f in (field("flag", EXACT, "string"), field("status", EXACT, "string"), field("qty", NUMBER, "double"), field("line", NUMBER, "int"), field("hflag", EXACT, "string"), field("hstatus", EXACT, "string"))}
    return EventQuery(docs, Catalog(fields), ["l_orderkey"])


def _grouped(name: str, text: str, sql: str) -> None:
    query(sql, name)(lambda spark, sf: order_documents(spark, sf).matching(text).select("l_orderkey"))


_grouped("matches_in_group", "grouping:matchesInGroup(FLAG, 'R', STATUS, 'O')", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'")
_grouped("matches_in_group_left", "grouping:matchesInGroupLeft(HFLAG, 'R', HSTATUS, 'O')", """
WITH r AS (SELECT DISTINCT l_orderkey, l_suppkey % 2 AS g FROM lineitem WHERE l_returnflag = 'R'),
x AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
y AS (SELECT l.l_orderkey, count(*) AS n FROM lineitem AS l JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_suppkey % 2 = r.g WHERE l_linestatus = 'O' GROUP BY l.l_orderkey)
SELECT x.l_orderkey FROM x LEFT JOIN y ON x.l_orderkey = y.l_orderkey WHERE x.n + coalesce(y.n, 0) >= 2""")
_grouped("groups_for_matches", "grouping:getGroupsForMatchesInGroup(FLAG, 'A', STATUS, 'F').size() >= 2", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY l_orderkey HAVING count(*) >= 2")
_grouped("atom_values_match", "grouping:atomValuesMatch(QTY, LINE).size() > 0", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = l_linenumber")
_grouped("values_for_group", "QTY.getValuesForGroups(grouping:getGroupsForMatchesInGroup(FLAG, 'R', STATUS, 'F')).max() > 45", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45")
_grouped("value_for_group", "QTY.getValueForGroup('0').max() == 50", "SELECT l_orderkey FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n FROM lineitem) AS d WHERE n = 1 AND l_quantity = 50")
_grouped("groups_for_value", "FLAG.getGroupsForValue('R').size() == 2", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey HAVING count(*) = 2")
_grouped("set_less_than", "QTY.lessThan(3).size() >= 1 && QTY.compareWith(48, '>').size() >= 1", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_quantity) < 3 AND max(l_quantity) > 48")
_grouped("method_chain", "filter:getAllMatches(FLAG, 'A|R').size() + QTY.size() > 11", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) + count(*) > 11")
_grouped("field_pairs_less", "QTY < LINE", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_quantity) < max(l_linenumber)")

# ---- aggregation ----------------------------------------------------------------------------------


def _group(name: str, text: str, sql: str, source: str = "lineitem", rounded: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = on(spark, sf, source, ("L_RETURNFLAG", "L_LINESTATUS")).run(text)
        return out.withColumns({c: F.round(F.col(c), 4) for c in rounded}) if rounded else out

    query(sql, name)(run)


_group("group_by_count", "L_QUANTITY > 10 && f:groupby('L_RETURNFLAG', 'L_LINESTATUS')", "SELECT l_returnflag AS L_RETURNFLAG, l_linestatus AS L_LINESTATUS, count(*) AS COUNT FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
_group("group_by_sum", "L_QUANTITY > 10 && f:groupby('L_LINESTATUS') && f:sum('L_EXTENDEDPRICE')", "SELECT l_linestatus AS L_LINESTATUS, count(*) AS COUNT, round(sum(l_extendedprice), 4) AS L_EXTENDEDPRICE_SUM FROM lineitem WHERE l_quantity > 10 GROUP BY l_linestatus", rounded=("L_EXTENDEDPRICE_SUM",))
_group("group_by_min", "L_QUANTITY > 10 && f:groupby('L_LINESTATUS') && f:min('L_EXTENDEDPRICE')", "SELECT l_linestatus AS L_LINESTATUS, count(*) AS COUNT, min(l_extendedprice) AS L_EXTENDEDPRICE_MIN FROM lineitem WHERE l_quantity > 10 GROUP BY l_linestatus")
_group("group_by_max", "L_QUANTITY > 10 && f:groupby('L_LINESTATUS') && f:max('L_SHIPDATE')", "SELECT l_linestatus AS L_LINESTATUS, count(*) AS COUNT, max(l_shipdate) AS L_SHIPDATE_MAX FROM lineitem WHERE l_quantity > 10 GROUP BY l_linestatus")
_group("group_by_avg", "L_QUANTITY > 10 && f:groupby('L_LINESTATUS') && f:average('L_DISCOUNT')", "SELECT l_linestatus AS L_LINESTATUS, count(*) AS COUNT, round(avg(l_discount), 4) AS L_DISCOUNT_AVERAGE FROM lineitem WHERE l_quantity > 10 GROUP BY l_linestatus", rounded=("L_DISCOUNT_AVERAGE",))
_group("group_by_count_field", "NUM >= 0 && f:groupby('CONTINENT') && f:count('CODE')", "SELECT continent AS CONTINENT, count(*) AS COUNT, count(code) AS CODE_COUNT FROM city_event WHERE num >= 0 GROUP BY continent", "city_event")
_group("group_by_multi", "L_DISCOUNT >= 0.05 && f:groupby('L_RETURNFLAG') && f:sum('L_QUANTITY') && f:max('L_TAX') && f:min('L_TAX') && f:count('L_TAX')", "SELECT l_returnflag AS L_RETURNFLAG, count(*) AS COUNT, round(sum(l_quantity), 4) AS L_QUANTITY_SUM, max(l_tax) AS L_TAX_MAX, min(l_tax) AS L_TAX_MIN, count(l_tax) AS L_TAX_COUNT FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag", rounded=("L_QUANTITY_SUM",))
_group("group_by_empty", "NUM >= 500 && f:groupby('CODE')", "SELECT code AS CODE, count(*) AS COUNT FROM city_event WHERE num >= 500 GROUP BY code", "city_event")
_group("lucene_groupby", "NUM >= 500 && f:options('group.fields', 'COUNTRY,CONTINENT')", "SELECT country AS COUNTRY, continent AS CONTINENT, count(*) AS COUNT FROM city_event WHERE num >= 500 GROUP BY ALL", "city_event")


@query("SELECT l_returnflag AS FLAG, l_linestatus AS STATUS, count(*) AS COUNT, CAST(sum(l_quantity) AS DOUBLE) AS QTY_SUM, max(l_quantity) AS QTY_MAX, count(*) AS QTY_COUNT FROM lineitem GROUP BY ALL")
def group_by_direct_match(spark: SparkSession, sf: str) -> DataFrame:
    out = order_documents(spark, sf).run("f:groupby('FLAG', 'STATUS') && f:sum('QTY') && f:max('QTY') && f:count('QTY')")
    return out


@query("""
SELECT c AS CITY, s AS STATE, count(*) AS COUNT FROM city_event,
 unnest(CASE WHEN len(list_filter(city, lambda x: x IS NOT NULL)) > 0 THEN list_filter(city, lambda x: x IS NOT NULL) ELSE [NULL] END) AS a(c),
 unnest(CASE WHEN len(list_filter(state, lambda x: x IS NOT NULL)) > 0 THEN list_filter(state, lambda x: x IS NOT NULL) ELSE [NULL] END) AS b(s) GROUP BY ALL""")
def group_by_cartesian(spark: SparkSession, sf: str) -> DataFrame:
    return on(spark, sf, "city_event").run("f:groupby('CITY', 'STATE')")


def _unique(name: str, option: str, key: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return on(spark, sf, "events").run(f"VALUE > 5 && {option}").select("event_id")

    query(f"SELECT min(event_id) AS event_id FROM events WHERE value > 5 GROUP BY {key}", name)(run)


_unique("unique_all", "f:unique('USER_ID', 'EVENT_TYPE')", "user_id, event_type")
_unique("unique_by_year", "f:unique_by_year('TS')", "date_trunc('year', ts)")
_unique("unique_by_month", "f:unique_by_month('TS')", "date_trunc('month', ts)")
_unique("unique_by_day", "f:unique_by_day('TS')", "date_trunc('day', ts)")
_unique("unique_by_hour", "f:unique_by_hour('TS')", "date_trunc('hour', ts)")
_unique("unique_by_tenth_of_hour", "f:unique_by_tenth_of_hour('TS')", "date_trunc('hour', ts), minute(ts) // 10")
_unique("unique_by_minute", "f:unique_by_minute('TS')", "date_trunc('minute', ts)")
_unique("unique_by_second", "f:unique_by_second('TS')", "date_trunc('second', ts)")
_unique("unique_by_millisecond", "f:unique_by_millisecond('TS')", "date_trunc('millisecond', ts)")
_unique("unique_two_granularities", "f:unique('TS[DAY,HOUR]', 'EVENT_TYPE')", "date_trunc('hour', ts), event_type")


@query("SELECT count(*) AS count FROM city_event WHERE lower(country) = 'pabeia'")
def event_count(spark: SparkSession, sf: str) -> DataFrame:
    return on(spark, sf, "city_event").count("COUNTRY == 'pabeia'")


@query("SELECT datatype, start_date, count(code) AS total, count(DISTINCT code) AS \"distinct\" FROM city_event GROUP BY datatype, start_date")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.index_stats(table(spark, sf, "city_event"), ["datatype", "start_date"], "code")


@query()
def selectivity(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.selectivity(table(spark, sf, "term_index"), ["field_name", "datatype"], "norm_value")


@query()
def result_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    rows = on(spark, sf, "city_event").matching("CONTINENT == 'aurrira'")
    return services.cardinality_report(rows, ["start_date"], ["country", "code", "num"])


@query("""
WITH f AS (SELECT fragment_id, any_value(field_name) AS field_name, any_value(norm_value) AS norm_value, bool_or(coalesce(ignore_flag, false)) AS ig, any_value(uid_count) AS n, any_value(uid_list) AS a, any_value(removeduid_list) AS b FROM term_index WHERE norm_value IS NOT NULL GROUP BY fragment_id),
u AS (SELECT field_name, norm_value, unnest(a) AS uid, 0 AS gone FROM f UNION ALL SELECT field_name, norm_value, unnest(b), 1 FROM f),
d AS (SELECT field_name, norm_value, uid, max(gone) AS gone FROM u WHERE uid IS NOT NULL GROUP BY field_name, norm_value, uid),
h AS (SELECT field_name, norm_value, count_if(gone = 0) AS l, count_if(gone = 1) AS r, array_to_string(list_sort(list(uid) FILTER (gone = 0)), ',') AS uids, array_to_string(list_sort(list(uid) FILTER (gone = 1)), ',') AS removed FROM d GROUP BY field_name, norm_value),
g AS (SELECT field_name, norm_value, bool_or(ig) AS flagged, sum(n) AS total FROM f GROUP BY field_name, norm_value),
k AS (SELECT g.field_name, g.norm_value, CAST(CASE WHEN flagged THEN total ELSE coalesce(l, 0) END AS BIGINT) AS count, flagged OR coalesce(l, 0) > 20 AS "ignore", l, r, uids, removed FROM g LEFT JOIN h ON g.field_name = h.field_name AND g.norm_value = h.norm_value)
SELECT field_name, norm_value, count, "ignore", CASE WHEN NOT "ignore" AND l + r > 0 THEN coalesce(uids, '') END AS uids, CASE WHEN NOT "ignore" AND l + r > 0 AND r <= 20 THEN coalesce(removed, '') END AS removed FROM k""")
def uid_list_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["field_name", "norm_value", "ignore_flag", "uid_count", "uid_list", "removeduid_list"]
    rows = table(spark, sf, "term_index").where("norm_value is not null").select("fragment_id", *columns).dropDuplicates(["fragment_id"])
    lists = aggregate.uid_lists(rows, ["field_name", "norm_value"], "uid_list", "removeduid_list", "ignore_flag", "uid_count")
    return lists.withColumns({"uids": F.array_join("uids", ","), "removed": F.array_join("removed", ",")})


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 100 + 1 AS BIGINT) AS page FROM orders WHERE lower(o_orderstatus) = 'p'")
def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = on(spark, sf, "orders").matching("O_ORDERSTATUS == 'P'").select("o_orderkey", "o_totalprice")
    return shaping.pages(rows, ["o_totalprice", "o_orderkey"], 100).select("o_orderkey", "page")


@query("""
SELECT doc_id, trim(regexp_extract(line, '((?:[^ ]+ ){0,3})the reverse index((?: [^ ]+){0,3})', 0)) AS HIT_EXCERPT FROM (
  SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS line FROM documents) AS d WHERE contains(line, ' the reverse index ')""")
def excerpt(spark: SparkSession, sf: str) -> DataFrame:
    out = on(spark, sf, "documents").run("content:phrase(TEXT, termOffsetMap, 'the', 'reverse', 'index')", options=with_options(excerpt_fields="TEXT/3/both"))
    return out.select("doc_id", "HIT_EXCERPT")


@query("""
SELECT doc_id, term, count(*) AS n, min(pos) - 1 AS first FROM (
  SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM documents) AS d) AS e
GROUP BY doc_id, term""")
def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Term counts of every document."""
    return _frequencies(table(spark, sf, "documents"))


def _frequencies(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    return docs.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").cast("bigint").alias("first"))


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id IN (17, 42, 99)")
def content_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookup(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id", [17, 42, 99])


@query("""
SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY n) AS flags FROM (
  SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) AS n FROM lineitem) AS d
WHERE l_linestatus = 'F' AND l_quantity > 40 GROUP BY l_orderkey""")
def matching_field_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Flags only of the lines in which both other fields hit."""
    q = order_documents(spark, sf)
    out = shaping.matching_field_sets(q.docs, q.catalog, {"STATUS": lambda v: v == "F", "QTY": lambda v: v.cast("double") > 40}, ["FLAG"])
    return out.where(F.size("flag") > 0).select("l_orderkey", F.array_join(F.transform("flag", lambda x: x["value"]), ",").alias("flags"))


@query("SELECT uid, event_id, load_ts FROM city_event WHERE code IS NOT NULL OR coalesce(len(list_filter(state, lambda x: x IS NOT NULL)), 0) > 0")
def drop_empty_documents(spark: SparkSession, sf: str) -> DataFrame:
    q = on(spark, sf, "city_event")
    return shaping.drop_empty(q.docs.select(*q.docs.columns), q.catalog, ["CODE", "STATE"]).select("uid", "event_id", "load_ts")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def enrich_documents(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return shaping.enrich(table(spark, sf, "customer"), facts, ["c_nationkey"]).select("c_custkey", "n_name")


@query()
def facet_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.facet_estimates(table(spark, sf, "city_event"), ["continent"], "uid", least=2)


@query("SELECT country AS COUNTRY, count(*) AS COUNT, array_to_string(list_sort(list(DISTINCT access_level)), '&') AS VISIBILITY FROM city_event WHERE num >= 500 GROUP BY country")
def group_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """The labels that a caller needs to see the whole of each group."""
    q = on(spark, sf, "city_event")
    return aggregate.group(q.matching("NUM >= 500"), q.catalog, ["COUNTRY"], visibility="access_level")


@query("SELECT uid, event_id, load_ts FROM city_event WHERE strftime(load_ts, '%Y%m%d') BETWEEN '20150110' AND '20150112' AND lower(continent) = 'aurrira'")
def date_type_query(spark: SparkSession, sf: str) -> DataFrame:
    """The date range of a query on another kind of date."""
    q = on(spark, sf, "city_event")
    q.docs = q.docs.withColumn("load_day", F.date_format("load_ts", "yyyyMMdd"))
    q.date_types["LOAD"] = "load_day"
    return q.matching("CONTINENT == 'aurrira'", dates=("20150110", "20150112"), options=with_options(date_type="LOAD")).select("uid", "event_id", "load_ts")
