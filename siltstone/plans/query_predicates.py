"""Queries that exercise one predicate each, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans.catalog import EXACT, Catalog
from siltstone.plans.engine import EventQuery
from siltstone.sources.tables import table

KEYS = {
    "lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "events": ["event_id"],
    "city_event": ["uid", "event_id", "load_ts"], "documents": ["doc_id"],
}


def over(name: str, df: DataFrame, exact: tuple[str, ...] = ()) -> EventQuery:
    """Event queries over a table of the data folder."""
    model = {"LOAD_DATE": ["LOAD_TS"]} if name == "city_event" else {}
    catalog = Catalog.of(df, {n: EXACT for n in exact}, model, tokenized={"TEXT"} if name == "documents" else frozenset())  # type: ignore[arg-type]
    day = {"city_event": "start_date"}.get(name)
    return EventQuery(df, catalog, KEYS[name], day, "datatype" if name in ("city_event", "documents") else None)


def on(spark: SparkSession, sf: str, name: str, exact: tuple[str, ...] = ()) -> EventQuery:
    return over(name, table(spark, sf, name), exact)


#: name: (table, query, SQL condition). Text fields are compared in any case.
ROWS: dict[str, tuple[str, str, str]] = {
    "cmp_eq": ("lineitem", "L_RETURNFLAG == 'r' && L_QUANTITY == 50", "lower(l_returnflag) = 'r' AND l_quantity = 50"),
    "cmp_ne": ("orders", "O_ORDERSTATUS != 'F'", "coalesce(lower(o_orderstatus) <> 'f', true)"),
    "cmp_lt": ("lineitem", "L_DISCOUNT < 0.01", "l_discount < 0.01"),
    "cmp_le": ("lineitem", "L_QUANTITY <= 2", "l_quantity <= 2"),
    "cmp_gt": ("orders", "O_TOTALPRICE > 400000", "o_totalprice > 400000"),
    "cmp_ge": ("customer", "C_ACCTBAL >= 9000", "c_acctbal >= 9000"),
    "regex_match": ("part", "P_TYPE =~ 'eco.*'", "regexp_full_match(p_type, 'eco.*', 'is')"),
    "regex_not_match": ("customer", "C_MKTSEGMENT !~ '.*U.*'", "NOT coalesce(regexp_full_match(c_mktsegment, '.*U.*', 'is'), false)"),
    "bounded_range": ("lineitem", "((_Bounded_ = true) && (L_QUANTITY >= 10 && L_QUANTITY < 12))", "l_quantity >= 10 AND l_quantity < 12"),
    "bool_and_or_not": ("orders", "(O_ORDERSTATUS == 'O' || O_TOTALPRICE > 300000) && !(O_ORDERPRIORITY == '1-URGENT')", "(lower(o_orderstatus) = 'o' OR o_totalprice > 300000) AND NOT coalesce(lower(o_orderpriority) = '1-urgent', false)"),
    "is_null": ("city_event", "CODE == null", "code IS NULL"),
    "is_not_null": ("city_event", "CODE =~ '.*?'", "code IS NOT NULL"),
    "field_to_field": ("city_event", "COUNTRY == CONTINENT || NUM > 990", "coalesce(lower(country) = lower(continent), false) OR num > 990"),
    "multi_eq": ("city_event", "CITY == 'beyorsapa'", "len(list_filter(city, lambda x: lower(x) = 'beyorsapa')) > 0"),
    "multi_ne": ("city_event", "CITY != 'beyorsapa'", "coalesce(len(list_filter(city, lambda x: lower(x) = 'beyorsapa')), 0) = 0"),
    "multi_regex": ("city_event", "CITY =~ 'be.*' && STATE =~ '.*land'", "len(list_filter(city, lambda x: regexp_full_match(x, 'be.*', 'is'))) > 0 AND len(list_filter(state, lambda x: regexp_full_match(x, '.*land', 'is'))) > 0"),
    "any_field_eq": ("city_event", "_ANYFIELD_ == 'aurbren'", "lower(continent) = 'aurbren' OR lower(country) = 'aurbren' OR lower(code) = 'aurbren' OR coalesce(len(list_filter(city, lambda x: lower(x) = 'aurbren')), 0) > 0 OR coalesce(len(list_filter(state, lambda x: lower(x) = 'aurbren')), 0) > 0"),
    "no_field": ("customer", "_NOFIELD_ == 'x' || C_ACCTBAL < -900", "c_acctbal < -900"),
    "arithmetic": ("lineitem", "L_QUANTITY * L_EXTENDEDPRICE > 4000000 && 12 / 2 / 3 == 2", "l_quantity * l_extendedprice > 4000000"),
    "drop_marker": ("customer", "((_Drop_ = true) && (C_ACCTBAL > 1)) && C_MKTSEGMENT == 'MACHINERY'", "lower(c_mktsegment) = 'machinery'"),
    "eval_marker": ("customer", "((_Eval_ = true) && (C_ACCTBAL > 9500))", "c_acctbal > 9500"),
    "lenient_field": ("customer", "f:lenient('C_ACCTBAL') && (C_ACCTBAL == 'lots' || C_ACCTBAL > 9800)", "c_acctbal > 9800"),
    "include_regex": ("customer", "filter:includeRegex(C_NAME, '.*0[0-3]7')", "regexp_full_match(c_name, '.*0[0-3]7', 'is')"),
    "exclude_regex": ("city_event", "filter:excludeRegex(COUNTRY, 'd.*|p.*')", "NOT coalesce(regexp_full_match(country, 'd.*|p.*', 'is'), false)"),
    "fn_is_null": ("city_event", "filter:isNull(CODE || GEO)", "code IS NULL AND geo IS NULL"),
    "fn_is_not_null": ("city_event", "filter:isNotNull(CODE || GEO)", "code IS NOT NULL OR geo IS NOT NULL"),
    "occurrence_eq": ("city_event", "filter:occurrence(CITY, 2)", "len(list_filter(city, lambda x: x IS NOT NULL)) = 2"),
    "occurrence_ge": ("city_event", "filter:occurrence(STATE, '>=', 2)", "len(list_filter(state, lambda x: x IS NOT NULL)) >= 2"),
    "at_least_count_of": ("city_event", "filter:matchesAtLeastCountOf(2, CITY, 'be.*', 'na.*', 'go.*')", "(CASE WHEN len(list_filter(city, lambda x: regexp_full_match(x, 'be.*', 'is'))) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(city, lambda x: regexp_full_match(x, 'na.*', 'is'))) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(city, lambda x: regexp_full_match(x, 'go.*', 'is'))) > 0 THEN 1 ELSE 0 END) >= 2"),
    "get_all_matches": ("city_event", "filter:getAllMatches(CITY, '.*a').size() > 1", "len(list_filter(city, lambda x: regexp_full_match(x, '.*a', 'is'))) > 1"),
    "after_date": ("orders", "filter:afterDate(O_ORDERDATE, '20000131')", "o_orderdate >= TIMESTAMP '2000-02-01'"),
    "before_date": ("orders", "filter:beforeDate(O_ORDERDATE, '1995-03-01')", "o_orderdate < TIMESTAMP '1995-03-01'"),
    "between_dates": ("orders", "filter:betweenDates(O_ORDERDATE, '19970101', '19970331')", "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'"),
    "between_dates_month": ("orders", "filter:betweenDates(O_ORDERDATE, '1997-Jan', '1997-Feb', 'yyyy-MMM')", "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-01'"),
    "after_load_date": ("city_event", "filter:afterLoadDate(LOAD_TS, '20150130')", "load_ts >= TIMESTAMP '2015-01-31'"),
    "before_load_date": ("city_event", "filter:beforeLoadDate(LOAD_TS, '20150110')", "load_ts < TIMESTAMP '2015-01-10'"),
    "between_load_dates": ("city_event", "filter:betweenLoadDates(LOAD_TS, '20150110', '20150112')", "load_ts >= TIMESTAMP '2015-01-10' AND load_ts < TIMESTAMP '2015-01-13'"),
    "time_function": ("city_event", "filter:timeFunction(LOAD_TS, START_DATE, '-', '>', 864000000)", "epoch_ms(load_ts) - epoch_ms(try_strptime(start_date, '%Y%m%d')) > 864000000"),
    "compare_any": ("city_event", "filter:compare(CITY, '<', 'ANY', STATE)", "list_min(list_transform(city, lambda x: lower(x))) < list_max(list_transform(state, lambda x: lower(x)))"),
    "compare_all": ("city_event", "filter:compare(CITY, '<', 'ALL', STATE)", "list_max(list_transform(city, lambda x: lower(x))) < list_min(list_transform(state, lambda x: lower(x)))"),
    "length_between": ("city_event", "f:length(COUNTRY, 11, 20)", "length(country) BETWEEN 11 AND 20"),
    "between_string": ("customer", "f:between(C_MKTSEGMENT, 'building', 'household')", "lower(c_mktsegment) BETWEEN 'building' AND 'household'"),
    "between_number": ("customer", "f:between(C_ACCTBAL, 1000.0, 2000.0)", "c_acctbal::FLOAT BETWEEN 1000::FLOAT AND 2000::FLOAT"),
    "between_exclusive": ("lineitem", "f:between(L_QUANTITY, 1, false, 3, false)", "l_quantity > 1 AND l_quantity < 3"),
    "match_regex": ("part", "f:matchRegex(P_NAME, '(red|blue) .*')", "regexp_full_match(p_name, '(red|blue) .*', 'is')"),
    "include_text": ("city_event", "f:includeText(COUNTRY, 'DRALDOZIMIA') || f:includeText(CITY, 'Nadel')", "country = 'DRALDOZIMIA' OR coalesce(list_contains(city, 'Nadel'), false)"),
    "between_long": ("city_event", "f:between(NUM, 400, 600)", "num BETWEEN 400 AND 600"),
    "strict_marker": ("customer", "((_Lenient_ = true) && (C_ACCTBAL == 'lots' || ((_Strict_ = true) && (C_ACCTBAL > 9800))))", "c_acctbal > 9800"),
    "value_marker": ("city_event", "((_Value_ = true) && (COUNTRY =~ 'ba.*'))", "regexp_full_match(country, 'ba.*', 'is')"),
    "delayed_marker": ("city_event", "NUM > 500 && ((_Delayed_ = true) && (COUNTRY =~ 'ba.*'))", "num > 500 AND regexp_full_match(country, 'ba.*', 'is')"),
    "no_expansion": ("city_event", "f:noExpansion('LOAD_DATE') && (LOAD_DATE == '20150110' || NUM > 990)", "num > 990"),
    "numeric_coercion": ("customer", "C_ACCTBAL > '9000'", "c_acctbal > 9000"),
    "extreme_times": ("city_event", "filter:getMaxTime(LOAD_TS) - filter:getMinTime(START_DATE) > 864000000", "epoch_ms(load_ts) - epoch_ms(try_strptime(start_date, '%Y%m%d')) > 864000000"),
    "get_time": ("city_event", "filter:getMinTime(LOAD_TS) > filter:getTime('20150120')", "load_ts > TIMESTAMP '2015-01-20'"),
    "get_next_time": ("city_event", "filter:getMaxTime(LOAD_TS) >= filter:getNextTime('20150120')", "load_ts >= TIMESTAMP '2015-01-21'"),
    "get_max_value": ("city_event", "filter:getMaxValue(LOAD_TS) >= filter:getTime('20150121')", "load_ts >= TIMESTAMP '2015-01-21'"),
    "get_min_value": ("city_event", "filter:getMinValue(LOAD_TS || START_DATE) < filter:getTime('20150105')", "least(epoch_ms(load_ts), coalesce(epoch_ms(try_strptime(start_date, '%Y%m%d')), epoch_ms(load_ts))) < epoch_ms(TIMESTAMP '2015-01-05')"),
    "set_size": ("city_event", "CITY.size() == 2", "len(list_filter(city, lambda x: x IS NOT NULL)) = 2"),
    "set_min": ("city_event", "CITY.min() < 'c'", "list_min(list_transform(city, lambda x: lower(x))) < 'c'"),
    "set_max": ("city_event", "CITY.max() > 'x'", "list_max(list_transform(city, lambda x: lower(x))) > 'x'"),
    "set_is_empty": ("city_event", "STATE.isEmpty() == true", "coalesce(len(list_filter(state, lambda x: x IS NOT NULL)), 0) = 0"),
    "set_contains": ("city_event", "CITY.contains('CITY', 'Nadel')", "coalesce(list_contains(city, 'Nadel'), false)"),
    "content_phrase": ("documents", "content:phrase(TEXT, termOffsetMap, 'the', 'reverse', 'index')", "contains(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' the reverse index ')"),
    "content_adjacent": ("documents", "content:adjacent(TEXT, termOffsetMap, 'index', 'reverse')", "regexp_matches(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' (index reverse|reverse index) ')"),
    "content_within": ("documents", "content:within(TEXT, 2, termOffsetMap, 'index', 'the')", "regexp_matches(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' (the ([^ ]+ )?index|index ([^ ]+ )?the) ')"),
    "geo_bbox": ("city_event", "geo:within_bounding_box(GEO, '0_-60', '45.5_60')", "g_lat BETWEEN 0 AND 45.5 AND g_lon BETWEEN -60 AND 60"),
    "geo_bbox_antimeridian": ("city_event", "geo:within_bounding_box(GEO, '-30_150', '30_-150')", "g_lat BETWEEN -30 AND 30 AND (g_lon >= 150 OR g_lon <= -150)"),
    "geo_circle": ("city_event", "geo:within_circle(GEO, '10_20', 25)", "(g_lat - 10) * (g_lat - 10) + (g_lon - 20) * (g_lon - 20) <= 625"),
    "geowave_within_box": ("city_event", "geowave:within(GEO, 'POLYGON((-60 0, 60 0, 60 45, -60 45, -60 0))')", "g_lat > 0 AND g_lat < 45 AND g_lon > -60 AND g_lon < 60"),
    "geowave_intersects": ("city_event", "geowave:intersects(GEO, 'POLYGON((0 0, 40 0, 0 40, 0 0))')", "g_lat >= 0 AND g_lon >= 0 AND g_lat + g_lon <= 40"),
    "visibility_like_auths": ("city_event", "ACCESS_LEVEL == 'public' || ACCESS_LEVEL == 'shared'", "lower(access_level) IN ('public', 'shared')"),
}

#: name: (table, Lucene query, SQL condition).
LUCENE: dict[str, tuple[str, str, str]] = {
    "lucene_fielded": ("customer", "C_MKTSEGMENT:machinery", "lower(c_mktsegment) = 'machinery'"),
    "lucene_unfielded": ("city_event", "nadel", "coalesce(lower(country) = 'nadel', false) OR coalesce(len(list_filter(city, lambda x: lower(x) = 'nadel')), 0) > 0 OR coalesce(len(list_filter(state, lambda x: lower(x) = 'nadel')), 0) > 0"),
    "lucene_wildcard": ("part", "P_TYPE:ec*no?y", "regexp_full_match(p_type, 'ec.*no.y', 'is')"),
    "lucene_regex": ("part", "P_NAME:/(small|red) r.*/", "regexp_full_match(p_name, '(small|red) r.*', 'is')"),
    "lucene_range": ("lineitem", "L_QUANTITY:[10 TO 12}", "l_quantity >= 10 AND l_quantity < 12"),
    "lucene_open_range": ("customer", "C_ACCTBAL:[9500 TO *]", "c_acctbal >= 9500"),
    "lucene_phrase": ("documents", "TEXT:\"the reverse index\"", "contains(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' the reverse index ')"),
    "lucene_slop": ("documents", "TEXT:\"index the\"~2", "regexp_matches(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' (the ([^ ]+ )?index|index ([^ ]+ )?the) ')"),
    "lucene_not": ("orders", "O_ORDERSTATUS:O NOT O_ORDERPRIORITY:1-URGENT", "lower(o_orderstatus) = 'o' AND NOT coalesce(lower(o_orderpriority) = '1-urgent', false)"),
    "lucene_or_and": ("orders", "O_ORDERSTATUS:P OR O_ORDERPRIORITY:1-URGENT AND O_TOTALPRICE:[300000 TO *]", "lower(o_orderstatus) = 'p' OR (lower(o_orderpriority) = '1-urgent' AND o_totalprice >= 300000)"),
    "lucene_functions": ("city_event", "#INCLUDE(OR, COUNTRY, baz.*, CONTINENT, aurt.*) AND #OCCURRENCE(CITY, >, 0)", "(coalesce(regexp_full_match(country, 'baz.*', 'is'), false) OR coalesce(regexp_full_match(continent, 'aurt.*', 'is'), false)) AND len(list_filter(city, lambda x: x IS NOT NULL)) > 0"),
    "lucene_exclude": ("city_event", "CONTINENT:aurrira #EXCLUDE(AND, COUNTRY, d.*, ACCESS_LEVEL, p.*)", "lower(continent) = 'aurrira' AND (NOT coalesce(regexp_full_match(country, 'd.*', 'is'), false) OR NOT coalesce(regexp_full_match(access_level, 'p.*', 'is'), false))"),
    "lucene_date": ("orders", "#DATE(O_ORDERDATE, between, 19970101, 19970331)", "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'"),
    "lucene_text": ("city_event", "#TEXT(CITY, Nadel)", "coalesce(list_contains(city, 'Nadel'), false)"),
    "lucene_evaluation_only": ("lineitem", "#EVALUATION_ONLY('L_QUANTITY: [1 TO 2}')", "l_quantity >= 1 AND l_quantity < 2"),
    "lucene_compare": ("city_event", "#COMPARE(CITY, <, ANY, STATE)", "list_min(list_transform(city, lambda x: lower(x))) < list_max(list_transform(state, lambda x: lower(x)))"),
    "lucene_matches": ("part", "#MATCHES(P_NAME, (red|blue) .*)", "regexp_full_match(p_name, '(red|blue) .*', 'is')"),
    "lucene_is_null": ("city_event", "#ISNULL(CODE)", "code IS NULL"),
    "lucene_is_not_null": ("city_event", "#ISNOTNULL(CODE)", "code IS NOT NULL"),
    "lucene_loaded": ("city_event", "#LOADED(20150110, 20150112)", "load_ts >= TIMESTAMP '2015-01-10' AND load_ts < TIMESTAMP '2015-01-13'"),
    "lucene_loaded_after": ("city_event", "#LOADED(after, 20150130)", "load_ts >= TIMESTAMP '2015-01-31'"),
    "lucene_time_function": ("city_event", "#TIME_FUNCTION(LOAD_TS, START_DATE, '-', '>', 864000000L)", "epoch_ms(load_ts) - epoch_ms(try_strptime(start_date, '%Y%m%d')) > 864000000"),
    "lucene_get_all_matches": ("city_event", "#GET_ALL_MATCHES(CITY, be.*)", "len(list_filter(city, lambda x: regexp_full_match(x, 'be.*', 'is'))) > 0"),
    "lucene_at_least": ("city_event", "#MATCHES_AT_LEAST_COUNT_OF(2, CITY, be.*, na.*)", "len(list_filter(city, lambda x: regexp_full_match(x, 'be.*', 'is'))) > 0 AND len(list_filter(city, lambda x: regexp_full_match(x, 'na.*', 'is'))) > 0"),
    "lucene_jexl": ("city_event", "COUNTRY:ba* #JEXL('NUM > 500')", "num > 500 AND regexp_full_match(country, 'ba.*', 'is')"),
    "lucene_lenient": ("customer", "#LENIENT(C_ACCTBAL) AND (C_ACCTBAL:lots OR C_ACCTBAL:[9800 TO *])", "c_acctbal >= 9800"),
    "lucene_no_expansion": ("city_event", "#NOEXPANSION(LOAD_DATE) AND (LOAD_DATE:20150110 OR NUM:[990 TO *])", "num >= 990"),
    "lucene_geowave": ("city_event", "#INTERSECTS(GEO, 'POLYGON((0 0, 40 0, 0 40, 0 0))')", "g_lat >= 0 AND g_lon >= 0 AND g_lat + g_lon <= 40"),
    "lucene_geowave_within": ("city_event", "#WITHIN(GEO, 'POLYGON((-60 0, 60 0, 60 45, -60 45, -60 0))')", "g_lat > 0 AND g_lat < 45 AND g_lon > -60 AND g_lon < 60"),
    "lucene_geo": ("city_event", "#GEO(circle, GEO, 10_20, 25)", "(g_lat - 10) * (g_lat - 10) + (g_lon - 20) * (g_lon - 20) <= 625"),
}

GEO_VIEW = "(SELECT *, try_cast(regexp_extract(geo, '^\\s*POINT\\s*\\(\\s*(-?[0-9.]+)\\s+(-?[0-9.]+)', 1, 'i') AS DOUBLE) AS g_lon, try_cast(regexp_extract(geo, '^\\s*POINT\\s*\\(\\s*(-?[0-9.]+)\\s+(-?[0-9.]+)', 2, 'i') AS DOUBLE) AS g_lat FROM city_event) AS d"


def _query(name: str, text: str, syntax: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return on(spark, sf, name).matching(text, syntax).select(*KEYS[name])

    return run


def _sql(name: str, condition: str) -> str:
    return f"SELECT {', '.join(KEYS[name])} FROM {GEO_VIEW if 'g_lat' in condition else name} WHERE {condition}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(t, q, "JEXL") for n, (t, q, _) in ROWS.items()} | {n: _query(t, q, "LUCENE") for n, (t, q, _) in LUCENE.items()}
ORACLES: dict[str, str] = {n: _sql(t, s) for n, (t, _, s) in (ROWS | LUCENE).items()}
