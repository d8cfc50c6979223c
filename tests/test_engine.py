"""Semantics of queries on a few people documents made for it."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions.content import excerpt
from siltstone.lang.jexl import QueryError
from siltstone.operators import aggregate, shaping
from siltstone.plans.catalog import Catalog
from siltstone.plans.compiler import REGISTRY, function
from siltstone.plans.engine import EventQuery
from siltstone.plans.options import Options

MULTI = "array<struct<value:string,ctx:string>>"
SCHEMA = f"id string, name {MULTI}, gender {MULTI}, age array<struct<value:int,ctx:string>>, magic int, born timestamp, died timestamp, quote string, ip string, geo string, kind string, day string"


def several(*values):
    return [(v, str(i)) for i, v in enumerate(values)]


DOCS = [
    ("CORLEONE", several("SANTINO", "FREDO", "MICHAEL", "CONSTANZIA", "LUCA", "VINCENT"), several("MALE", "MALE", "MALE", "FEMALE", "MALE", "MALE"), several(24, 22, 20, 18, 40, 22), 18, "1910-12-28 00:00:05", "1980-12-27 00:00:00", "Im gonna make him an offer he cant refuse", "10.1.2.3", "POINT(10 10)", "x", "20240101"),
    ("SOPRANO", several("ANTHONY", "MEADOW"), several("MALE", "FEMALE"), several(16, 18), 18, "1930-01-01 00:00:00", "1980-01-01 00:00:00", "If you can quote the rules then you can obey them", None, "POINT(20 20)", "x", "20240101"),
    ("CAPONE", several("ALPHONSE", "FRANK", "RALPH", "MICHAEL"), several("MALE", "MALE", "MALE", "MALE"), several(30, 34, 20, 40), 20, "1899-01-01 00:00:00", "1988-01-01 00:00:00", "You can get much farther with a kind word and a gun", "10.20.30.40", "POINT(30 30)", "x", "20240102"),
    ("TATTAGLIA", several("BRUNO"), several("MALE"), several(70), None, None, None, None, None, None, "y", "20240103"),
    ("EMPTY", [], None, None, None, None, None, "", None, "nonsense", None, None),
]


@pytest.fixture(scope="module")
def q(spark):
    rows = [tuple(r) for r in DOCS]
    text = SCHEMA.replace("born timestamp, died timestamp", "born string, died string")
    df = spark.createDataFrame(rows, text).withColumns({c: F.col(c).cast("timestamp") for c in ("born", "died")})
    return EventQuery(df, Catalog.of(df, {"IP": "ip"}, {"NAM": ["NAME"]}, {"QUOTE"}), ["id"], "day", "kind")


def found(q, text, **kw):
    return {r["id"] for r in q.matching(text, **kw).collect()}


EVERY = {d[0] for d in DOCS}


@pytest.mark.parametrize(
    "text,want",
    [
        ("NAME == 'michael'", {"CORLEONE", "CAPONE"}),
        ("NAME != 'MICHAEL'", EVERY - {"CORLEONE", "CAPONE"}),
        ("!(NAME =~ 'M.*')", {"TATTAGLIA", "EMPTY"}),
        ("ID =~ '[CS].*' && filter:matchesAtLeastCountOf(3, NAM, 'MICHAEL', 'VINCENT', 'FREDO', 'TONY')", {"CORLEONE"}),
        ("ID =~ '[CS].*' && filter:getMaxTime(DIED) - filter:getMinTime(BORN) > 2522880000000L", {"CAPONE"}),
        ("ID =~ '[CS].*' && filter:getMaxTime(DIED) - filter:getMinTime(BORN) > 1892160000000L", {"CORLEONE", "CAPONE"}),
        ("filter:timeFunction(DIED, BORN, '-', '>', 2522880000000L)", {"CAPONE"}),
        ("ID == 'CORLEONE' && 12 / 2 / 3 == 2", {"CORLEONE"}),
        ("filter:isNull(ID || NULL1)", set()),
        ("filter:isNull(NULL1 || NULL2)", EVERY),
        ("filter:isNull(IP)", {"SOPRANO", "TATTAGLIA", "EMPTY"}),
        ("ID =~ '[CS].*' && filter:getAllMatches(NAM, 'MICHAEL').size() > 0", {"CORLEONE", "CAPONE"}),
        ("UNKNOWN == 'x'", set()),
        ("UNKNOWN != 'x'", EVERY),
        ("AGE > 60 || AGE < 17", {"TATTAGLIA", "SOPRANO"}),
        ("AGE > 30 && MAGIC > 0 && AGE < 19", {"CORLEONE"}),
        ("((_Bounded_ = true) && (AGE > 24 && AGE < 35))", {"CAPONE"}),
        ("AGE == MAGIC", {"CORLEONE", "SOPRANO", "CAPONE"}),
        ("AGE < MAGIC", {"SOPRANO"}),
        ("IP == '10.1.2.3'", {"CORLEONE"}),
        ("IP =~ '10\\.2.*'", {"CAPONE"}),
        ("_ANYFIELD_ == 'bruno'", {"TATTAGLIA"}),
        ("_ANYFIELD_ == 40", {"CORLEONE", "CAPONE"}),
        ("((_Lenient_ = true) && (AGE == 'old')) || MAGIC == 20", {"CAPONE"}),
        ("((_Drop_ = true) && (MAGIC == 20)) && MAGIC == 18", {"CORLEONE", "SOPRANO"}),
        ("QUOTE == null", {"TATTAGLIA"}),
        ("content:phrase(QUOTE, termOffsetMap, 'kind', 'word')", {"CAPONE"}),
        ("content:phrase(termOffsetMap, 'an', 'offer', 'he')", {"CORLEONE"}),
        ("content:phrase(QUOTE, termOffsetMap, 'word', 'kind')", set()),
        ("content:adjacent(QUOTE, termOffsetMap, 'word', 'kind')", {"CAPONE"}),
        ("content:within(QUOTE, 3, termOffsetMap, 'kind', 'gun')", set()),
        ("content:within(QUOTE, 4, termOffsetMap, 'gun', 'kind')", {"CAPONE"}),
        ("content:within(QUOTE, 9, termOffsetMap, 'can', 'rules', 'obey')", {"SOPRANO"}),
        ("content:within(QUOTE, 3, termOffsetMap, 'can', 'rules', 'obey')", set()),
        ("content:within(QUOTE, 4, termOffsetMap, 'can', 'rules', 'obey')", {"SOPRANO"}),
        ("grouping:matchesInGroup(NAME, 'MEADOW', GENDER, 'FEMALE')", {"SOPRANO"}),
        ("grouping:matchesInGroup(NAME, 'ANTHONY', GENDER, 'FEMALE')", set()),
        ("grouping:matchesInGroup(NAME, 'M.*', GENDER, 'FEMALE', AGE, '18')", {"SOPRANO"}),
        ("NAME.getValuesForGroups(grouping:getGroupsForMatchesInGroup(GENDER, 'FEMALE', AGE, '18')).contains('NAME', 'CONSTANZIA') == true", {"CORLEONE"}),
        ("filter:occurrence(NAME, '>', 3)", {"CORLEONE", "CAPONE"}),
        ("filter:compare(AGE, '==', 'ANY', MAGIC)", {"CORLEONE", "SOPRANO", "CAPONE", "EMPTY"}),
        ("filter:compare(AGE, '>', 'ALL', MAGIC)", set()),
        ("filter:compare(AGE, '>=', 'ALL', MAGIC)", {"CORLEONE", "CAPONE"}),
        ("filter:compare(AGE, '!=', 'ALL', MAGIC)", {"TATTAGLIA"}),
        ("f:includeText(NAME, 'BRUNO') || f:includeText(NAME, 'frank')", {"TATTAGLIA"}),
        ("f:length(ID, 6, 7)", {"CAPONE", "SOPRANO"}),
        ("geo:within_bounding_box(GEO, '5_5', '15_15')", {"CORLEONE"}),
        ("geo:within_circle(GEO, '20_20', 14.2)", {"SOPRANO"} | {"CORLEONE", "CAPONE"}),
        ("geowave:within(GEO, 'POLYGON((0 0, 25 0, 25 25, 0 25, 0 0))')", {"CORLEONE", "SOPRANO"}),
        ("NAME.isEmpty() == true", {"EMPTY"}),
        ("normalize:ipv4(IP).size() == 1", {"CORLEONE", "CAPONE"}),
    ],
)
def test_conditions(q, text, want):
    assert found(q, text) == want


@pytest.mark.parametrize("text", ["ID:C*", "#INCLUDE(ID, C.*)", "ID:/c.*/"])
def test_lucene(q, text):
    assert found(q, text, syntax="LUCENE") == {"CAPONE", "CORLEONE"}


@pytest.mark.parametrize("text", ["AGE == 'old'", "AGE > 30 && AGE < 19", "nope:x(ID)", "filter:compare(AGE, '~', 'ANY', MAGIC)", "f:length(ID, 5, 3)", "content:within(QUOTE, -1, termOffsetMap, 'a', 'b')", "geowave:within(GEO, 'CIRCLE(1)')", "ID.nope() > 1", "'x'"])
def test_wrong_queries(q, text):
    with pytest.raises((QueryError, ValueError)):
        q.matching(text).collect()


def test_groups(q):
    rows = lambda text: {tuple(r) for r in q.run(text).collect()}
    assert rows("GENDER == 'male' && f:groupby('GENDER')") == {("MALE", 11), ("FEMALE", 2)}
    assert rows("ID =~ '[CS].*' && f:groupby('GENDER') && f:sum('AGE') && f:max('AGE') && f:min('AGE') && f:count('AGE') && f:average('AGE')") == {("MALE", 10, 268.0, 40, 16, 10, 26.8), ("FEMALE", 2, 36.0, 18, 18, 2, 18.0)}
    assert {r for r in rows("ID =~ '[CS].*' && f:groupby('AGE', 'GENDER')")} == {("18", "FEMALE", 2), ("30", "MALE", 1), ("34", "MALE", 1), ("16", "MALE", 1), ("40", "MALE", 2), ("20", "MALE", 2), ("24", "MALE", 1), ("22", "MALE", 2)}
    assert rows("f:groupby('MAGIC')") == {("18", 2), ("20", 1), (None, 2)} or rows("f:groupby('MAGIC')") == {(18, 2), (20, 1), (None, 2)}


def test_unique_keeps_the_first(q):
    assert {r["id"] for r in q.run("ID =~ '[CST].*' && f:unique('MAGIC')").collect()} == {"CORLEONE", "CAPONE", "TATTAGLIA"}
    assert {r["id"] for r in q.run("f:unique_by_year('DIED')").collect()} == {"CORLEONE", "CAPONE", "EMPTY"}


def test_shaping(q):
    o = Options(limit_fields={"NAME": 1}, hit_list=True)
    row = q.run("NAME == 'MICHAEL' && ID == 'CORLEONE'", options=o).first()
    assert [v["value"] for v in row["name"]] == ["MICHAEL"] and row["NAME_ORIGINAL_COUNT"] == 6 and row["HIT_TERM"] == ["ID:CORLEONE", "NAME:MICHAEL"]
    none = q.run("ID == 'CORLEONE'", options=Options(limit_fields={"NAME": 0})).first()
    assert none["name"] == []
    assert q.run("ID == 'CORLEONE'", options=Options(include=["QUOTE"], rename={"QUOTE": ["SAID"]})).columns == ["id", "SAID"]
    assert q.run("ID =~ '.*'", options=Options(max_results=2)).count() == 2
    hit = q.run("content:phrase(QUOTE, termOffsetMap, 'kind', 'word')", options=Options(excerpts={"QUOTE": (2, "both")})).first()
    assert hit["HIT_EXCERPT"] == "with a kind word and a"


def test_scan_rules(q):
    import dataclasses

    careful = dataclasses.replace(q, full_scan=False)
    for text in ("!(ID == 'x')", "f:unique('ID')", "((_Eval_ = true) && (ID == 'x'))", "ID == null"):
        with pytest.raises(QueryError):
            careful.matching(text)
    assert found(careful, "ID == 'CAPONE'") == {"CAPONE"}
    assert found(q, "MAGIC > 0", dates=("20240102", "20240103")) == {"CAPONE"}
    assert found(q, "ID =~ '.*'", options=Options(datatypes=["!x"])) == {"TATTAGLIA", "EMPTY"}
    assert found(q, "ID =~ '.*'", options=Options(datatypes=["y"], shards_and_days=["20240103"])) == {"TATTAGLIA"}


def test_filters_reach_the_scan(spark, sf):
    from siltstone.plans.query_predicates import on

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = on(spark, sf, "lineitem").matching("L_QUANTITY > 45 && L_DISCOUNT <= 0.02").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45" in plan and "LessThanOrEqual(l_discount,0.02)" in plan
    assert "Python" not in plan


def test_own_function(q):
    @function("own", "firstLetter")
    def first_letter(c, args):
        return c.values(args[0]).any(lambda f, x: f.raw(x).startswith(c.text(args[1])))

    try:
        assert found(q, "own:firstLetter(ID, 'T')") == {"TATTAGLIA"}
    finally:
        del REGISTRY["own", "firstletter"]


@pytest.mark.parametrize(
    "expression,auths,want",
    [("a", "a", True), ("a&b", "a", False), ("a&b", "ab", True), ("a|b", "b", True), ("(a|b)&c", "bc", True), ("(a|b)&c", "b", False), ("", "", True), (None, "", True), ("a&(b|(c&d))", "acd", True), ("a&", "a", False), ("(a", "a", False), ('"x y"&a', "a", False), ("a b", "ab", False)],
)
def test_visibility(expression, auths, want):
    assert shaping.satisfied(expression, frozenset(auths)) is want


def test_visibility_column(spark):
    df = spark.createDataFrame([(e,) for e in (None, "", "a", "b", "a&b", "a|b", "(a")], "v string")
    assert [r["v"] for r in df.where(shaping.visible(F.col("v"), {"a"})).collect()] == [None, "", "a", "a|b"]


def test_tenth_of_hour(spark):
    df = spark.sql("SELECT CAST(t AS timestamp) AS t FROM VALUES ('2024-01-01 10:09:59'), ('2024-01-01 10:10:00'), ('2024-01-01 10:00:00') AS x(t)")
    f = Catalog.of(df).fields["T"]
    assert sorted(r[0] for r in df.select(aggregate.at_granularity(f, F.col("t"), "TENTH_OF_HOUR")).collect()) == ["2024-01-01 10:0", "2024-01-01 10:0", "2024-01-01 10:1"]


def test_excerpt_sides(spark):
    df = spark.createDataFrame([("One two, THREE four five six",), (None,), ("nothing",)], "t string")
    get = lambda n, side: [r[0] for r in df.select(excerpt(F.col("t"), ["three", "four"], n, side)).collect()]
    assert get(1, "both") == ["two three four five", None, None]
    assert get(9, "before") == ["one two three four", None, None] and get(1, "after")[0] == "three four five"


def test_further_options(q):
    import dataclasses

    assert q.run("ID == 'SOPRANO'", options=Options(other={"include.grouping.context": "false"})).first()["name"] == ["ANTHONY", "MEADOW"]
    with pytest.raises(QueryError):
        q.matching("NOPE == 1", options=Options(other={"ignore.nonexistent.fields": "false"}))
    other = dataclasses.replace(q, models={"m": {"WHO": ["NAME"]}}, rules=[lambda n: n], most_days=2)
    assert found(other, "WHO == 'bruno'", options=Options(other={"model.name": "m"})) == {"TATTAGLIA"}
    for kw in (dict(options=Options(other={"model.name": "x"})), dict(options=Options(other={"date.type": "x"})), dict(dates=("20240101", "20240105"))):
        with pytest.raises(QueryError):
            other.matching("ID == 'CAPONE'", **kw)
    assert found(other, "ID == 'CAPONE'", dates=("20240101", "20240102")) == {"CAPONE"}
    assert "Scan" in q.explain("ID == 'CAPONE'") and q.plan("ID:c*", "LUCENE") == "ID =~ 'c.*?'"
