"""Parsing, translation, options and dates."""

from datetime import datetime, timezone

import pytest

from siltstone.lang import dates, jexl, lucene
from siltstone.lang.ast import fields
from siltstone.lang.jexl import QueryError
from siltstone.plans.options import Options, extract, parse_unique


@pytest.mark.parametrize(
    "text,want",
    [
        ("CITY:n?del OR COUNTRY:pab* AND CODE:QX", "CITY =~ 'n.del' || (COUNTRY =~ 'pab.*?' && CODE == 'QX')"),
        ("CITY:nadel STATE:norland NOT ACCESS:private", "CITY == 'nadel' && STATE == 'norland' && !(ACCESS == 'private')"),
        ("IP:10.7.*", r"IP =~ '10\.7\..*?'"),
        ("#EXCLUDE(AND, CITY, be.*, STATE, no.*)", "!(filter:includeRegex(CITY, 'be.*')) || !(filter:includeRegex(STATE, 'no.*'))"),
        ("#INCLUDE(AND, CITY, be.*, STATE, no.*)", "filter:includeRegex(CITY, 'be.*') && filter:includeRegex(STATE, 'no.*')"),
        ("#INCLUDE(CITY, be.*)", "filter:includeRegex(CITY, 'be.*')"),
        ("#loaded(between, 20150110, 20150112, yyyyMMdd)", "filter:betweenLoadDates(LOAD_DATE, '20150110', '20150112', 'yyyyMMdd')"),
        ("#date(O_ORDERDATE, after, 19970131)", "filter:afterDate(O_ORDERDATE, '19970131')"),
        ("#EVALUATION_ONLY('L_QUANTITY: [1 TO 12}')", "((_Eval_ = true) && (((_Bounded_ = true) && (L_QUANTITY >= '1' && L_QUANTITY < '12'))))"),
        ("#OCCURRENCE(CITY, >=, 2)", "filter:occurrence(CITY, '>=', 2)"),
        ("#COMPARE(CITY, <, ANY, STATE)", "filter:compare(CITY, '<', 'ANY', STATE)"),
        ('BODY:"a b c"~5', "content:within(BODY, 5, termOffsetMap, 'a', 'b', 'c')"),
        ('"x y"', "content:phrase(termOffsetMap, 'x', 'y')"),
        ("F:/a.b/", "F =~ 'a.b'"),
        ("F:[1 TO *]", "F >= '1'"),
        ("F:*", "!(F == null)"),
        ("F:(a OR b) NOT c", "(F == 'a' || F == 'b') && !(_ANYFIELD_ == 'c')"),
        ("#JEXL(F == 'x' && G > 1)", "F == 'x' && G > 1"),
        (r"F:a\:b", "F == 'a:b'"),
        ("#UNIQUE_BY_DAY(F)", "f:unique_by_day('F')"),
    ],
)
def test_lucene(text, want):
    assert str(lucene.to_tree(text)) == want


def test_tokenized_fields_also_match_as_phrase():
    assert str(lucene.to_tree("BODY:a-b", {"BODY"})) == "BODY == 'a-b' || content:phrase(BODY, termOffsetMap, 'a', 'b')"


@pytest.mark.parametrize("text", ["term~2", "a^3", "(a", "a OR", "#NOPE(a)", "#OCCURRENCE(F)", "NOT", "", '"a'])
def test_lucene_rejects(text):
    with pytest.raises(QueryError):
        lucene.to_tree(text)


def test_allowed_fields():
    assert fields(lucene.to_tree("A:1", allowed={"A"})) == {"A"}
    with pytest.raises(QueryError):
        lucene.to_tree("A:1 B:2", allowed={"A"})


def test_uuid_query():
    assert str(lucene.uuid_query("id:1 OR id:2", {"ID": "EVENT_ID"})) == "EVENT_ID == '1' || EVENT_ID == '2'"
    with pytest.raises(QueryError):
        lucene.uuid_query("nope:1", {"ID": "EVENT_ID"})


@pytest.mark.parametrize(
    "text,want",
    [
        ("A == 'x' and not (B =~ 'y')", "A == 'x' && !(B =~ 'y')"),
        ("5 < C", "C > 5"),
        ("A != 'x' || A !~ 'y'", "!(A == 'x') || !(A =~ 'y')"),
        ("!!(A == 1)", "A == 1"),
        ("A =~ '.*?'", "!(A == null)"),
        ("((_Bounded_ = true) && (N >= 1 && N <= 5))", "((_Bounded_ = true) && (N >= 1 && N <= 5))"),
        ("filter:getAllMatches(F,'re').size() > 0", "filter:getAllMatches(F, 're').size() > 0"),
        ("1 + 2 * 3 == 7", "(1 + (2 * 3)) == 7"),
        ("A == -5 && b == 2.5", "A == -5 && B == 2.5"),
        (r"A == 'it\'s' && B =~ 'a\.b'", r"A == 'it\'s' && B =~ 'a\.b'"),
    ],
)
def test_jexl(text, want):
    node = jexl.parse(text)
    assert str(node) == want and str(jexl.parse(str(node))) == want


@pytest.mark.parametrize("text", ["A ==", "(A == 1", "A == 1)", "foo('x')", "A = 1", "N >= 1 && N <= 5", "((_Bounded_ = true) && (N >= 1 && M <= 5))", "((_Bounded_ = true) && (N >= 1))", "A == 'x", "(" * 300 + "A == 1" + ")" * 300, "A.1 == 2"])
def test_jexl_rejects(text):
    with pytest.raises(QueryError):
        jexl.parse(text)


def test_macros():
    assert jexl.expand_macros("X(1, 2) && A == 3", {"X": "B == $0 || B == $1"}) == "(B == 1 || B == 2) && A == 3"


def test_options_are_taken_out():
    o = Options()
    node = extract(jexl.parse("A == 1 && f:groupby('B', C) && (f:unique_by_day('T') || f:sum('N')) && f:options('limit.fields', 'X=3', 'hit.list', 'true') && f:rename('A=Z')"), o)
    assert str(node) == "A == 1"
    assert o.group == ["B", "C"] and o.unique == {"T": ["DAY"]} and o.aggregates == {"sum": ["N"]} and o.limit_fields == {"X": 3} and o.hit_list and o.rename == {"A": ["Z"]}
    assert extract(jexl.parse("f:unique('A')"), Options()) is None
    assert parse_unique("A[DAY,HOUR],B") == {"A": ["DAY", "HOUR"], "B": ["ALL"]}
    with pytest.raises(QueryError):
        parse_unique("A[WEEK]")
    with pytest.raises(QueryError):
        Options().set("limit.fields", "X")


@pytest.mark.parametrize(
    "text,unit,want",
    [
        ("20240131", "day", datetime(2024, 1, 31)), ("2024013107", "hour", datetime(2024, 1, 31, 7)), ("20240131 070809", "second", datetime(2024, 1, 31, 7, 8, 9)), ("2024-Feb", "month", datetime(2024, 2, 1)),
        ("2024-02-01 10:11:12.345", "milli", datetime(2024, 2, 1, 10, 11, 12, 345000)), ("2024-02-01T10:11:12Z", "second", datetime(2024, 2, 1, 10, 11, 12)), ("2024-02-01T10|11", "minute", datetime(2024, 2, 1, 10, 11)),
        ("02/03/2024", "day", datetime(2024, 2, 3)), ("2024-02-01 10:11:12 +0200", "second", datetime(2024, 2, 1, 8, 11, 12)),
    ],
)
def test_dates(text, unit, want):
    assert dates.parse_date(text) == (want.replace(tzinfo=timezone.utc), unit)


def test_date_edges():
    assert dates.following(datetime(2024, 1, 31, tzinfo=timezone.utc), "month").day == 29
    assert dates.millis(dates.parse_date("86400000", "e")[0]) == 86_400_000
    for bad in ("", "nope", "20241340"):
        with pytest.raises(QueryError):
            dates.parse_date(bad)
