"""Pages without a query count, each distinct row once."""

from pyspark.sql import functions as F

from siltstone.llm import queries


def test_pages_without_query(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/query_metric.parquet").write.parquet(str(tmp_path / "query_metric.parquet"))
    pages = spark.read.parquet(f"{sf}/page_metric.parquet").limit(1).drop("query_id", "page_number", "return_time")
    kind = dict(spark.read.parquet(f"{sf}/page_metric.parquet").dtypes)
    rows = spark.createDataFrame([(None, 1, 10), (None, 1, 20), (None, 1, 20), (None, 2, 30), (None, 2, -1), ("none such", 1, 40)], "query_id string, page_number int, return_time int")
    rows = rows.select(*[F.col(c).cast(kind[c]) for c in rows.columns]).join(F.broadcast(pages), F.lit(True), "left")
    rows.write.parquet(str(tmp_path / "page_metric.parquet"))
    got = queries.timed_values(spark, str(tmp_path)).where("metric = 'return_time'").collect()
    assert sorted((r["value"], r["query_type"], r["day"]) for r in got) == [(v, None, None) for v in (10, 20, 30, 40)]
