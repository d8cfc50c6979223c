"""Similarity of fuzzy hashes ``chunk size:chunks:chunks of twice the size``.

Candidates share an n-gram of a comparable part, which is an equi join on (size, n-gram); pairs are then
scored by edit distance. Looked up is a list of hashes given with a query against all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NGRAM = 7


def collapse(chunks: Column) -> Column:
    """Runs of more than three equal characters as three: they say nothing."""
    return F.regexp_replace(chunks, r"(.)\1{3,}", "$1$1$1")


def parts(hash_: Column) -> Column:
    """[(size, chunks), (2 size, double chunks)]."""
    p = F.split(hash_, ":", 3)
    size = F.get(p, F.lit(0)).try_cast("bigint")
    return F.array(F.struct(size.alias("size"), collapse(F.get(p, F.lit(1))).alias("chunks")), F.struct((size * 2).alias("size"), collapse(F.get(p, F.lit(2))).alias("chunks")))


def ngrams(chunks: Column, n: int = NGRAM) -> Column:
    """Distinct n-grams; none of a shorter text."""
    return F.when(F.length(chunks) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(chunks) - n + 1, F.lit(1))), lambda i: F.substring(chunks, i, n)))).otherwise(F.array().cast("array<string>"))


def edit_score(a: Column, b: Column, size: Column) -> Column:
    """0 to 100: 100 less the edit distance as a share of both lengths; small chunks can't score high."""
    long = F.length(a) + F.length(b)
    scaled = F.floor(F.levenshtein(a, b) * 64 / long)
    score = 100 - F.floor(scaled * 100 / 64)
    cap = F.floor(size / 3) * F.least(F.length(a), F.length(b))
    return F.when(long == 0, 0).otherwise(F.greatest(F.lit(0), F.least(score, cap))).cast("int")


def overlap_score(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(ngrams(a), ngrams(b)))


def candidates(queries: DataFrame, rows: DataFrame, query_hash: str, row_hash: str) -> DataFrame:
    """query, row, size, a, b: comparable parts of the two hashes that share an n-gram. Each pair of parts once."""
    q = queries.select(F.col(query_hash).alias("query"), F.explode(parts(F.col(query_hash))).alias("p")).distinct()
    r = rows.select(F.col(row_hash).alias("row"), F.explode(parts(F.col(row_hash))).alias("p")).distinct()
    q = q.select("query", F.col("p.size").alias("size"), F.col("p.chunks").alias("a"), F.explode(ngrams(F.col("p.chunks"))).alias("gram"))
    r = r.select("row", F.col("p.size").alias("size"), F.col("p.chunks").alias("b"), F.explode(ngrams(F.col("p.chunks"))).alias("gram"))
    return q.join(r, ["size", "gram"]).select("query", "row", "size", "a", "b").distinct()


def similar(queries: DataFrame, rows: DataFrame, query_hash: str, row_hash: str, least: int = 50) -> DataFrame:
    """query, row, score of hashes that score at least ``least``."""
    scored = candidates(queries, rows, query_hash, row_hash).withColumn("score", edit_score(F.col("a"), F.col("b"), F.col("size")))
    return scored.groupBy("query", "row").agg(F.max("score").alias("score")).where(F.col("score") >= least)


def similar_rows(queries: DataFrame, rows: DataFrame, query_hash: str, row_hash: str, least: int = 50) -> DataFrame:
    """All columns of the rows whose hash is similar to one looked up, with that hash and the score."""
    found = similar(queries, rows, query_hash, row_hash, least)
    return rows.join(found.withColumnRenamed("row", row_hash), row_hash)
