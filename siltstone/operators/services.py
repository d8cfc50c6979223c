"""Reports on queries and collections: metrics, feeds, hierarchies as a whole, cardinalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics_summary(metrics: DataFrame, by: list[str], value: str, digits: int = 2) -> DataFrame:
    """Number and total of a value per group."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(value), digits).alias("total"))


def dashboard(metrics: DataFrame, by: list[str], since_ms: int, created: str, error: str, setup: str, results: str, fast_ms: int = 1000) -> DataFrame:
    """Queries since a time per group: number, errors, those set up fast, results."""
    fast = (F.col(setup) >= 0) & (F.col(setup) < fast_ms)
    m = metrics.where(F.col(created) >= since_ms)
    return m.groupBy(*by).agg(F.count("*").alias("n"), F.count(error).alias("errors"), F.count_if(fast).alias("fast"), F.sum(results).alias("results"))


def metrics_of(metrics: DataFrame, user: str, name: str, condition: Column) -> DataFrame:
    """A user's own metrics; users are compared trimmed and in any case."""
    return metrics.where((F.lower(F.trim(user)) == name.strip().lower()) & condition)


def feed(docs: DataFrame, category: str, newest: list[str], most: int) -> DataFrame:
    """The newest documents of every category. The rank's limit is applied before rows are shuffled, too."""
    rank = F.row_number().over(Window.partitionBy(category).orderBy(*[F.desc(c) for c in newest]))
    return docs.where(F.col(category).isNotNull()).withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def top_level(children: DataFrame, root: str, hit: Column) -> DataFrame:
    """root, children, hits of the top-level documents of which any child satisfies a condition."""
    return children.groupBy(F.col(root).alias("root")).agg(F.count("*").alias("children"), F.count_if(hit).alias("hits")).where("hits > 0")


def cardinality_report(docs: DataFrame, by: list[str], fields: list[str], error: float = 0.01) -> DataFrame:
    """Estimated distinct values of each field of a result, per group."""
    return docs.groupBy(*by).agg(*[F.approx_count_distinct(c, error).alias(c) for c in fields])
