"""Queries that feed on others' results: chained, hierarchical, looked up, composed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stage


def chained(first: DataFrame, second: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``second`` that the result of ``first`` asks for; ``on`` maps columns of first to those of second."""
    keys = first.select(*[F.col(a).alias(b) for a, b in on.items()]).distinct()
    return second.join(keys, list(on.values()), "left_semi")


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows by a list of identifiers given with the query."""
    return df.where(F.col(key).isin(values))


def parents(hits: DataFrame, docs: DataFrame, uid: str, parent: str) -> DataFrame:
    """The parents of the hits, each once."""
    return docs.join(hits.select(F.col(parent).alias(uid)).where(F.col(uid).isNotNull()).distinct(), uid, "left_semi")


def with_ancestors(hits: DataFrame, docs: DataFrame, uid: str, parent: str, depth: int) -> DataFrame:
    """uid of each hit and ancestor of it (itself included), up to ``depth`` generations."""
    level = hits.select(F.col(uid).alias("hit"), F.col(uid).alias("ancestor"), F.col(parent).alias("_up"))
    out = level
    up = docs.select(F.col(uid).alias("_u"), F.col(parent).alias("_p"))
    for _ in range(depth):
        level = level.where("_up is not null").join(up, F.col("_up") == F.col("_u")).select("hit", F.col("_u").alias("ancestor"), F.col("_p").alias("_up"))
        out = out.unionByName(level)
    return out.select("hit", "ancestor")


def child_counts(docs: DataFrame, uid: str, parent: str) -> DataFrame:
    """uid and its number of children, 0 for none."""
    n = docs.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(uid)).agg(F.count("*").alias("children"))
    return docs.select(uid).join(n, uid, "left").select(uid, F.coalesce("children", F.lit(0)).alias("children"))


def descendant_counts(docs: DataFrame, uid: str, parent: str, depth: int = 10) -> DataFrame:
    """uid, children, descendants of every document, up to ``depth`` generations below it.

    Counts move up a generation at a time: what is joined and shuffled is one row per document and generation, never
    a pair of documents. It ends with the deepest generation that there is.
    """
    links = stage(docs.select(F.col(uid).alias("_u"), F.col(parent).alias("_p")).distinct(), "links")
    level = links.where("_p is not null").groupBy(F.col("_p").alias("_u")).agg(F.count("*").alias("n"))
    out = level.select("_u", F.col("n").alias("children"), F.col("n").alias("descendants"))
    for _ in range(depth - 1):
        level = stage(level.join(links.where("_p is not null"), "_u").groupBy(F.col("_p").alias("_u")).agg(F.sum("n").alias("n")), "generation")
        if level.isEmpty():
            break
        out = out.unionByName(level.select("_u", F.lit(0).cast("long").alias("children"), F.col("n").alias("descendants")))
    sums = out.groupBy("_u").agg(F.sum("children").alias("children"), F.sum("descendants").alias("descendants"))
    return links.join(sums, "_u", "left").select(F.col("_u").alias(uid), F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("descendants", F.lit(0)).alias("descendants")).distinct()


def with_children(hits: DataFrame, docs: DataFrame, uid: str, parent: str, depth: int = 10) -> DataFrame:
    """The hits and all documents below them, each once: retrieval of whole hierarchies."""
    found = hits.select(F.col(uid).alias("_u")).distinct()
    level = found
    for _ in range(depth):
        level = stage(docs.select(F.col(uid).alias("_c"), F.col(parent).alias("_u")).join(level, "_u", "left_semi").select(F.col("_c").alias("_u")).distinct(), "generation")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return docs.join(found.distinct(), F.col(uid) == F.col("_u"), "left_semi")


def composite(parts: list[DataFrame], dedupe: list[str] | None = None) -> DataFrame:
    """All results together, columns matched by name; ``dedupe`` columns identify a document found twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(dedupe) if dedupe else out


def first_nonempty(parts: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first result that has rows; later ones aren't run."""
    out = parts[0]()
    for p in parts[1:]:
        if not out.isEmpty():
            return out
        out = p()
    return out


def filtered(df: Callable[[], DataFrame], empty: DataFrame, allowed: bool) -> DataFrame:
    """A logic that runs only under a condition on the caller."""
    return df() if allowed else empty


def by_date_index(docs: DataFrame, uid: str, index: DataFrame, kind: str, start: str, end: str) -> DataFrame:
    """Documents whose date of another kind lies in a range; ``index`` has kind, date and the document's uid."""
    keys = index.where((F.col("kind") == kind) & F.col("date").between(start, end)).select(F.col("uid").alias(uid)).distinct()
    return docs.join(keys, uid, "left_semi")
