"""Boolean queries answered from the term index alone: which documents hold the terms.

Every leaf of the query is a bit. One scan marks each posting with the bits of the leaves it satisfies, one
aggregation per document takes their or, which combines map-side, and the condition is then decided on the
bits. However many conjunctions and negations a query has, there is one shuffle and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.lang.ast import And, Marker, Node, Not, Or
from siltstone.lang.jexl import QueryError, is_range
from siltstone.operators.discovery import term_condition
from siltstone.plans.catalog import Catalog
from siltstone.plans.compiler import Values

#: Leaves whose bits share one mask.
BITS = 62


def _leaves(node: Node) -> list[Node]:
    if isinstance(node, (And, Or)) and not is_range(node):
        return [x for p in node.parts for x in _leaves(p)]
    if isinstance(node, Not):
        return _leaves(node.part)
    return [node.part if isinstance(node, Marker) else node]


def _decide(node: Node, bit: dict[Node, int], mask: list[Column] | int) -> Column | bool:
    if isinstance(node, And) and not is_range(node):
        parts = [_decide(p, bit, mask) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out
    if isinstance(node, Or):
        parts = [_decide(p, bit, mask) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out
    if isinstance(node, Not):
        inner = _decide(node.part, bit, mask)
        return not inner if isinstance(inner, bool) else ~inner
    leaf = node.part if isinstance(node, Marker) else node
    if isinstance(mask, int):
        return bool(mask >> bit[leaf] & 1)
    return mask[bit[leaf] // BITS].bitwiseAND(F.lit(1 << bit[leaf] % BITS)) != 0


def search(index: DataFrame, node: Node, uids: str = "uid_list", keys: tuple[str, ...] = ("shard_id", "datatype")) -> DataFrame:
    """keys and uid of the documents whose postings satisfy the query."""
    leaves = list(dict.fromkeys(_leaves(node)))
    bit = {leaf: i for i, leaf in enumerate(leaves)}
    if _decide(node, bit, 0):
        raise QueryError("documents without any of the terms can't be found in the index")
    conditions = {leaf: term_condition(leaf) for leaf in leaves}  # null is as good as false here, and plain conditions reach the scan
    masks = [f"mask{k}" for k in range(-(-len(leaves) // BITS))]
    marks = [F.lit(0).cast("long") for _ in masks]
    some = F.lit(False)
    for leaf, c in conditions.items():
        k = bit[leaf] // BITS
        marks[k] = marks[k].bitwiseOR(F.when(c, F.lit(1 << bit[leaf] % BITS)).otherwise(F.lit(0)).cast("long"))
        some = some | c
    hits = index.where(some).select(*keys, *[m.alias(n) for m, n in zip(marks, masks)], F.explode(uids).alias("uid")).where("uid is not null")
    docs = hits.groupBy(*keys, "uid").agg(*[F.bit_or(m).alias(m) for m in masks])
    return docs.where(_decide(node, bit, [F.col(m) for m in masks])).select(*keys, "uid")


def postings(df: DataFrame, catalog: Catalog, fields: list[str], uid: str, keys: list[str]) -> DataFrame:
    """An index of documents: keys, field_name, norm_value and uid_list, one fragment per term and document."""
    every = F.flatten(F.array(*[F.transform(Values(catalog.lookup(n)).array().column, lambda x: F.struct(x["field"].alias("field_name"), x["norm"].cast("string").alias("norm_value"))) for n in fields]))
    rows = df.select(*keys, F.array(F.col(uid)).alias("uid_list"), F.explode(F.array_distinct(every)).alias("t"))
    return rows.select(*keys, "t.field_name", "t.norm_value", "uid_list")


def terms(df: DataFrame, keys: list[str], tokens: Column, field: str) -> DataFrame:
    """Postings of a tokenised field: keys, field, term and its positions in order."""
    rows = df.select(*keys, F.lit(field).alias("field"), F.posexplode(tokens).alias("pos", "term"))
    return rows.groupBy(*keys, "field", "term").agg(F.array_sort(F.collect_list("pos")).alias("offsets"))


def merge_offsets(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of several loads of the same documents united, each once."""
    return postings.groupBy(*keys, "field", "term").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("offsets"))


def date_index(df: DataFrame, uid: str, dates: dict[str, str], day: str) -> DataFrame:
    """kind, date, day, uid: on which event day the documents with a date of some kind lie."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.date_format(c, "yyyyMMdd").alias("date")) for k, c in dates.items()])
    rows = df.select(F.col(uid).alias("uid"), F.col(day).alias("day"), F.explode(pairs).alias("p")).where("p.date is not null")
    return rows.select("p.kind", "p.date", "day", "uid").distinct()


def days_of(index: DataFrame, kind: str, start: str, end: str) -> DataFrame:
    """The event days that hold documents with a date of the kind in the range."""
    return index.where((F.col("kind") == kind) & F.col("date").between(start, end)).groupBy("date").agg(F.array_sort(F.collect_set("day")).alias("days"))
