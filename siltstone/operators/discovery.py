"""Discovery of terms, facets and the field dictionary, over a table of index entries or documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.lang.ast import And, Cmp, Ident, Lit, Marker, Node, Or
from siltstone.lang.jexl import QueryError, is_range
from siltstone.plans.compiler import OPS, full_match


def fragments(index: DataFrame, columns: list[str], fragment_id: str = "fragment_id") -> DataFrame:
    """Each delivered fragment once, with the given columns, which its deliveries agree in.

    Conditions on terms belong before it, so that fewer rows are shuffled.
    """
    return index.select(fragment_id, *columns).distinct()


def term_condition(node: Node, term: str = "norm_value", field: str = "field_name") -> Column:
    """A query's literals, patterns and ranges as a condition on (field, term); unfielded terms match any field."""
    if isinstance(node, (And, Or)) and not is_range(node):
        out = term_condition(node.parts[0], term, field)
        for p in node.parts[1:]:  # every term of a query is looked up, however they are joined
            out = out | term_condition(p, term, field)
        return out
    if isinstance(node, Marker):
        return term_condition(node.part, term, field)
    if is_range(node):
        a, b = node.parts  # type: ignore[union-attr]
        return (F.col(field) == a.left.name) & OPS[a.op](F.col(term), str(a.right.value)) & OPS[b.op](F.col(term), str(b.right.value))
    if isinstance(node, Cmp) and isinstance(node.left, Ident) and isinstance(node.right, Lit):
        value = str(node.right.value)
        hit = full_match(F.col(term), value) if node.op == "=~" else OPS[node.op](F.col(term), F.lit(value.lower()))
        return hit if node.left.name == "_ANYFIELD_" else (F.col(field) == node.left.name) & hit
    raise QueryError(f"nothing to discover in {node}")


def discover(index: DataFrame, node: Node, by: tuple[str, ...] = ("norm_value", "field_name", "datatype"), day: Column | None = None, count: str = "uid_count", fragment_id: str = "fragment_id", visibility: str | None = None, references: bool = False) -> DataFrame:
    """Counts of the terms that a query names, per field, datatype and day; sums of zero or less are left out.

    ``visibility`` keeps the counts of each visibility apart; ``references`` counts the index's entries of a term
    instead of what these add up to.
    """
    day = F.substring("shard_id", 1, 8) if day is None else day
    found = index.where(term_condition(node)).withColumn("date", day)
    keys = [*by, "date", *([visibility] if visibility else [])]
    hits = fragments(found, [*keys, count], fragment_id)
    return hits.groupBy(*keys).agg((F.count("*") if references else F.sum(count)).alias("count")).where("count > 0")


def count_fields(index: DataFrame, text: str, model: dict[str, list[str]] | None = None, count: str = "uid_count", fragment_id: str = "fragment_id") -> DataFrame:
    """Entries and counts of each term of fields: ``FIELD`` or ``FIELD:value``, several between blanks; names may stand for fields of a model."""
    wanted: Column | None = None
    for part in text.split():
        name, _, value = part.partition(":")
        for field in dict.fromkeys([name.upper(), *(model or {}).get(name.upper(), [])]):
            one = F.col("field_name") == field
            one = one & (F.col("norm_value") == value.lower()) if value else one
            wanted = one if wanted is None else wanted | one
    if wanted is None:
        raise QueryError("no field to count")
    rows = fragments(index.where(wanted), ["field_name", "norm_value", "datatype", count], fragment_id)
    return rows.groupBy("field_name", "norm_value", "datatype").agg(F.count("*").alias("entries"), F.sum(count).alias("count"))


def reverse_discover(index: DataFrame, suffix: str, field: str | None = None) -> DataFrame:
    """Entries of terms that end in a text: a prefix search on the reversed term."""
    hits = index.where(F.reverse("norm_value").startswith(suffix[::-1]))
    return hits.where(F.col("field_name") == field) if field else hits


def facets(df: DataFrame, fields: dict[str, str], day: str | None = None, least: int = 1, most: int | None = None) -> DataFrame:
    """field, value[, day], count over documents; lists count each value. One pass explodes all fields at once."""
    pairs = [F.transform(F.array_distinct(_as_array(df, c)), lambda v: F.struct(F.lit(n).alias("field"), v.alias("value"))) for n, c in fields.items()]
    rows = df.select(F.explode(F.flatten(F.filter(F.array(*pairs), lambda p: p.isNotNull()))).alias("p"), *([day] if day else []))
    out = rows.where("p.value is not null").groupBy("p.field", "p.value", *([day] if day else [])).agg(F.count("*").alias("count")).where(F.col("count") >= least)
    return out if most is None else out.orderBy(F.desc("count"), "field", "value").limit(most)


def _as_array(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("array<string>") if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("string"))


def dictionary(index: DataFrame) -> DataFrame:
    """What is known of each field and datatype."""
    return index.groupBy("field_name", "datatype").agg(
        F.count("*").alias("entries"), F.count_distinct("norm_value").alias("terms"), F.min(F.substring("shard_id", 1, 8)).alias("first_day"), F.max(F.substring("shard_id", 1, 8)).alias("last_day")
    )
