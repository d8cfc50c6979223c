"""Unique documents, grouping within documents, counts and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.lang.jexl import QueryError
from siltstone.plans.catalog import DATE, Catalog, Field
from siltstone.plans.compiler import Values


def at_granularity(f: Field, value: Column, grain: str) -> Column:
    """A value cut to a granularity; values that aren't dates stay as they are."""
    text = value.cast("string")
    if grain == "ALL":
        return text
    at = value.cast("timestamp") if f.type == DATE else F.try_to_timestamp(text)
    if grain == "TENTH_OF_HOUR":  # ten minutes
        cut = F.concat(F.date_format(at, "yyyy-MM-dd HH:"), F.floor(F.minute(at) / 10).cast("string"))
    else:
        cut = F.date_format(at, {"YEAR": "yyyy", "MONTH": "yyyy-MM", "DAY": "yyyy-MM-dd", "HOUR": "yyyy-MM-dd HH", "MINUTE": "yyyy-MM-dd HH:mm", "SECOND": "yyyy-MM-dd HH:mm:ss", "MILLISECOND": "yyyy-MM-dd HH:mm:ss.SSS"}[grain])
    return F.coalesce(cut, text)


def unique_keys(catalog: Catalog, fields: dict[str, list[str]]) -> list[Column]:
    """One key per field: its values, each at all its granularities, in order. A missing field is null."""
    out = []
    for name, grains in fields.items():
        parts = []
        for f in catalog.lookup(name):
            cut = lambda x: F.concat_ws("/", *[at_granularity(f, f.value(x), g) for g in grains])
            if f.multi:
                parts.append(F.when(F.size(f.column) > 0, F.array_sort(F.transform(f.column, cut))))
            else:
                parts.append(F.when(F.col(f.column).isNotNull(), cut(F.col(f.column))))
        out.append(F.struct(*[p.alias(f"_{i}") for i, p in enumerate(parts)]) if len(parts) > 1 else parts[0] if parts else F.lit(None).cast("string"))
    return out


def unique(df: DataFrame, catalog: Catalog, fields: dict[str, list[str]], order: list[str]) -> DataFrame:
    """One document per key: the first by ``order``. An aggregation that combines map-side, so no key is too large."""
    keys = {f"_k{i}": k for i, k in enumerate(unique_keys(catalog, fields))}
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.withColumns(keys).groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def group(df: DataFrame, catalog: Catalog, by: list[str], aggregates: dict[str, list[str]] | None = None, visibility: str | None = None) -> DataFrame:
    """Counts of combinations of values, and sums, minima, maxima, counts and averages of other fields.

    Values of several fields belong together if they have the same grouping context; fields that share no
    context combine all with all. A document without any of the fields counts in the group of nulls. With a
    column of visibilities, each group gets the conjunction of those of its documents. A name that a model maps to
    several fields stands for the values of all of them, where equal values of one context count once; an unknown
    name is a field that no document has.
    """
    aggregates = aggregates or {}
    found = {n: catalog.lookup(n) for n in [*by, *sum(aggregates.values(), [])]}
    simple = all(len(fs) == 1 and not fs[0].multi for fs in found.values())
    specs = [(op, n) for op, names in aggregates.items() for n in names]
    seen = [] if visibility is None else [F.col(visibility).alias("_vis")]
    combined = [] if visibility is None else [F.array_join(F.array_sort(F.collect_set("_vis")), "&").alias("VISIBILITY")]
    if simple:
        columns = {n: F.col(catalog.lookup(n)[0].column) for n in [*by, *(n for _, n in specs)]}
        rows = df.select(*[columns[n].alias(n) for n in dict.fromkeys([*by, *(n for _, n in specs)])], *seen)
        aggs = [_aggregate(op, F.col(n)).alias(f"{n}_{op.upper()}") for op, n in specs]
        return rows.groupBy(*by).agg(F.count("*").alias("COUNT"), *aggs, *combined)
    rows = df.select(*[_values(found[n]).alias(f"_a_{n}") for n in dict.fromkeys([*by, *(n for _, n in specs)])], *seen)
    for i, n in enumerate(by):
        values = F.col(f"_a_{n}")
        for other in by[:i]:  # a value of an earlier field decides which values of this one go with it
            values = _linked(values, F.col(f"_g_{other}"))
        rows = rows.withColumn(f"_g_{n}", F.explode_outer(values))
    aggs = []
    for op, n in specs:
        values = F.col(f"_a_{n}")
        for g in by:
            values = _linked(values, F.col(f"_g_{g}"))
        norms = F.transform(values, lambda x: x["norm"])
        aggs.append(_array_aggregate(op, norms).alias(f"{n}_{op.upper()}"))
    named = [F.col(f"_g_{n}")["raw"].alias(n) for n in by]
    return rows.groupBy(*named).agg(F.count("*").alias("COUNT"), *aggs, *combined)


def _values(fields: list[Field]) -> Column:
    array = Values(fields).array().column
    if len(fields) < 2:
        return array
    return F.array_distinct(F.transform(array, lambda x: F.struct(x["raw"].alias("raw"), x["norm"].alias("norm"), x["ctx"].alias("ctx"))))


def merge_groups(groups: list[DataFrame], by: list[str], aggregates: dict[str, list[str]] | None = None) -> DataFrame:
    """Results of :func:`group` over parts of the documents as one; averages must come with the counts of their field."""
    rows = groups[0]
    for g in groups[1:]:
        rows = rows.unionByName(g)
    out = [F.sum("COUNT").alias("COUNT")]
    for op, names in (aggregates or {}).items():
        for n in names:
            c, count = F.col(f"{n}_{op.upper()}"), f"{n}_COUNT"
            if op == "average":
                if count not in rows.columns:
                    raise QueryError(f"averages of {n} can't be merged without their counts")
                out.append(ten_digits(F.try_divide(F.sum(c * F.col(count)), F.sum(F.when(c.isNotNull(), F.col(count))))).alias(f"{n}_AVERAGE"))
            else:
                out.append({"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[op](c).alias(f"{n}_{op.upper()}"))
    return rows.groupBy(*by).agg(*out)


def _linked(values: Column, chosen: Column) -> Column:
    """Values in the context of the chosen one; all of them where the two fields share no context."""
    same = F.filter(values, lambda x: x["ctx"] == chosen["ctx"])
    return F.when(F.size(same) > 0, same).otherwise(F.when(F.exists(values, lambda x: x["ctx"].isNotNull()) & chosen["ctx"].isNotNull() & (F.size(values) > 1), F.filter(values, lambda _: F.lit(False))).otherwise(values))


#: Aggregates of one's own by name: what they make of a column of single values.
OWN: dict[str, Callable[[Column], Column]] = {}


def _aggregate(op: str, c: Column) -> Column:
    if op in OWN:
        return OWN[op](c)
    return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "average": lambda x: ten_digits(F.avg(x))}[op](c)


def ten_digits(c: Column) -> Column:
    """Rounded to ten significant digits, half up: averages are kept no finer."""
    return F.format_string("%.9e", c).try_cast("double")


def _array_aggregate(op: str, a: Column) -> Column:
    if op in OWN:
        raise QueryError(f"{op} takes fields of single values")
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    if op == "sum":
        return F.sum(total)
    if op == "average":
        return ten_digits(F.try_divide(F.sum(total), F.sum(F.size(a))))
    return {"min": F.min(F.array_min(a)), "max": F.max(F.array_max(a)), "count": F.sum(F.size(a))}[op]


def selectivity(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Estimated distinct values (at most the total), total, and int(100 * distinct / total) per group."""
    stats = df.groupBy(*by).agg(F.count(value).alias("total"), F.approx_count_distinct(value, 0.01).alias("estimate"))
    distinct = F.least("estimate", "total")
    return stats.select(*by, "total", distinct.alias("distinct"), F.floor(F.try_divide(100 * distinct, F.col("total"))).cast("int").alias("selectivity"))


def index_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact distinct and total values per group."""
    return df.groupBy(*by).agg(F.count(value).alias("total"), F.count_distinct(value).alias("distinct"))


def facet_estimates(df: DataFrame, by: list[str], identifier: str, least: int = 1, most: int | None = None) -> DataFrame:
    """Estimated distinct documents per facet from sketches, with the bounds of two standard errors."""
    error = 1.04 / 2**6  # sketches of 4096 buckets
    out = df.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(identifier, 12)).alias("estimate")).where(F.col("estimate") >= least)
    out = out.withColumns({"lower": F.floor(F.col("estimate") * (1 - 2 * error)), "upper": F.ceil(F.col("estimate") * (1 + 2 * error))})
    return out if most is None else out.orderBy(F.desc("estimate"), *by).limit(most)


def uid_lists(df: DataFrame, by: list[str], uids: str, removed: str, ignore: str, count: str, most: int = 20) -> DataFrame:
    """Uid lists of all fragments of each key as one: count, ignore, uids, removed.

    A UID that any fragment removes is gone, whichever came first, and stays listed as removed. A key with a fragment
    that keeps a count only, or with more than ``most`` UIDs left, keeps a count only: those of its fragments, or the
    number of UIDs. No list holds more than ``most`` UIDs, and more removed than that aren't listed: what a key has is
    counted before it is gathered.
    """
    each = lambda c, gone: df.select(*by, F.explode(c).alias("uid"), F.lit(gone).alias("gone"))
    rows = each(uids, 0).unionByName(each(removed, 1)).where("uid is not null").groupBy(*by, "uid").agg(F.max("gone").alias("gone"))
    held = rows.groupBy(*by).agg(F.count_if(F.col("gone") == 0).alias("left"), F.count_if(F.col("gone") == 1).alias("gone"))
    flags = df.groupBy(*by).agg(F.bool_or(F.coalesce(ignore, F.lit(False))).alias("flagged"), F.sum(F.coalesce(count, F.lit(0))).alias("total"))
    keys = flags.join(held, by, "left").withColumns({"left": F.coalesce("left", F.lit(0)), "gone": F.coalesce("gone", F.lit(0))})
    keys = keys.withColumn("ignore", F.col("flagged") | (F.col("left") > most))
    small = keys.where(~F.col("ignore")).select(*by, F.col("gone").alias("n_gone"))
    lists = lambda gone: F.array_sort(F.collect_list(F.when(F.col("gone") == gone, F.col("uid"))))
    listed = rows.join(small, by).where((F.col("gone") == 0) | (F.col("n_gone") <= most)).groupBy(*by).agg(lists(0).alias("uids"), lists(1).alias("removed"))
    few = F.col("gone") <= most
    return keys.join(listed, by, "left").select(*by, F.when(F.col("flagged"), F.col("total")).otherwise(F.col("left")).alias("count"), "ignore", "uids", F.when(few, F.col("removed")).alias("removed"))
