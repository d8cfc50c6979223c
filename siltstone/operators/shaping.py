"""What a result document holds: projection, renaming, limits, hits, versions, masks and visibility."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.lang.ast import And, Call, Cmp, Ident, Lit, Marker, Node, Or
from siltstone.lang.jexl import QueryError
from siltstone.operators.results import ROW, number_rows
from siltstone.plans.catalog import Catalog
from siltstone.plans.compiler import OPS, Values, full_match, truth
from siltstone.workers import ship_to_active


def project(df: DataFrame, catalog: Catalog, include: list[str] | None = None, exclude: list[str] | None = None, keep: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Columns of the included fields, or all but the excluded; ``keep`` columns always stay."""
    wanted = {f.column for n in include or [] for f in catalog.lookup(n)}
    unwanted = {f.column for n in exclude or [] for f in catalog.lookup(n)}
    return df.select(*[c for c in df.columns if c in keep or ((not include or c in wanted) and c not in unwanted)])


def rename(df: DataFrame, catalog: Catalog, names: dict[str, list[str]]) -> DataFrame:
    """Fields under new names, several if wanted; the old name goes unless it is among them."""
    out: list[Column] = []
    by_column = {f.column: n for n, f in catalog.fields.items()}
    for c in df.columns:
        new = names.get(by_column.get(c, ""), [])
        out += [F.col(c).alias(n) for n in new] if new else [F.col(c)]
    return df.select(*out)


def limit_fields(df: DataFrame, catalog: Catalog, limits: dict[str, int], hits: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """At most n values of each multi-valued field; hits always stay, and n <= 0 keeps them alone.

    ``<FIELD>_ORIGINAL_COUNT`` tells how many there were where some were left out.
    """
    new: dict[str, Column] = {}
    for name, n in limits.items():
        for f in catalog.lookup(name):
            if not f.multi:
                continue
            values = F.col(f.column)
            hit = (lambda x: truth(hits(f.name, f.raw(x)))) if hits else (lambda x: F.lit(False))
            first = F.concat(F.filter(values, hit), F.filter(values, lambda x: ~hit(x)))
            n_hits = F.size(F.filter(values, hit))
            room = n_hits if n <= 0 else F.greatest(F.lit(n), n_hits)
            new[f.column] = F.when(values.isNotNull(), F.slice(first, F.lit(1), room))
            new[f"{f.name}_ORIGINAL_COUNT"] = F.when(F.size(values) > room, F.size(values))
    return df.withColumns(new)


def hit_terms(node: Node, catalog: Catalog) -> Column:
    """``FIELD:value`` of every value that satisfies a positive leaf of the query, in order, each once."""
    found: list[Column] = []

    def leaf(name: str, test: Callable) -> None:
        array = Values(catalog.lookup(name)).array()
        found.append(F.transform(array.keep(test).column, lambda x: F.concat(x["field"], F.lit(":"), x["raw"])))

    def walk(n: Node) -> None:
        if isinstance(n, (And, Or)):
            for p in n.parts:
                walk(p)
        elif isinstance(n, Marker):
            walk(n.part)
        elif isinstance(n, Cmp) and isinstance(n.left, Ident) and isinstance(n.right, Lit) and n.right.value is not None:
            f = catalog.lookup(n.left.name)
            if f and n.op == "=~":
                leaf(n.left.name, lambda x, v=str(n.right.value): full_match(x["raw"], v))
            elif f:
                leaf(n.left.name, lambda x, v=f[0].literal(n.right.value), op=n.op: OPS[op](x["norm"], v))
        elif isinstance(n, Call) and n.name in ("includeRegex", "matchRegex", "getAllMatches") and isinstance(n.args[0], Ident):
            leaf(n.args[0].name, lambda x, v=str(n.args[1].value): full_match(x["raw"], v))  # type: ignore[attr-defined]

    walk(node)
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found)))) if found else F.array().cast("array<string>")


def latest_versions(df: DataFrame, by: list[str], version: str) -> DataFrame:
    """Rows with the highest version of each document; ties stay.

    The highest versions come from an aggregation that combines map-side; a document with very many rows is
    split by the join, not gathered in one window.
    """
    top = df.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.max(version).alias("_top"))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    return df.join(top, on & F.col(version).eqNullSafe(F.col("_top"))).drop("_top", *[f"_{b}" for b in by])


def within_time(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows whose own time lies in a range, bounds included; plain comparisons, which reach the scan."""
    kind = df.schema[column].dataType
    return df.where((F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) <= F.lit(end).cast(kind)))


def mask(df: DataFrame, column: str, masked: str, visible: Column) -> DataFrame:
    """The plain value for those who may see it, else the masked one."""
    return df.withColumn(column, F.when(truth(visible), F.col(column)).otherwise(F.col(masked))).drop(masked)


def satisfied(expression: str | None, auths: frozenset[str]) -> bool:
    """Whether labels joined by &, | and parentheses hold for a caller; no expression is public, a broken one hidden."""
    if not expression or not expression.strip():
        return True
    tokens = re.findall(r'"[^"]*"|[\w.:/-]+|[&|()]|\S', expression)
    at = 0

    def either() -> bool:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            out = both() or out
        return out

    def both() -> bool:
        nonlocal at
        out = one()
        while at < len(tokens) and tokens[at] == "&":
            at += 1
            out = one() and out
        return out

    def one() -> bool:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            out = either()
            if tokens[at] != ")":
                raise IndexError
            at += 1
            return out
        if not re.match(r'["\w.:/-]', t):
            raise IndexError
        return t.strip('"') in auths

    try:
        return either() and at == len(tokens)
    except IndexError:
        return False


def visible(expression: Column, auths: set[str]) -> Column:
    """Whether a visibility expression holds for a caller. A plain label or none at all is decided without Python."""
    have = frozenset(auths)
    ship_to_active()

    @F.pandas_udf("boolean")
    def decide(values: pd.Series) -> pd.Series:
        return values.map({v: satisfied(v, have) for v in values.unique()}).astype(bool)

    plain = expression.isNull() | expression.rlike(r"^[\w.:/-]*$")
    return F.when(plain, expression.isNull() | (expression == "") | expression.isin(*sorted(have))).otherwise(decide(F.when(~plain, expression)))


def record_id(shard: Column, datatype: Column, uid: Column) -> Column:
    return F.concat_ws("/", shard, datatype, uid)


def pages(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds ``page``, from 1. The numbers come from a range sort and per-partition counts, not from one task."""
    return number_rows(df, order).withColumn("page", F.expr(f"({ROW} - 1) div {int(size)} + 1")).drop(ROW)


def matching_field_sets(df: DataFrame, catalog: Catalog, hits: dict[str, Callable[[Column], Column]], linked: list[str]) -> DataFrame:
    """Values of the linked fields only in the groups in which all the hit fields hit; other fields stay."""
    groups: Column | None = None
    for name, hit in hits.items():
        ctx = F.array_distinct(F.transform(F.filter(Values(catalog.lookup(name)).array().column, lambda x: truth(hit(x["raw"]))), lambda x: x["ctx"]))
        groups = ctx if groups is None else F.array_intersect(groups, ctx)
    new = {f.column: F.filter(f.column, lambda x: F.array_contains(groups, x["ctx"])) for n in linked for f in catalog.lookup(n) if f.context}
    return df.withColumns(new)


def drop_empty(df: DataFrame, catalog: Catalog, names: list[str] | None = None) -> DataFrame:
    """Without documents that hold none of the fields."""
    some = F.lit(False)
    for n in names or list(catalog.fields):
        some = some | Values(catalog.lookup(n)).present()
    return df.where(some)


def enrich(df: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Facts added to documents by key. Whether the facts are broadcast is decided by their size in bytes when the plan runs."""
    return df.join(facts, on, "left")


def permute(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A user's own transformations, one after the other."""
    return reduce(lambda d, f: d.transform(f), steps, df)


def virtual_field(df: DataFrame, name: str, parts: list[str], separator: str = "_", allow_missing: bool = False) -> DataFrame:
    """A field made of others; null if one is missing, unless that is allowed."""
    joined = F.concat_ws(separator, *parts)
    whole = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts])
    some = reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in parts])
    return df.withColumn(name, F.when(some if allow_missing else whole, joined))


def drop_if_present(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """{kept: dropped}: a field loses its value where the one to keep has one."""
    return df.withColumns({d: F.when(F.col(k).isNull(), F.col(d)) for k, d in rules.items()})


def check_fields(names: list[str], catalog: Catalog) -> None:
    if missing := [n for n in names if not catalog.lookup(n)]:
        raise QueryError(f"unknown fields {missing}")
