"""Event queries from text to result: parse, take options out, compile, filter, shape, reduce.

The order is fixed, since later steps see what earlier ones left: date range and datatypes, condition, hits,
projection, limits, then uniqueness, grouping, renaming and the number of results. Fields that uniqueness or
grouping need survive the projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import siltstone.functions  # noqa: F401  (registers the functions)
from siltstone.functions.content import excerpt
from siltstone.lang import jexl, lucene
from siltstone.lang.ast import And, Call, Cmp, Ident, Lit, Marker, Node, Or, conjunction, disjunction, fields
from siltstone.operators import aggregate, indexsearch, joins, shaping
from siltstone.plans.catalog import Catalog
from siltstone.plans.compiler import OPS, Compiler, full_match, truth
from siltstone.plans.options import Options, extract


@dataclass
class EventQuery:
    """Queries over one kind of documents.

    ``ids`` identify a document and order documents where one of several is kept. ``day`` is the column of the
    event day and ``datatype`` that of the document's type; a query's date range and datatypes refer to them.
    ``parent`` is the column of the parent's id, the first of ``ids``, where documents form a hierarchy. ``masked``
    says of masked columns which column holds the masked value and which condition shows the plain one. ``views``
    names the columns of views of a document's content. ``mappers`` turn the first of ``ids`` into what callers see,
    by the name that a query asks for. ``forced`` is a condition that every query must meet, whatever it says itself.

    ``index``, a table of postings, narrows a query before documents are read: the parts of its condition that name
    terms of indexed fields are answered from it, and only the documents that it names are looked at (``index_keys``
    are the columns that both share, beside the uid).
    """

    docs: DataFrame
    catalog: Catalog
    ids: list[str]
    day: str | None = None
    datatype: str | None = None
    macros: dict[str, str] = field(default_factory=dict)
    full_scan: bool = True
    date_types: dict[str, str] = field(default_factory=dict)  # other kinds of dates and their columns
    rules: list[Callable[[Node], Node]] = field(default_factory=list)  # a user's own rewrites of the tree
    models: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    most_days: int | None = None
    parent: str | None = None
    masked: dict[str, tuple[str, Column]] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    mappers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    forced: str | None = None
    index: DataFrame | None = None
    index_keys: tuple[str, ...] = ("shard_id", "datatype")

    def parse(self, text: str, syntax: str = "JEXL", options: Options | None = None) -> tuple[Node | None, Options]:
        """The condition without options, and the options."""
        text = jexl.expand_macros(text, self.macros)
        tokenized = {n for n, f in self.catalog.fields.items() if f.tokenized}
        node = lucene.to_tree(text, tokenized) if syntax.upper().startswith("LUCENE") else jexl.parse(text)
        options = options or Options()
        node = extract(node, options)
        for rule in self.rules if node is not None else []:
            node = rule(node)
        if self.forced is not None:
            node = conjunction([p for p in (node, jexl.parse(self.forced)) if p is not None])
        if options.other.get("ignore.nonexistent.fields", "true").lower() == "false":
            known = self._catalog(options)
            if unknown := sorted(f for f in fields(node) if not f.startswith("_") and f.lower() != "termoffsetmap" and not known.lookup(f)):
                raise jexl.QueryError(f"unknown fields {unknown}")
        return node, options

    def _catalog(self, options: Options) -> Catalog:
        """The catalog with the model that the options name."""
        name = options.other.get("model.name")
        if name is None:
            return self.catalog
        if name not in self.models:
            raise jexl.QueryError(f"no model {name}")
        return replace(self.catalog, model=self.catalog.model | self.models[name])

    def explain(self, text: str, syntax: str = "JEXL", dates: tuple[str, str] | None = None) -> str:
        """How Spark would run the query; nothing is run."""
        return self.run(text, syntax, dates)._jdf.queryExecution().explainString(self.docs.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def plan(self, text: str, syntax: str = "JEXL") -> str:
        """The query as it would run, as text."""
        return str(self.parse(text, syntax)[0])

    def compiler(self, options: Options) -> Compiler:
        return Compiler(self._catalog(options), options.lenient - options.strict, options.no_expansion)

    def matching(self, text: str, syntax: str = "JEXL", dates: tuple[str, str] | None = None, options: Options | None = None) -> DataFrame:
        """The documents that satisfy the query, unshaped."""
        return self._matching(*self.parse(text, syntax, options), dates)

    def _matching(self, node: Node | None, options: Options, dates: tuple[str, str] | None) -> DataFrame:
        df = self.docs
        kind = options.other.get("date.type")
        if kind is not None and kind.upper() not in self.date_types:
            raise jexl.QueryError(f"no dates of type {kind}")
        day = self.date_types[kind.upper()] if kind is not None else self.day
        if dates and self.most_days is not None and (datetime.strptime(dates[1], "%Y%m%d") - datetime.strptime(dates[0], "%Y%m%d")).days >= self.most_days:
            raise jexl.QueryError(f"more than {self.most_days} days")
        if dates and day:
            df = df.where(F.col(day).between(*dates))
        if options.shards_and_days and self.day:
            df = df.where(F.col(self.day).isin(options.shards_and_days))
        if options.datatypes and self.datatype:
            out = [d[1:] for d in options.datatypes if d.startswith("!")]
            only = [d for d in options.datatypes if not d.startswith("!")]
            df = df.where(F.col(self.datatype).isin(only)) if only else df
            df = df.where(~truth(F.col(self.datatype).isin(out))) if out else df
        if node is None:
            if not self.full_scan:
                raise jexl.QueryError("a query without a condition would read everything")
            return df
        if not self.full_scan and not _selective(node):
            raise jexl.QueryError(f"nothing in the query narrows the search: {node}")
        if self.index is not None:
            df = self._narrowed(df, node, dates)
        return df.where(self.compiler(options).filter(node))

    def _narrowed(self, df: DataFrame, node: Node, dates: tuple[str, str] | None) -> DataFrame:
        """The documents that the index names for the part of the condition it can answer; all where it can't answer any."""
        part = _answerable(node, self.catalog)
        if part is None:
            return df
        index = self.index.where(F.substring("shard_id", 1, 8).between(*dates)) if dates and "shard_id" in self.index_keys else self.index
        found = indexsearch.search(index, part, keys=self.index_keys)
        return df.join(found.withColumnRenamed("uid", self.ids[0]), [*self.index_keys, self.ids[0]], "left_semi")

    def run(self, text: str, syntax: str = "JEXL", dates: tuple[str, str] | None = None, options: Options | None = None) -> DataFrame:
        """The shaped result."""
        node, o = self.parse(text, syntax, options)
        df = self._matching(node, o, dates)
        if o.include_record_id:
            df = df.withColumn("RECORD_ID", F.concat_ws("/", *self.ids))
        if o.include_datatype and self.datatype:
            df = df.withColumn("EVENT_DATATYPE", F.col(self.datatype))
        keep = [*self.ids, "RECORD_ID", "EVENT_DATATYPE", "HIT_TERM", "HIT_EXCERPT", "CHILD_COUNT", "DESCENDANT_COUNT", "PARENT_UID"]
        if o.other.get("filter.masked.values", "true").lower() == "true":
            for column, (masked, seen) in self.masked.items():
                df = shaping.mask(df, column, masked, seen)
        df = self._hierarchy(df, o)
        view = o.other.get("content.view.name")
        if view is not None:
            if view not in self.views:
                raise jexl.QueryError(f"no view {view}")
            df = df.drop(*[c for n, c in self.views.items() if n != view and c != self.views[view]])
        elif o.other.get("content.view.all", "true").lower() == "false":
            df = df.drop(*self.views.values())
        if o.hit_list and node is not None:
            df = df.withColumn("HIT_TERM", shaping.hit_terms(node, self.catalog))
        if o.excerpts and node is not None:
            df = df.withColumn("HIT_EXCERPT", self._excerpt(node, o))
        needed = [f.column for n in [*o.unique, *o.group, *sum(o.aggregates.values(), [])] for f in self.catalog.lookup(n)]
        if sets := o.other.get("matching.field.sets"):
            if node is None:
                raise jexl.QueryError("matching.field.sets needs a condition")
            test = _hit_test(node, self.catalog)
            for names in sets.split(","):
                linked = [n.strip().upper() for n in names.split("=") if n.strip()]
                hit = [n for n in linked if n in _hit_fields(node)]
                if hit:
                    df = shaping.matching_field_sets(df, self.catalog, {n: (lambda raw, n=n: test(n, raw)) for n in hit}, linked)
        if o.include or o.exclude:
            df = shaping.project(df, self.catalog, o.include, o.exclude, keep + needed)
        if o.limit_fields:
            df = shaping.limit_fields(df, self.catalog, o.limit_fields, None if node is None else _hit_test(node, self.catalog))
        if o.other.get("include.grouping.context", "true").lower() == "false" and not o.group:
            df = df.withColumns({f.column: F.transform(f.column, lambda x: x["value"]) for f in self.catalog.fields.values() if f.context and f.column in df.columns})
        if o.unique:
            df = aggregate.unique(df, self.catalog, o.unique, self.ids)
        if o.group:
            df = aggregate.group(df, self.catalog, o.group, o.aggregates)
        if o.rename:
            df = shaping.rename(df, self.catalog, o.rename) if not o.group else df.select(*[F.col(c).alias(n) for c in df.columns for n in o.rename.get(c, [c])])
        mapper = o.other.get("return.uid.mapper")
        if mapper is not None:
            if mapper not in self.mappers:
                raise jexl.QueryError(f"no mapper {mapper}")
            df = df.withColumn(self.ids[0], self.mappers[mapper](F.col(self.ids[0])))
        if o.other.get("raw.data.only", "false").lower() == "true":
            df = df.select(*[c for c in df.columns if c in self.docs.columns])
        return df.limit(o.max_results) if o.max_results is not None else df

    def _hierarchy(self, df: DataFrame, o: Options) -> DataFrame:
        """Counts of children and descendants, and the parent's uid, where the options ask for them."""
        on = lambda name: o.other.get(name, "false").lower() == "true"
        every = on("include.hierarchy.fields")
        if not (every or on("include.child.count") or on("include.parent")):
            return df
        if self.parent is None:
            raise jexl.QueryError("these documents have no hierarchy")
        uid = self.ids[0]
        if every or on("include.child.count"):
            df = df.join(joins.descendant_counts(self.docs, uid, self.parent).select(uid, F.col("children").alias("CHILD_COUNT"), F.col("descendants").alias("DESCENDANT_COUNT")), uid, "left")
        if every or on("include.parent"):
            df = df.withColumn("PARENT_UID", F.col(self.parent))
        return df

    def count(self, text: str, syntax: str = "JEXL", dates: tuple[str, str] | None = None) -> DataFrame:
        return self.matching(text, syntax, dates).agg(F.count("*").alias("count"))

    def _excerpt(self, node: Node, o: Options):  # noqa: ANN202
        found = []
        for call in _calls(node, "phrase"):
            terms = [str(a.value).lower() for a in call.args if hasattr(a, "value")]
            for name, (n, side) in o.excerpts.items():
                found += [excerpt(F.col(f.column), terms, n, side) for f in self.catalog.lookup(name)]
        return F.coalesce(*found) if found else F.lit(None).cast("string")


def _answerable(node: Node, catalog: Catalog) -> Node | None:
    """The weakest condition that follows from a query and that an index of terms answers; None if there is none.

    Of a conjunction the parts that can be answered do, of a disjunction all must; negations follow from nothing in
    the index and are left to the documents.
    """
    if isinstance(node, And) and not jexl.is_range(node):
        return conjunction([p for x in node.parts if (p := _answerable(x, catalog)) is not None])
    if isinstance(node, Or):
        parts = [_answerable(p, catalog) for p in node.parts]
        return None if any(p is None for p in parts) else disjunction(parts)  # type: ignore[arg-type]
    if isinstance(node, Marker):
        return _answerable(node.part, catalog) if node.name in ("Bounded", "Value", "List", "Term") else None
    if jexl.is_range(node):
        return node if node.parts[0].left.name in catalog.indexed and all(isinstance(p.right.value, str) for p in node.parts) else None  # type: ignore[union-attr]
    if isinstance(node, Cmp) and isinstance(node.left, Ident) and isinstance(node.right, Lit) and isinstance(node.right.value, str) and node.op in ("==", "=~"):
        found = catalog.lookup(node.left.name)
        if node.left.name == "_ANYFIELD_" or not found or not {f.name for f in found} <= catalog.indexed:
            return None
        return disjunction([Cmp(node.op, Ident(f.name), node.right) for f in found])
    return None


def _hit_fields(node: Node) -> set[str]:
    """Fields that a positive leaf of the condition compares."""
    if isinstance(node, (And, Or)):
        return {n for p in node.parts for n in _hit_fields(p)}
    if isinstance(node, Marker):
        return _hit_fields(node.part)
    return {node.left.name} if isinstance(node, Cmp) and isinstance(node.left, Ident) and isinstance(node.right, Lit) and node.right.value is not None else set()


def _calls(node: Node, name: str) -> list[Call]:
    if isinstance(node, Call):
        return [node] if node.name == name else []
    parts = node.parts if isinstance(node, (And, Or)) else [node.part] if isinstance(node, Marker) else []
    return [c for p in parts for c in _calls(p, name)]


def _selective(node: Node) -> bool:
    """Whether some required part names values: a negation or a test for absence alone would read everything."""
    if isinstance(node, And):
        return any(_selective(p) for p in node.parts)
    if isinstance(node, Or):
        return all(_selective(p) for p in node.parts)
    if isinstance(node, Marker):
        return node.name not in ("Eval", "Delayed", "Drop") and _selective(node.part)
    return isinstance(node, Call) or isinstance(node, Cmp) and getattr(node.right, "value", 0) is not None


def _hit_test(node: Node, catalog: Catalog):  # noqa: ANN202
    """(field, raw value) -> whether the value satisfies a positive leaf."""
    leaves: dict[str, list] = {}

    def walk(n: Node) -> None:
        if isinstance(n, (And, Or)):
            for p in n.parts:
                walk(p)
        elif isinstance(n, Marker):
            walk(n.part)
        elif isinstance(n, Cmp) and hasattr(n.left, "name") and getattr(n.right, "value", None) is not None:
            for f in catalog.lookup(n.left.name):
                leaves.setdefault(f.name, []).append((n.op, n.right.value, f))

    walk(node)

    def test(name: str, raw):  # noqa: ANN001, ANN202
        out = F.lit(False)
        for op, value, f in leaves.get(name, []):
            out = out | truth(full_match(raw, str(value)) if op == "=~" else OPS[op](F.lower(raw) if f.type == "text" else raw.try_cast("double") if f.type == "number" else raw, f.literal(value)))
        return out

    return test
