"""Edges between values: building them from documents, combining, querying, and the way back to documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.lang.ast import And, Call, Cmp, Marker, Node, Or
from siltstone.lang.jexl import QueryError, parse
from siltstone.plans.catalog import TEXT, Catalog, Field
from siltstone.plans.compiler import Compiler, Values, full_match

KEYS = ["source", "sink", "type", "relation", "attribute1", "attribute2", "attribute3", "date", "date_type", "format"]
STANDARD, STATS = "STANDARD", "STATS"
# What an edge's date is, its event's, another's, or both on one day; old edges have the event's.
EVENT_ONLY, ACTIVITY_ONLY, ACTIVITY_AND_EVENT, OLD_EVENT = "A", "C", "B", ""
# The bounds of the bins of durations, in seconds.
DURATIONS = [10, 30, 60, 300, 600, 1800]
#: Kinds of dates of a query: whether the day of loading counts instead of the edge's date, and what dates an edge may have.
OF_EVENT, OF_ACTIVITY = [EVENT_ONLY, ACTIVITY_AND_EVENT, OLD_EVENT], [ACTIVITY_ONLY, ACTIVITY_AND_EVENT]
DATE_TYPES = {"EVENT": (False, OF_EVENT), "ACTIVITY": (False, OF_ACTIVITY), "ANY": (False, None), "LOAD": (True, OF_EVENT), "ACTIVITY_LOAD": (True, OF_ACTIVITY), "ANY_LOAD": (True, None)}


@dataclass(frozen=True)
class EdgeDefinition:
    """An edge from the values of one field to those of another, for documents that meet a precondition.

    ``attribute2`` and ``attribute3`` (the category) are fields of the document. ``grouped``: only values of one
    grouping context are joined; otherwise all with all.
    """

    type: str
    source: str
    sink: str
    source_relation: str = "FROM"
    sink_relation: str = "TO"
    source_collection: str = ""
    sink_collection: str = ""
    both_ways: bool = False
    precondition: str | None = None
    attribute2: str | None = None
    attribute3: str | None = None
    grouped: bool = False


def _values(df: DataFrame, column: str) -> Column:
    return F.col(column) if df.schema[column].dataType.typeName() == "array" else F.array(F.col(column))


def _pairs(a: list[Field], b: list[Field], grouped: bool) -> Column:
    """The pairs (source, sink) of a document, each once for every pair of values."""
    left, right = Values(a).array().column, Values(b).array().column
    of = lambda x: F.filter(right, lambda y: y["ctx"].eqNullSafe(x["ctx"])) if grouped else right
    return F.flatten(F.transform(left, lambda x: F.transform(of(x), lambda y: F.struct(x["raw"].alias("source"), y["raw"].alias("sink")))))


def _dated(day: Column, activity: Column) -> Column:
    """The dates that an edge is kept under, with what they are: one row for both where they are one day."""
    one = lambda d, t: F.struct(d.alias("date"), F.lit(t).alias("date_type"))
    return F.when(activity.isNull(), F.array(one(day, EVENT_ONLY))).when(day == activity, F.array(one(day, ACTIVITY_AND_EVENT))).otherwise(F.array(one(day, EVENT_ONLY), one(activity, ACTIVITY_ONLY)))


def build(df: DataFrame, catalog: Catalog, definitions: list[EdgeDefinition], at: str, activity: str | None = None, loaded: str | None = None, seconds: str | None = None) -> DataFrame:
    """One row per edge of each document and date: keys, hour, day of loading, duration in seconds.

    ``at`` is the event's time, ``activity`` another time of it, ``loaded`` the time of loading and ``seconds`` a
    duration; those that aren't given are null, but an edge without activity has its event's date only.
    """
    out: DataFrame | None = None
    day = lambda c: F.date_format(c, "yyyyMMdd") if c else F.lit(None).cast("string")
    text = lambda n: F.lit("") if n is None else F.coalesce(F.get(F.transform(Values(catalog.lookup(n)).array().column, lambda x: x["raw"]), F.lit(0)), F.lit(""))
    for d in definitions:
        rows = df if d.precondition is None else df.where(Compiler(catalog).filter(parse(d.precondition)))
        collections = (d.source_collection, d.sink_collection)
        attribute1 = lambda a, b: f"{a}-{b}" if a or b else ""
        base = rows.select(
            F.explode(_pairs(catalog.lookup(d.source), catalog.lookup(d.sink), d.grouped)).alias("p"), F.lit(d.type).alias("type"),
            text(d.attribute2).alias("attribute2"), text(d.attribute3).alias("attribute3"), _dated(day(at), day(activity)).alias("dates"),
            F.hour(at).alias("hour"), day(loaded).alias("load_date"), (F.col(seconds).cast("long") if seconds else F.lit(None).cast("long")).alias("seconds"),
        )
        base = base.select("p.source", "p.sink", "type", "attribute2", "attribute3", F.inline("dates"), "hour", "load_date", "seconds")
        ways = [("source", "sink", f"{d.source_relation}-{d.sink_relation}", attribute1(*collections))]
        if d.both_ways:
            ways.append(("sink", "source", f"{d.sink_relation}-{d.source_relation}", attribute1(*collections[::-1])))
        # Both ways come from one row, so documents are read and paired once.
        both = F.explode(F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("sink"), F.lit(r).alias("relation"), F.lit(c).alias("attribute1")) for a, b, r, c in ways])).alias("w")
        edges = base.select(both, "type", "attribute2", "attribute3", "date", "date_type", "hour", "load_date", "seconds")
        edges = edges.select("w.source", "w.sink", "type", "w.relation", "w.attribute1", "attribute2", "attribute3", "date", "date_type", F.lit(STANDARD).alias("format"), "hour", "load_date", "seconds")
        out = edges if out is None else out.unionByName(edges)
    assert out is not None
    return out


def duration_bin(seconds: Column) -> Column:
    """0 to 6; null for an unknown duration."""
    out = F.lit(len(DURATIONS))
    for k in range(len(DURATIONS) - 1, -1, -1):
        out = F.when(seconds < DURATIONS[k], F.lit(k)).otherwise(out)
    return F.when(seconds.isNotNull(), out)


def combine(edges: DataFrame) -> DataFrame:
    """Count, 24 hourly counts, a mask of the hours, 7 counts of durations and the first day of loading of each edge and date.

    The histograms are conditional sums, which combine map-side, put into arrays at the end.
    """
    sums = [F.count_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)]
    lengths = [F.count_if(duration_bin(F.col("seconds")) == k).alias(f"d{k}") for k in range(7)]
    g = edges.groupBy(*KEYS).agg(F.count("*").alias("count"), F.bit_or(F.expr("shiftleft(1, hour)")).alias("hour_mask"), F.min("load_date").alias("load_date"), *sums, *lengths)
    return _histograms(g)


def _histograms(g: DataFrame) -> DataFrame:
    return g.select(*KEYS, "count", "hour_mask", "load_date", F.array(*[F.col(f"h{h}") for h in range(24)]).alias("hours"), F.array(*[F.col(f"d{k}") for k in range(7)]).alias("durations"))


def merge(combined: DataFrame) -> DataFrame:
    """Combined edges of several loads added up."""
    sums = [F.sum(F.col("hours")[h]).alias(f"h{h}") for h in range(24)] + [F.sum(F.col("durations")[k]).alias(f"d{k}") for k in range(7)]
    g = combined.groupBy(*KEYS).agg(F.sum("count").alias("count"), F.bit_or("hour_mask").alias("hour_mask"), F.min("load_date").alias("load_date"), *sums)
    return _histograms(g)


def stats_edges(combined: DataFrame) -> DataFrame:
    """The figures of every source and day as edges without sink, in the same columns: what all its edges come to."""
    source = F.substring_index("relation", "-", 1)
    one = combined.where(F.col("format") == STANDARD).withColumns({"sink": F.lit(None).cast("string"), "relation": source, "attribute1": F.substring_index("attribute1", "-", 1), "format": F.lit(STATS)})
    return merge(one)


def link_counts(edges: DataFrame) -> DataFrame:
    """Estimated distinct sinks per source, from mergeable sketches."""
    return edges.groupBy("source", "type").agg(F.hll_sketch_agg("sink").alias("links"))


EDGE_FIELDS = {"SOURCE": "source", "SINK": "sink", "TYPE": "type", "RELATION": "relation", "RELATIONSHIP": "relation", "ATTRIBUTE1": "attribute1", "ATTRIBUTE2": "attribute2", "ATTRIBUTE3": "attribute3"}
EDGE_CATALOG = Catalog({n: Field(n, c, TEXT) for n, c in EDGE_FIELDS.items()})


def query(edges: DataFrame, text: str, dates: tuple[str, str] | None = None, date_type: str = "EVENT", include_stats: bool = False) -> DataFrame:
    """Edges that satisfy a query over SOURCE, SINK, TYPE, RELATION and ATTRIBUTE1 to 3, compared in any case.

    ``date_type`` tells which dates count, those of events, of other activity or of loading; edges that differ in the
    sort of their date only are rows of their own. Stats edges come along if asked for; they have no sink, so a
    condition on it leaves them out. A query must name a source.
    """
    kind = date_type.upper()
    if kind not in DATE_TYPES:
        raise QueryError(f"no dates of type {date_type}")
    node = parse(text)
    if not _names_source(node):
        raise QueryError(f"the query names no source: {text}")
    loaded, sorts = DATE_TYPES[kind]
    out = edges.where(Compiler(EDGE_CATALOG).filter(node))
    out = out if include_stats else out.where(F.col("format") == STANDARD)
    out = out if sorts is None else out.where(F.col("date_type").isin(sorts))
    return out if dates is None else out.where(F.col("load_date" if loaded else "date").between(*dates))


def _names_source(node: Node) -> bool:
    """Whether every alternative has a positive condition on the source."""
    if isinstance(node, Or):
        return all(_names_source(p) for p in node.parts)
    if isinstance(node, And):
        return any(_names_source(p) for p in node.parts)
    if isinstance(node, Marker):
        return _names_source(node.part)
    names = [getattr(x, "name", "") for x in ((node.left,) if isinstance(node, Cmp) else node.args[:1] if isinstance(node, Call) else ())]
    return "SOURCE" in names and not (isinstance(node, Cmp) and node.op in ("!=", "!~"))


def extended_query(edges: DataFrame, sources: list[str], sinks: list[str] = (), dates: tuple[str, str] | None = None) -> DataFrame:  # type: ignore[assignment]
    """Edges from any of a list of sources, in any case, to sinks that match one of the expressions."""
    out = edges.where(F.lower("source").isin(*[s.lower() for s in sources]))
    if sinks:
        out = out.where(reduce(lambda a, b: a | b, [full_match(F.col("sink"), s) for s in sinks]))
    return out if dates is None else out.where(F.col("date").between(*dates))


def to_documents(edges: DataFrame, docs: DataFrame, source: str, sink: str) -> DataFrame:
    """Documents that hold both ends of one of the edges; the edges are first reduced to their ends."""
    ends = edges.select("source", "sink").distinct()
    rows = docs.withColumn("_s", F.explode(_values(docs, source))).withColumn("_t", F.explode(_values(docs, sink)))
    hit = rows.join(ends, (rows["_s"].cast("string") == ends["source"]) & (rows["_t"].cast("string") == ends["sink"]), "left_semi")
    return hit.drop("_s", "_t").distinct()


def dictionary(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("format") == STANDARD).groupBy("type", "relation", "attribute1").agg(F.min("date").alias("start_date"), F.max("date").alias("last_date"), F.count("*").alias("count"))
