"""Options of a query, given beside it or as functions inside it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from siltstone.lang.ast import And, Call, Ident, Lit, Marker, Node, Not, Or, conjunction, disjunction
from siltstone.lang.jexl import QueryError

GRANULARITIES = ["ALL", "YEAR", "MONTH", "DAY", "HOUR", "TENTH_OF_HOUR", "MINUTE", "SECOND", "MILLISECOND"]
AGGREGATES = ["sum", "max", "min", "count", "average"]


def _names(text: str) -> list[str]:
    return [x.strip().lstrip("$").upper() for x in text.split(",") if x.strip()]


def parse_unique(text: str) -> dict[str, list[str]]:
    """``A,B[DAY,HOUR]`` as {field: granularities}."""
    out: dict[str, list[str]] = {}
    for m in re.finditer(r"([^,\[\]]+)(?:\[([^\]]*)\])?", text):
        name = m[1].strip().lstrip("$").upper()
        if not name:
            continue
        grains = [g.strip().upper() for g in (m[2] or "ALL").split(",") if g.strip()]
        if bad := [g for g in grains if g not in GRANULARITIES]:
            raise QueryError(f"unknown granularity {bad}")
        have = out.setdefault(name, [])
        have += [g for g in grains if g not in have]
    return out


@dataclass
class Options:
    include: list[str] = field(default_factory=list)  # return.fields
    exclude: list[str] = field(default_factory=list)  # disallowlisted.fields
    rename: dict[str, list[str]] = field(default_factory=dict)
    limit_fields: dict[str, int] = field(default_factory=dict)
    group: list[str] = field(default_factory=list)
    aggregates: dict[str, list[str]] = field(default_factory=dict)
    unique: dict[str, list[str]] = field(default_factory=dict)
    lenient: set[str] = field(default_factory=set)
    strict: set[str] = field(default_factory=set)
    no_expansion: set[str] = field(default_factory=set)
    excerpts: dict[str, tuple[int, str]] = field(default_factory=dict)
    datatypes: list[str] = field(default_factory=list)
    max_results: int | None = None
    hit_list: bool = False
    include_datatype: bool = False
    include_record_id: bool = False
    shards_and_days: list[str] = field(default_factory=list)
    other: dict[str, str] = field(default_factory=dict)

    def set(self, key: str, value: str) -> None:
        """One option by its public name."""
        k = key.strip().lower()
        if k == "return.fields":
            self.include += _names(value)
        elif k == "disallowlisted.fields":
            self.exclude += _names(value)
        elif k == "rename.fields":
            for pair in value.split(","):
                old, sep, new = pair.partition("=")
                if not sep:
                    raise QueryError(f"rename: {pair!r}")
                self.rename.setdefault(old.strip().upper(), []).append(new.strip().upper())
        elif k == "limit.fields":
            for pair in value.split(","):
                name, sep, n = pair.partition("=")
                if not sep:
                    raise QueryError(f"limit: {pair!r}")
                self.limit_fields[name.strip().upper()] = int(n)
        elif k == "group.fields":
            self.group += _names(value)
        elif k.endswith(".fields") and k.split(".")[0] in AGGREGATES:
            self.aggregates.setdefault(k.split(".")[0], []).extend(_names(value))
        elif k == "unique.fields":
            for name, grains in parse_unique(value).items():
                have = self.unique.setdefault(name, [])
                have += [g for g in grains if g not in have]
        elif k == "lenient.fields":
            self.lenient |= set(_names(value))
        elif k == "strict.fields":
            self.strict |= set(_names(value))
        elif k == "no.expansion.fields":
            self.no_expansion |= set(_names(value))
        elif k == "excerpt.fields":
            for part in value.split(","):
                name, n, *side = part.strip().split("/")
                self.excerpts[name.upper()] = (int(n), (side[0] if side else "both").lower())
        elif k == "datatype.filter.set":
            self.datatypes += [d.strip() for d in value.split(",") if d.strip()]
        elif k == "max.results.override":
            self.max_results = int(value)
        elif k == "hit.list":
            self.hit_list = value.lower() == "true"
        elif k == "include.datatype.as.field":
            self.include_datatype = value.lower() == "true"
        elif k == "include.record.id":
            self.include_record_id = value.lower() == "true"
        elif k == "shards.and.days":
            self.shards_and_days += [d.strip() for d in value.split(",") if d.strip()]
        elif k in OTHER:
            self.other[k] = value
        elif k not in NO_EFFECT:
            raise QueryError(f"unknown option {key}")


#: Options that the engine reads by name.
OTHER = {
    "ignore.nonexistent.fields", "model.name", "date.type", "include.grouping.context", "matching.field.sets", "include.child.count", "include.parent",
    "include.hierarchy.fields", "raw.data.only", "content.view.name", "content.view.all", "filter.masked.values", "return.uid.mapper",
}
#: Options that can't change a result here: they tune or place work that Spark plans, or name what a catalog already says.
NO_EFFECT = {
    "query.profile", "query.syntax", "model.table.name", "transform.content.to.uid", "group.fields.batch.size", "date.index.time.travel", "raw.types", "non.event.key.prefixes",
    "visibility.interpreter", "query.context.uid.mapper",
}

FUNCTIONS = {
    "unique": "unique.fields", "groupby": "group.fields", "rename": "rename.fields", "lenient": "lenient.fields", "strict": "strict.fields",
    "noExpansion": "no.expansion.fields", "excerpt_fields": "excerpt.fields", **{a: f"{a}.fields" for a in AGGREGATES},
}


def _text(node: Node) -> str:
    if isinstance(node, Lit):
        return str(node.value)
    if isinstance(node, Ident):
        return node.name
    raise QueryError(f"not an option: {node}")


def extract(node: Node | None, options: Options) -> Node | None:
    """Take option functions out of the tree into ``options``; conjunctions and disjunctions close up."""
    if isinstance(node, Call) and node.space == "f":
        args = [_text(a) for a in node.args if isinstance(a, (Lit, Ident))]
        if node.name == "options":
            if len(args) % 2:
                raise QueryError("options take pairs of name and value")
            for k, v in zip(args[::2], args[1::2]):
                options.set(k, v)
            return None
        if node.name in FUNCTIONS:
            options.set(FUNCTIONS[node.name], ",".join(args))
            return None
        if node.name.startswith("unique_by_"):
            grain = node.name[len("unique_by_") :].upper()
            options.set("unique.fields", ",".join(f"{n}[{grain}]" for a in args for n in _names(a)))
            return None
    if isinstance(node, And):
        return conjunction([p for x in node.parts if (p := extract(x, options)) is not None])
    if isinstance(node, Or):
        return disjunction([p for x in node.parts if (p := extract(x, options)) is not None])
    if isinstance(node, Not):
        part = extract(node.part, options)
        return None if part is None else Not(part)
    if isinstance(node, Marker):
        part = extract(node.part, options)
        return None if part is None else Marker(node.name, part)
    return node
