"""From the tree of a query to Spark columns.

A field is a set of values: a comparison holds if any value satisfies it, its negation if none does, and a
missing field satisfies nothing. Positive predicates of single values are left bare at the top of a filter,
where null and false are the same, so that they reach the scan; below a negation every leaf is made true or
false first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.lang.ast import And, Arith, Call, Cmp, Ident, Lit, Marker, Method, Node, Not, Or
from siltstone.lang.jexl import QueryError, is_range
from siltstone.plans.catalog import DATE, NUMBER, TEXT, Catalog, Field, text_bounds

OPS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def full_match(value: Column, regex: str) -> Column:
    """The whole value matches, in any case, over line ends."""
    return value.rlike(rf"(?ims)\A(?:{regex})\z")


def truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass
class Values:
    """The set of values that some fields hold."""

    fields: list[Field]

    def any(self, test: Callable[[Field, Column], Column | None]) -> Column:
        """Whether any value passes; a test may give None where it can't apply. Null counts as false."""
        out: Column | None = None
        for f in self.fields:
            if f.multi:
                if test(f, F.col(f.column)[0]) is None:
                    continue
                one = F.exists(F.col(f.column), lambda x: truth(test(f, x)))  # type: ignore[arg-type]
            else:
                one = test(f, F.col(f.column))  # type: ignore[assignment]
                if one is None:
                    continue
            out = one if out is None else truth(out) | truth(one)
        return F.lit(False) if out is None else out

    def present(self) -> Column:
        out = F.lit(False)
        for f in self.fields:
            out = out | (truth(F.size(f.column) > 0) if f.multi else F.col(f.column).isNotNull())
        return out

    def array(self) -> ValueArray:
        """All values as structs (field, raw, norm, ctx); norm is text where the fields differ in type."""
        types = {f.type for f in self.fields}
        kinds = {f.spark for f in self.fields}
        same = len(types) == 1 and (types == {DATE} or len(kinds) == 1)
        kind = self.fields[0].type if same and self.fields else TEXT

        def element(f: Field, x: Column) -> Column:
            norm = f.norm(x) if same else f.norm(x).cast("string")
            ctx = x["ctx"].cast("string") if f.context else F.lit(None).cast("string")
            return F.struct(F.lit(f.name).alias("field"), f.raw(x).alias("raw"), norm.alias("norm"), ctx.alias("ctx"))

        parts = []
        for f in self.fields:
            if f.multi:
                parts.append(F.transform(F.filter(f.column, lambda x: f.value(x).isNotNull()), lambda x: element(f, x)))
            else:
                parts.append(F.filter(F.array(element(f, F.col(f.column))), lambda x: x["raw"].isNotNull()))
        empty = F.array().cast("array<struct<field:string,raw:string,norm:string,ctx:string>>")
        if not parts:
            return ValueArray(empty, TEXT)
        # A null array has no values; flatten would give null for it, so nulls are dropped first.
        return ValueArray(F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull())), kind)


@dataclass
class ValueArray:
    """An array of structs (field, raw, norm, ctx) that a function gave; true if it isn't empty."""

    column: Column
    type: str = TEXT

    def norms(self) -> Column:
        return F.transform(self.column, lambda x: x["norm"])

    def keep(self, test: Callable[[Column], Column]) -> ValueArray:
        return ValueArray(F.filter(self.column, lambda x: truth(test(x))), self.type)


Builder = Callable[["Compiler", tuple[Node, ...]], "Column | ValueArray"]
REGISTRY: dict[tuple[str, str], Builder] = {}


def function(space: str, *names: str) -> Callable[[Builder], Builder]:
    """Register a builder as ``space:name``: the extension point for functions of one's own."""

    def keep(build: Builder) -> Builder:
        for n in names:
            REGISTRY[space, n.lower()] = build
        return build

    return keep


@dataclass
class Compiler:
    catalog: Catalog
    lenient: set[str] = field(default_factory=set)
    no_expansion: set[str] = field(default_factory=set)
    anything_lenient: bool = False

    # ---- arguments -------------------------------------------------------------------------------

    def values(self, node: Node) -> Values:
        """Fields named by an identifier or a union of identifiers."""
        if isinstance(node, Ident):
            return Values(self.catalog.lookup(node.name, node.name not in self.no_expansion))
        if isinstance(node, Or):
            return Values(list(dict.fromkeys(f for p in node.parts for f in self.values(p).fields)))
        raise QueryError(f"a field is needed, not {node}")

    def array(self, node: Node) -> ValueArray:
        if isinstance(node, (Call, Method)):
            out = self.call(node)
            if isinstance(out, ValueArray):
                return out
            raise QueryError(f"{node} isn't a set of values")
        return self.values(node).array()

    @staticmethod
    def text(node: Node) -> str:
        if isinstance(node, Lit):
            return str(node.value)
        raise QueryError(f"a literal is needed, not {node}")

    # ---- predicates ------------------------------------------------------------------------------

    def filter(self, node: Node | None) -> Column:
        """The condition of a filter."""
        return F.lit(True) if node is None else self.predicate(node)

    def predicate(self, node: Node, strict: bool = False) -> Column:
        """A boolean column; never null if ``strict``."""
        close = truth if strict else (lambda c: c)
        if isinstance(node, And):
            parts = [self.predicate(p, strict) for p in node.parts if not (isinstance(p, Marker) and p.name == "Drop")]
            out = parts[0] if parts else F.lit(True)
            for p in parts[1:]:
                out = out & p
            return out
        if isinstance(node, Or):
            parts = [self.predicate(p, strict) for p in node.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out | p
            return out
        if isinstance(node, Not):
            return ~self.predicate(node.part, True)
        if isinstance(node, Marker):
            return self._marker(node, strict)
        if isinstance(node, Cmp):
            return close(self._compare(node))
        if isinstance(node, (Call, Method)):
            out = self.call(node)
            return close(out if isinstance(out, Column) else F.size(out.column) > 0)
        if isinstance(node, Lit) and isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, Ident):
            return self.values(node).present()
        raise QueryError(f"not a condition: {node}")

    def _marker(self, node: Marker, strict: bool) -> Column:
        if node.name == "Bounded":
            return truth(self._range(node.part)) if strict else self._range(node.part)
        if node.name == "Drop":
            return F.lit(True)
        if node.name == "Lenient":
            inner = Compiler(self.catalog, self.lenient, self.no_expansion, True)
            return inner.predicate(node.part, strict)
        if node.name == "Strict":
            inner = Compiler(self.catalog, set(), self.no_expansion, False)
            return inner.predicate(node.part, strict)
        return self.predicate(node.part, strict)

    def _literal(self, f: Field, value: object, unfielded: bool) -> Column | None:
        """A literal in a field's normal form; None where it has none and may be skipped."""
        try:
            return f.literal(value)
        except QueryError:
            if unfielded or self.anything_lenient or f.name in self.lenient:
                return None
            raise

    def _range(self, node: Node) -> Column:
        if not is_range(node):
            raise QueryError(f"not a range of one field: {node}")
        a, b = node.parts  # type: ignore[union-attr]
        unfielded = a.left.name == "_ANYFIELD_"

        def test(f: Field, x: Column) -> Column | None:
            bounds = [(c.op, c.right.value, self._literal(f, c.right.value, unfielded)) for c in (a, b)]
            if any(v is None for _, _, v in bounds):
                return None
            norm = f.norm(x)
            out = F.lit(True)
            for op, raw, v in bounds:
                if f.type == NUMBER and f.spark not in ("bigint", "int"):
                    # Compared as single precision; the wider bound of the field's own type reaches the scan.
                    number = float(raw)
                    slack = abs(number) * 1e-6
                    wide = OPS[">=" if op[0] == ">" else "<="](norm, F.lit(number - slack if op[0] == ">" else number + slack))
                    out = out & wide & OPS[op](norm.cast("float"), F.lit(number).cast("float"))
                else:
                    out = out & OPS[op](norm, v)  # type: ignore[arg-type]
            return out

        return self.values(a.left).any(test)

    def _compare(self, node: Cmp) -> Column:
        left, right, op = node.left, node.right, node.op
        if isinstance(right, Lit) and right.value is None:
            if op != "==":
                raise QueryError(f"{op} null")
            return ~self.values(left).present() if isinstance(left, (Ident, Or)) else F.size(self.array(left).column) == 0
        if isinstance(left, Ident) and isinstance(right, Lit):
            return self._to_literal(left, op, right.value)
        if isinstance(left, (Ident, Or)) and isinstance(right, (Ident, Or)):
            if op == "=~":
                raise QueryError("a regular expression must be a literal")
            return self._to_field(self.values(left), op, self.values(right))
        if isinstance(right, Lit) and isinstance(right.value, bool) and op == "==":
            inner = self.predicate(left, True)
            return inner if right.value else ~inner
        return OPS[op](self.scalar(left), self.scalar(right))

    def _to_literal(self, left: Ident, op: str, value: object) -> Column:
        if left.name == "_NOFIELD_":
            return F.lit(False)
        unfielded = left.name == "_ANYFIELD_"
        if op == "=~":
            return self.values(left).any(lambda f, x: full_match(f.raw(x), str(value)))

        def test(f: Field, x: Column) -> Column | None:
            v = self._literal(f, value, unfielded)
            if v is None:
                return None
            bounds = text_bounds(str(value)) if op == "==" and f.type == TEXT and f.spark == "string" and not f.multi else None
            if bounds is None:
                return OPS[op](f.norm(x), v)
            # The bounds follow from the equality; unlike it they reach the scan and prune by the column's statistics.
            return (f.value(x) >= bounds[0]) & (f.value(x) <= bounds[1]) & (f.norm(x) == v)

        return self.values(left).any(test)

    def _to_field(self, a: Values, op: str, b: Values) -> Column:
        if len(a.fields) == len(b.fields) == 1 and not a.fields[0].multi and not b.fields[0].multi:
            f, g = a.fields[0], b.fields[0]
            return OPS[op](f.norm(F.col(f.column)), g.norm(F.col(g.column)))
        x, y = a.array().norms(), b.array().norms()
        if op == "==":
            return F.arrays_overlap(x, y)
        if op[0] == "<":
            return OPS[op](F.array_min(x), F.array_max(y))
        return OPS[op](F.array_max(x), F.array_min(y))

    # ---- values ----------------------------------------------------------------------------------

    def scalar(self, node: Node) -> Column:
        """A single value of an arithmetic expression; a field stands for its smallest value."""
        if isinstance(node, Lit):
            return F.lit(node.value)
        if isinstance(node, Arith):
            a, b = self.scalar(node.left), self.scalar(node.right)
            if node.op == "/":
                whole = all(isinstance(x, Lit) and isinstance(x.value, int) or isinstance(x, Method) for x in _leaves(node))
                return F.try_divide(a, b).cast("bigint") if whole else F.try_divide(a, b)
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[node.op](a, b)
        if isinstance(node, Method) and node.name in ("size", "max", "min"):
            array = self.array(node.target)
            return F.size(array.column) if node.name == "size" else (F.array_max if node.name == "max" else F.array_min)(array.norms())
        if isinstance(node, (Call, Method)):
            out = self.call(node)
            if isinstance(out, Column):
                return out
            return F.array_min(out.norms())
        if isinstance(node, Ident):
            fields = self.values(node).fields
            if len(fields) == 1 and not fields[0].multi:
                return fields[0].norm(F.col(fields[0].column))
            return F.array_min(self.values(node).array().norms())
        raise QueryError(f"not a value: {node}")

    def call(self, node: Node) -> Column | ValueArray:
        if isinstance(node, Call):
            build = REGISTRY.get((node.space.lower(), node.name.lower()))
            if not build:
                raise QueryError(f"unknown function {node.space}:{node.name}")
            return build(self, node.args)
        assert isinstance(node, Method)
        return self._method(node)

    def _method(self, node: Method) -> Column | ValueArray:
        name, args = node.name, node.args
        array = self.array(node.target)
        if name in ("size", "max", "min"):
            return self.scalar(node)
        if name == "isEmpty":
            return F.size(array.column) == 0
        if name == "contains":
            if len(args) == 2:
                return F.exists(array.column, lambda x: truth((F.concat_ws(".", x["field"], x["ctx"]) == self.text(args[0])) | (x["field"] == self.text(args[0]))) & truth(x["raw"] == self.text(args[1])))
            given, _, value = self.text(args[0]).partition(":")
            if value:
                return F.exists(array.column, lambda x: truth((F.concat_ws(".", x["field"], x["ctx"]) == given) & (x["raw"] == value)))
            return F.exists(array.column, lambda x: truth(x["raw"] == given))
        if name in ("getValueForGroup", "getValuesForGroups"):
            if isinstance(args[0], Lit):
                return array.keep(lambda x: x["ctx"] == self.text(args[0]))
            groups = self.array(args[0])
            return array.keep(lambda x: F.exists(groups.column, lambda g: truth(g["ctx"] == x["ctx"])))
        if name == "getGroupsForValue":
            return array.keep(lambda x: F.lower(x["raw"]) == self.text(args[0]).lower())
        if name in ("compareWith", "lessThan", "greaterThan"):
            op = {"lessThan": "<", "greaterThan": ">"}.get(name) or self.text(args[1])
            if op not in OPS:
                raise QueryError(f"unknown operator {op}")
            ref = self.scalar(args[0])
            return array.keep(lambda x: OPS[op](x["norm"], ref))
        raise QueryError(f"unknown method {name}")


def _leaves(node: Node) -> list[Node]:
    return _leaves(node.left) + _leaves(node.right) if isinstance(node, Arith) else [node]
