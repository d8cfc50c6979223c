"""``f:`` functions that are predicates; those that are options are taken out before compilation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.lang.ast import Lit, Node
from siltstone.lang.jexl import QueryError
from siltstone.plans.catalog import Field
from siltstone.plans.compiler import Compiler, full_match, function

Args = tuple[Node, ...]


@function("f", "length")
def length(c: Compiler, args: Args) -> Column:
    low, high = int(c.text(args[1])), int(c.text(args[2]))
    if high < low:
        raise QueryError("length: the upper bound is below the lower")
    return c.values(args[0]).any(lambda f, x: F.length(f.norm(x).cast("string")).between(low, high))


@function("f", "between")
def between(c: Compiler, args: Args) -> Column:
    """Bounds of text, of whole numbers compared exactly, or of numbers compared in single precision.

    Flags tell whether bounds belong to the range. Whole bounds are exact on fields of whole numbers; a fraction among
    the bounds or the values makes it single precision.
    """
    values = [a.value for a in args[1:] if isinstance(a, Lit)]
    if len(values) == 2:
        (low, high), (in_low, in_high) = values, (True, True)
    elif len(values) == 3:
        (low, high), (in_low, in_high) = values[:2], (bool(values[2]),) * 2
    elif len(values) == 4:
        low, in_low, high, in_high = values
    else:
        raise QueryError("between: wrong arguments")
    numeric = not isinstance(low, str) and not isinstance(high, str)
    whole = numeric and isinstance(low, int) and isinstance(high, int)

    def test(f: Field, x: Column) -> Column:
        kind = "bigint" if whole and f.spark in ("bigint", "int") else "float" if numeric else "string"
        value = f.norm(x).try_cast(kind) if kind == "float" else f.norm(x).cast(kind)
        a, b = (F.lit(v).cast(kind) for v in (low, high))
        return ((value >= a) if in_low else (value > a)) & ((value <= b) if in_high else (value < b))

    return c.values(args[0]).any(test)


@function("f", "matchRegex")
def match_regex(c: Compiler, args: Args) -> Column:
    return c.values(args[0]).any(lambda f, x: full_match(f.raw(x), c.text(args[1])))


@function("f", "includeText")
def include_text(c: Compiler, args: Args) -> Column:
    return c.values(args[0]).any(lambda f, x: f.raw(x) == c.text(args[1]))
