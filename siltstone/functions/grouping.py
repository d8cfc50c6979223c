"""``grouping:`` functions: values of several fields linked by their grouping context.

The context of a value is what follows its field's name: parts separated by periods, the last one the
instance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.lang.ast import Node
from siltstone.lang.jexl import QueryError
from siltstone.plans.compiler import Compiler, ValueArray, full_match, function, truth

Args = tuple[Node, ...]


def _parts(ctx: Column) -> Column:
    return F.split(ctx, r"\.")


def right_of(ctx: Column, pos: int) -> Column:
    """The last pos + 1 parts; null if there are fewer."""
    return F.when(F.size(_parts(ctx)) > pos, F.substring_index(ctx, ".", -(pos + 1)))


def left_of(ctx: Column, pos: int) -> Column:
    """Without the last pos + 1 parts; null if nothing is left."""
    parts = _parts(ctx)
    n = F.size(parts) - (pos + 1)
    return F.when(n > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(1))), "."))


def _split(c: Compiler, args: Args) -> tuple[list[tuple[Node, str]], int]:
    pos = int(c.text(args[-1])) if len(args) % 2 else 0
    pairs = [(args[i], c.text(args[i + 1])) for i in range(0, len(args) - len(args) % 2, 2)]
    if len(pairs) < 2:
        raise QueryError("at least two pairs of field and expression are needed")
    return pairs, pos


def _linked(c: Compiler, args: Args, left: bool) -> ValueArray:
    pairs, pos = _split(c, args)
    first = c.array(pairs[0][0]).keep(lambda x: full_match(x["raw"], pairs[0][1]))
    matches = []
    for node, regex in pairs[1:]:
        other = c.array(node)
        if left:
            near = lambda x, y: left_of(y["ctx"], pos) == left_of(x["ctx"], pos)
        else:
            near = lambda x, y: F.substring_index(y["ctx"], ".", -1) == right_of(x["ctx"], pos)
        hit = lambda y: truth(full_match(y["raw"], regex))
        near_hit = lambda x, y, near=near, hit=hit: truth(near(x, y)) & hit(y)
        # From the left, a match counts as soon as a linked value exists, whatever that value says.
        seen = near if left else near_hit
        matches.append(F.filter(first.column, lambda x: F.exists(other.column, lambda y: truth(seen(x, y)))))
        matches.append(F.filter(other.column, lambda y: F.exists(first.column, lambda x: near_hit(x, y))))
    texts = [F.transform(m, lambda x: F.struct(x["field"], x["raw"], x["norm"].cast("string").alias("norm"), x["ctx"])) for m in matches]
    every = F.array_distinct(F.flatten(F.array(*texts)))
    return ValueArray(F.when(F.size(every) >= len(pairs), every).otherwise(F.filter(every, lambda _: F.lit(False))))


@function("grouping", "matchesInGroup")
def matches_in_group(c: Compiler, args: Args) -> ValueArray:
    return _linked(c, args, False)


@function("grouping", "matchesInGroupLeft")
def matches_in_group_left(c: Compiler, args: Args) -> ValueArray:
    return _linked(c, args, True)


@function("grouping", "getGroupsForMatchesInGroup")
def groups_for_matches(c: Compiler, args: Args) -> ValueArray:
    """The values of the first field whose context also holds matches of all the others."""
    pairs, _ = _split(c, args)
    out = c.array(pairs[0][0]).keep(lambda x: full_match(x["raw"], pairs[0][1]))
    for node, regex in pairs[1:]:
        other = c.array(node)
        out = out.keep(lambda x, o=other, regex=regex: F.exists(o.column, lambda y: truth((y["ctx"] == x["ctx"]) & full_match(y["raw"], regex))))
    return out


@function("grouping", "atomValuesMatch")
def atom_values_match(c: Compiler, args: Args) -> ValueArray:
    """Values of the first field that every other field has too, in the same group."""
    out = c.array(args[0])
    for node in args[1:]:
        other = c.array(node)
        text = (lambda n: n) if out.type == other.type else (lambda n: n.cast("string"))
        same = lambda x, y, text=text: (F.substring_index(x["ctx"], ".", -1) == F.substring_index(y["ctx"], ".", -1)) & (text(x["norm"]) == text(y["norm"]))
        out = out.keep(lambda x, o=other: F.exists(o.column, lambda y: truth(same(x, y))))
    return out

