"""``filter:`` functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.lang.dates import column_millis, following, granularity, millis, parse_date
from siltstone.lang.ast import Lit, Node
from siltstone.lang.jexl import QueryError
from siltstone.plans.catalog import DATE, Field
from siltstone.plans.compiler import OPS, Compiler, ValueArray, full_match, function, truth

Args = tuple[Node, ...]


@function("filter", "includeRegex")
def include_regex(c: Compiler, args: Args) -> Column:
    return c.values(args[0]).any(lambda f, x: full_match(f.raw(x), c.text(args[1])))


@function("filter", "excludeRegex")
def exclude_regex(c: Compiler, args: Args) -> Column:
    return ~truth(include_regex(c, args))


@function("filter", "isNull")
def is_null(c: Compiler, args: Args) -> Column:
    return ~c.values(args[0]).present()


@function("filter", "isNotNull")
def is_not_null(c: Compiler, args: Args) -> Column:
    return c.values(args[0]).present()


@function("filter", "occurrence")
def occurrence(c: Compiler, args: Args) -> Column:
    op = c.text(args[1]) if len(args) == 3 else "=="
    op = {"=": "=="}.get(op, op)
    if op not in OPS:
        raise QueryError(f"unknown operator {op}")
    return OPS[op](F.size(c.array(args[0]).column), F.lit(int(c.text(args[-1]))))


@function("filter", "matchesAtLeastCountOf")
def at_least_count_of(c: Compiler, args: Args) -> Column:
    """At least n of the patterns hit; a pattern gives one hit at most, and equal hits count once."""
    n, values = int(c.text(args[0])), c.array(args[1])
    hits = [F.get(F.filter(values.column, lambda x: truth(full_match(x["raw"], c.text(p)))), F.lit(0)) for p in args[2:]]
    return F.size(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))) >= n


@function("filter", "getAllMatches")
def all_matches(c: Compiler, args: Args) -> ValueArray:
    return c.array(args[0]).keep(lambda x: full_match(x["raw"], c.text(args[1])))


def _time(f: Field, x: Column, pattern: str | None = None) -> Column:
    return column_millis(f.value(x), f.spark, pattern)


def _date_args(c: Compiler, args: Args, n: int) -> tuple[list[tuple[int, int]], str | None]:
    """(instant, following instant) of each of ``n`` literals, and the pattern of the column's values.

    After the field come the literals; a pattern before them is the values', one behind them the literals'.
    """
    rest = [c.text(a) for a in args[1:]]
    pattern = rest.pop(0) if len(rest) == n + 2 else None
    given = rest.pop() if len(rest) == n + 1 else None
    if len(rest) != n:
        raise QueryError("wrong number of dates")
    out = []
    for text in rest:
        at, unit = parse_date(text, given)
        out.append((millis(at), millis(following(at, granularity(given) if given and given != "e" else unit))))
    return out, pattern


@function("filter", "afterDate", "afterLoadDate")
def after_date(c: Compiler, args: Args) -> Column:
    [(_, nxt)], pattern = _date_args(c, args, 1)
    return c.values(args[0]).any(lambda f, x: _time(f, x, pattern) >= nxt)


@function("filter", "beforeDate")
def before_date(c: Compiler, args: Args) -> Column:
    [(at, _)], pattern = _date_args(c, args, 1)
    return c.values(args[0]).any(lambda f, x: _time(f, x, pattern) <= at - 1)


@function("filter", "beforeLoadDate")
def before_load_date(c: Compiler, args: Args) -> Column:
    [(at, _)], pattern = _date_args(c, args, 1)
    return c.values(args[0]).any(lambda f, x: _time(f, x, pattern).between(0, at - 1))


@function("filter", "betweenDates", "betweenLoadDates")
def between_dates(c: Compiler, args: Args) -> Column:
    [(start, _), (_, end)], pattern = _date_args(c, args, 2)
    return c.values(args[0]).any(lambda f, x: _time(f, x, pattern).between(start, end - 1))


def _extreme(c: Compiler, node: Node, most: bool) -> Column:
    times = [F.transform(F.filter(f.column, lambda x: f.value(x).isNotNull()), lambda x: _time(f, x)) if f.multi else F.array(_time(f, F.col(f.column))) for f in c.values(node).fields]
    pick = F.array_max if most else F.array_min
    return pick(F.array(*[pick(t) for t in times])) if times else F.lit(None).cast("bigint")


@function("filter", "getMaxTime")
def max_time(c: Compiler, args: Args) -> Column:
    return _extreme(c, args[0], True)


@function("filter", "getMinTime")
def min_time(c: Compiler, args: Args) -> Column:
    return _extreme(c, args[0], False)


@function("filter", "getTime")
def get_time(c: Compiler, args: Args) -> Column:
    return F.lit(millis(parse_date(c.text(args[0]), c.text(args[1]) if len(args) > 1 else None)[0])) if isinstance(args[0], Lit) else _extreme(c, args[0], False)


@function("filter", "getNextTime")
def get_next_time(c: Compiler, args: Args) -> Column:
    at, unit = parse_date(c.text(args[0]), c.text(args[1]) if len(args) > 1 else None)
    return F.lit(millis(following(at, unit)))


def _extreme_value(c: Compiler, node: Node, most: bool) -> ValueArray:
    """The values at the latest or earliest time among the values of a field; values that are no dates don't count."""
    fields = c.values(node).fields
    if not fields:
        return c.array(node)
    timed = []
    for f in fields:
        values = F.filter(f.column, lambda x: f.value(x).isNotNull()) if f.multi else F.filter(F.array(F.col(f.column)), lambda x: x.isNotNull())
        ctx = (lambda x: x["ctx"].cast("string")) if f.context else (lambda x: F.lit(None).cast("string"))
        timed.append(F.transform(values, lambda x: F.struct(_time(f, x).alias("at"), F.lit(f.name).alias("field"), f.raw(x).alias("raw"), _time(f, x).alias("norm"), ctx(x).alias("ctx"))))
    every = F.filter(F.flatten(F.filter(F.array(*timed), lambda t: t.isNotNull())), lambda x: x["at"].isNotNull())
    pick = F.array_max(F.transform(every, lambda x: x["at"])) if most else F.array_min(F.transform(every, lambda x: x["at"]))
    found = F.filter(every, lambda x: x["at"] == pick)
    return ValueArray(F.transform(F.slice(found, 1, 1), lambda x: F.struct(x["field"].alias("field"), x["raw"].alias("raw"), x["norm"].alias("norm"), x["ctx"].alias("ctx"))), DATE)


@function("filter", "getMaxValue")
def max_value(c: Compiler, args: Args) -> ValueArray:
    return _extreme_value(c, args[0], True)


@function("filter", "getMinValue")
def min_value(c: Compiler, args: Args) -> ValueArray:
    return _extreme_value(c, args[0], False)


@function("filter", "timeFunction")
def time_function(c: Compiler, args: Args) -> Column:
    """(latest of the first op earliest of the second) cmp goal, in milliseconds."""
    op, cmp, goal = c.text(args[2]), c.text(args[3]), int(c.text(args[4]))
    a, b = _extreme(c, args[0], True), _extreme(c, args[1], False)
    cmp = {"=": "=="}.get(cmp, cmp)
    calculate = {"-": F.try_subtract, "+": F.try_add, "*": F.try_multiply, "/": lambda x, y: F.try_divide(x, y).cast("bigint"), "%": F.try_mod}
    if op not in calculate or cmp not in OPS:
        raise QueryError(f"unknown operator {op} or {cmp}")
    return OPS[cmp](calculate[op](a, b), F.lit(goal))


@function("filter", "compare")
def compare(c: Compiler, args: Args) -> Column:
    """Two sets under an operator, for ANY or ALL of their values."""
    op, mode = c.text(args[1]), c.text(args[2]).upper()
    op = {"=": "=="}.get(op, op)
    if op not in OPS or mode not in ("ANY", "ALL"):
        raise QueryError(f"compare: {op} {mode}")
    a, b = (F.array_distinct(c.array(x).norms()) for x in (args[0], args[3]))
    no_a, no_b = F.size(a) == 0, F.size(b) == 0
    differ = F.size(F.array_except(a, b))
    if op == "==":
        same = F.arrays_overlap(a, b) if mode == "ANY" else (F.size(a) == F.size(b)) & (differ == 0)
        return (no_a & no_b) | truth(same)
    if op == "!=":
        other = (F.size(a) != F.size(b)) | (differ > 0) if mode == "ANY" else ~truth(F.arrays_overlap(a, b))
        return ~(no_a & no_b) & other
    low, high = (F.array_min, F.array_max) if op[0] == "<" else (F.array_max, F.array_min)
    x, y = (low(a), high(b)) if mode == "ANY" else (high(a), low(b))
    return ~no_a & ~no_b & truth(OPS[op](x, y))

