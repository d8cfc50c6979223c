"""Distinct counts by linear counting over mergeable bitmaps (problem 5).

Every identifier sets one hashed bit of its group's bitmap of m bits; bitmaps merge by bitwise or; the share
V of bits that stay empty gives the estimate -m ln V. A bitmap is kept as its non-zero words, rows
(group, word, bits), so small groups cost what they hold, building one is a hash aggregation that combines
map-side, and a group with most of the rows is spread over tasks by word number and never exceeds m / 64
rows.

m is a power of two, sized for the wanted standard error at the largest cardinality that is planned for (by default
the number of identifier occurrences, counted first); it is kept with the rows and is the same for all groups of one
build. Parts of other days or runs may have another m: a bitmap of m bits folds to one of m / 2 by or-ing its halves,
exactly as if it had been built so, and :func:`unite` folds all parts to the smallest m before it merges them; the
stated errors are then those of that m. A store of partial results should be sized for all its days together.
The relative standard error at n = t m identifiers is sqrt(m (exp(t) - t - 1)) / n, which is largest at the
ends: sqrt(1 / (2 m)) for few identifiers.

Defined results: null identifiers don't count; null group columns form groups; a group without identifiers
has no row. A full bitmap, which sizing rules out, counts as having half an empty bit.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stage

TARGET_ERROR = 0.01
LEAST_BITS = 1 << 13
Z95 = 1.96


def relative_error(n: float, bits: int) -> float:
    """Standard error of the estimate as a share of n."""
    t = n / bits
    return math.sqrt(bits * (math.expm1(t) - t)) / n if 0 < t < 700 else math.inf


def size_bits(capacity: int, target: float = TARGET_ERROR) -> int:
    """The smallest power of two that keeps the standard error at ``target`` for 1 to ``capacity`` identifiers."""
    bits = LEAST_BITS
    while math.sqrt(1 / (2 * bits)) > target or relative_error(max(1, capacity), bits) > target:
        bits *= 2
    return bits


def build(ids: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Bitmaps (dims..., m, word, bits) of the column ``id`` per group of ``dims``."""
    at = F.pmod(F.xxhash64("id"), F.lit(bits).cast("long"))
    rows = ids.where("id is not null").select(*dims, at.alias("at"))
    return rows.groupBy(*dims, F.lit(bits).cast("long").alias("m"), F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def merge(bitmaps: DataFrame, dims: list[str]) -> DataFrame:
    """Union of the bitmaps that agree in ``dims``; they must agree in m."""
    return bitmaps.groupBy(*dims, "m", "word").agg(F.bit_or("bits").alias("bits"))


def fold(bitmaps: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """The bitmaps with ``bits`` bits, a power of two and no more than they have: the same as if built so."""
    return merge(bitmaps.withColumns({"m": F.lit(bits).cast("long"), "word": F.pmod("word", F.lit(bits // 64).cast("long"))}), dims)


def unite(parts: list[DataFrame], dims: list[str]) -> DataFrame:
    """Union of partial results of any sizes, at the smallest of these."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    least = rows.agg(F.min("m")).first()[0]
    return fold(rows, dims, least) if least else rows


def cube(bitmaps: DataFrame, dims: list[str]) -> DataFrame:
    """Bitmaps of all combinations of ``dims``; ``level`` names the dimensions kept, the others are null.

    Each combination is merged from one with a single dimension more, which is already reduced, and each
    rank of the lattice is written once.
    """
    blank = lambda keep: [(F.col(d) if d in keep else F.lit(None).cast(bitmaps.schema[d].dataType)).alias(d) for d in dims]
    name = lambda keep: ",".join(keep) or "all"
    rank = stage(bitmaps.select(F.lit(name(dims)).alias("level"), *dims, "m", "word", "bits"), "bitmaps")
    done = [rank]
    for k in range(len(dims) - 1, -1, -1):
        parts = []
        for keep in combinations(dims, k):
            # Of the parents, the one that adds the last missing dimension.
            extra = [d for d in dims if d not in keep][-1]
            parent = [d for d in dims if d in keep or d == extra]
            merged = merge(rank.where(F.col("level") == name(parent)), list(keep))
            parts.append(merged.select(F.lit(name(list(keep))).alias("level"), *blank(keep), "m", "word", "bits"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        rank = stage(out, "bitmaps")
        done.append(rank)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def estimate(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    """by..., estimate, std_error (relative) and the 95 % bounds lower and upper."""
    m = F.col("m").cast("double")
    used = bitmaps.groupBy(*by, "m").agg(F.sum(F.bit_count("bits")).cast("double").alias("used"))
    n = -m * F.log(F.greatest(m - F.col("used"), F.lit(0.5)) / m)
    t = F.col("estimate") / m
    rel = F.sqrt(m * (F.expm1(t) - t)) / F.col("estimate")
    out = used.withColumn("estimate", n).withColumn("std_error", rel)
    spread = F.col("estimate") * F.col("std_error") * Z95
    return out.select(
        *by, F.round("estimate").cast("long").alias("estimate"), F.col("std_error"),
        F.greatest(F.lit(0), F.floor(F.col("estimate") - spread)).cast("long").alias("lower"), F.ceil(F.col("estimate") + spread).cast("long").alias("upper"),
    )
