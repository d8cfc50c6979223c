"""``normalize:`` functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.lang.ast import Node
from siltstone.plans.catalog import pad_ipv4
from siltstone.plans.compiler import Compiler, ValueArray, function


@function("normalize", "ipv4")
def ipv4(c: Compiler, args: tuple[Node, ...]) -> ValueArray:
    array = c.array(args[0])
    return ValueArray(F.transform(array.column, lambda x: F.struct(x["field"], pad_ipv4(x["raw"]).alias("raw"), pad_ipv4(x["raw"]).alias("norm"), x["ctx"])))
