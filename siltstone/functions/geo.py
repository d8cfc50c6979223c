"""``geo:`` and ``geowave:`` functions.

Points are text, "lat_lon" or WKT. Boxes and circles are arithmetic on coordinates; the relations of
arbitrary shapes run as an Arrow UDF after a test of bounding boxes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import shapes
from siltstone.lang.ast import Node
from siltstone.lang.jexl import QueryError
from siltstone.plans.compiler import Compiler, function, truth
from siltstone.workers import ship_to_active

Args = tuple[Node, ...]
POINT = r"(?i)^\s*POINT\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)\s*$"
PAIR = r"^\s*(-?[\d.]+)\s*[_,]\s*(-?[\d.]+)\s*$"


def coordinates(value: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a point; null where there is none."""
    wkt = lambda i: F.regexp_extract(value, POINT, i).try_cast("double")
    pair = lambda i: F.regexp_extract(value, PAIR, i).try_cast("double")
    return F.coalesce(wkt(2), pair(1)), F.coalesce(wkt(1), pair(2))


def _corner(text: str) -> tuple[float, float]:
    m = re.match(PAIR, text) or re.match(POINT, text)
    if not m:
        raise QueryError(f"not a point: {text!r}")
    a, b = float(m[1]), float(m[2])
    return (b, a) if text.strip()[:1].upper() == "P" else (a, b)


def _longitude(lon: Column, low: float, high: float) -> Column:
    """Between two longitudes; across the antimeridian if the first is the larger."""
    return (lon >= low) & (lon <= high) if low <= high else (lon >= low) | (lon <= high)


@function("geo", "within_bounding_box")
def within_box(c: Compiler, args: Args) -> Column:
    if len(args) == 3:
        (lat0, lon0), (lat1, lon1) = _corner(c.text(args[1])), _corner(c.text(args[2]))

        def test(f, x):  # noqa: ANN001, ANN202
            lat, lon = coordinates(f.raw(x))
            return (lat >= lat0) & (lat <= lat1) & _longitude(lon, lon0, lon1)

        return c.values(args[0]).any(test)
    lon0, lat0, lon1, lat1 = (float(c.text(a)) for a in args[2:6])
    number = lambda f, x: f.value(x).try_cast("double") if f.spark == "string" else f.value(x).cast("double")
    in_lon = c.values(args[0]).any(lambda f, x: _longitude(number(f, x), lon0, lon1))
    in_lat = c.values(args[1]).any(lambda f, x: number(f, x).between(lat0, lat1))
    return truth(in_lon) & truth(in_lat)


@function("geo", "within_circle")
def within_circle(c: Compiler, args: Args) -> Column:
    """Planar distance in degrees."""
    (lat0, lon0), radius = _corner(c.text(args[1])), float(c.text(args[2]))

    def test(f, x):  # noqa: ANN001, ANN202
        lat, lon = coordinates(f.raw(x))
        return (lat - lat0) * (lat - lat0) + (lon - lon0) * (lon - lon0) <= radius * radius

    return c.values(args[0]).any(test)


def _relation(name: str):  # noqa: ANN202
    def build(c: Compiler, args: Args) -> Column:
        target = c.text(args[1])
        ship_to_active()
        shapes.parse(target)  # a wrong shape is the query's fault, not the data's

        @F.pandas_udf("boolean")
        def related(values: pd.Series) -> pd.Series:
            other = shapes.parse(target)
            return values.map(lambda v: shapes.relate(name, v, other))

        def single(f) -> Column:  # noqa: ANN001
            if f.multi:
                raise QueryError("shapes of multi-valued fields aren't supported")
            value = f.raw(F.col(f.column))
            (x0, y0, x1, y1) = shapes.bounds(shapes.parse(target))
            lat, lon = coordinates(value)
            apart = truth((lon < x0) | (lon > x1) | (lat < y0) | (lat > y1))
            return F.when(apart | value.isNull(), F.lit(False)).otherwise(related(value))

        out = F.lit(False)
        for f in c.values(args[0]).fields:
            out = out | truth(single(f))
        return out

    return build


for _name in ("contains", "covers", "covered_by", "crosses", "intersects", "overlaps", "within"):
    function("geowave", _name)(_relation(_name))
