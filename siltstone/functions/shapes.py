"""Points, lines and polygons from WKT and how they lie to each other. Polygons may have holes.

A shape is (dimension, list of parts); a part is a list of rings or a path of points.
"""

from __future__ import annotations

import re
from functools import lru_cache

Point = tuple[float, float]
Shape = tuple[int, list]
KINDS = {"POINT": 0, "MULTIPOINT": 0, "LINESTRING": 1, "MULTILINESTRING": 1, "POLYGON": 2, "MULTIPOLYGON": 2}
EPS = 1e-12


def _points(text: str) -> list[Point]:
    return [(float(p.split()[0]), float(p.split()[1])) for p in text.replace("(", " ").replace(")", " ").split(",")]


@lru_cache(maxsize=10_000)
def parse(text: str) -> Shape:
    """Raises ValueError for anything but the kinds above."""
    m = re.match(r"\s*([A-Za-z]+)\s*(\(.*\))\s*$", text, re.S)
    kind = m[1].upper() if m else ""
    if not m or kind not in KINDS:
        raise ValueError(f"not a shape: {text[:60]!r}")
    body = m[2][1:-1]
    if kind.endswith("POINT"):
        return 0, _points(body)
    if kind == "LINESTRING":
        return 1, [_points(body)]
    if kind == "MULTILINESTRING":
        return 1, [_points(x) for x in re.findall(r"\(([^()]*)\)", body)]
    groups = re.findall(r"\(((?:\([^()]*\)\s*,?\s*)+)\)", m[2]) if kind == "POLYGON" else re.findall(r"\(((?:\([^()]*\)\s*,?\s*)+)\)", body)
    return 2, [[_points(r) for r in re.findall(r"\(([^()]*)\)", g)] for g in groups]


def _paths(s: Shape) -> list[list[Point]]:
    return [r for poly in s[1] for r in poly] if s[0] == 2 else s[1] if s[0] == 1 else [[p] for p in s[1]]


def vertices(s: Shape) -> list[Point]:
    return [p for path in _paths(s) for p in path]


def bounds(s: Shape) -> tuple[float, float, float, float]:
    v = vertices(s)
    return min(p[0] for p in v), min(p[1] for p in v), max(p[0] for p in v), max(p[1] for p in v)


def _edges(s: Shape) -> list[tuple[Point, Point]]:
    return [(a, b) for path in _paths(s) for a, b in zip(path, path[1:])]


def _side(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a: Point, b: Point, p: Point) -> bool:
    return abs(_side(a, b, p)) < EPS and min(a[0], b[0]) - EPS <= p[0] <= max(a[0], b[0]) + EPS and min(a[1], b[1]) - EPS <= p[1] <= max(a[1], b[1]) + EPS


def locate(p: Point, s: Shape) -> int:
    """1 inside, 0 on the border (or on a line or point), -1 outside."""
    if s[0] == 0:
        return 0 if any(abs(p[0] - q[0]) < EPS and abs(p[1] - q[1]) < EPS for q in s[1]) else -1
    if any(_on(a, b, p) for a, b in _edges(s)):
        return 0
    if s[0] == 1:
        return -1
    for poly in s[1]:
        inside = False
        for ring in poly:  # even-odd over all rings takes holes out
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                    inside = not inside
        if inside:
            return 1
    return -1


def _pieces(s: Shape, other: Shape) -> list[Point]:
    """Vertices of s and the middles of its edges where the other's border cuts them."""
    out = vertices(s)
    for a, b in _edges(s):
        cuts = [0.0, 1.0]
        for c, d in _edges(other):
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if abs(den) > EPS:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / den
                if 0 <= t <= 1 and -EPS <= u <= 1 + EPS:
                    cuts.append(t)
        cuts.sort()
        for t0, t1 in zip(cuts, cuts[1:]):
            t = (t0 + t1) / 2
            out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return out


def _interior_points(s: Shape, other: Shape) -> list[Point]:
    """Points that stand for the inside of s with respect to the other's borders."""
    if s[0] < 2:
        return _pieces(s, other)
    xs = sorted({p[0] for p in _pieces(s, other) + vertices(other)})
    out = []
    for x0, x1 in zip(xs, xs[1:]):
        x = (x0 + x1) / 2
        ys = sorted(y1 + (x - ax) * (by - y1) / (bx - ax) for (ax, y1), (bx, by) in _edges(s) + _edges(other) if (ax - x) * (bx - x) < 0)
        out += [(x, (y0 + y2) / 2) for y0, y2 in zip(ys, ys[1:]) if locate((x, (y0 + y2) / 2), s) == 1]
    return out


def intersects(a: Shape, b: Shape) -> bool:
    return any(locate(p, b) >= 0 for p in _pieces(a, b)) or any(locate(p, a) >= 0 for p in _pieces(b, a))


def covers(a: Shape, b: Shape) -> bool:
    """No point of b lies outside a."""
    return all(locate(p, a) >= 0 for p in _pieces(b, a)) and all(locate(p, a) >= 0 for p in _interior_points(b, a))


def _inner(p: Point, s: Shape) -> bool:
    where = locate(p, s)
    return where == 1 if s[0] == 2 else where == 0


def contains(a: Shape, b: Shape) -> bool:
    """a covers b, and not only by its border."""
    return covers(a, b) and any(_inner(p, a) for p in _interior_points(b, a))


def _share_inside(a: Shape, b: Shape) -> bool:
    return any(_inner(p, b) for p in _interior_points(a, b)) or any(_inner(p, a) for p in _interior_points(b, a))


def crosses(a: Shape, b: Shape) -> bool:
    if a[0] > b[0]:
        return crosses(b, a)
    if a[0] == b[0]:
        return a[0] == 1 and intersects(a, b) and not covers(a, b) and not covers(b, a)
    return any(_inner(p, b) for p in _interior_points(a, b)) and not covers(b, a)


def overlaps(a: Shape, b: Shape) -> bool:
    return a[0] == b[0] and _share_inside(a, b) and not covers(a, b) and not covers(b, a)


def relate(name: str, value: str | None, other: Shape) -> bool:
    """Whether the value has the relation to the other shape; text that isn't a shape has none."""
    if not value:
        return False
    try:
        s = parse(value)
    except (ValueError, IndexError):
        return False
    tests = {"contains": lambda: contains(s, other), "covers": lambda: covers(s, other), "covered_by": lambda: covers(other, s), "within": lambda: contains(other, s),
             "crosses": lambda: crosses(s, other), "intersects": lambda: intersects(s, other), "overlaps": lambda: overlaps(s, other)}
    return bool(tests[name]())
