"""Plane geometry as column expressions. A point is a pair of columns (x, y)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def distance(a: Point, b: Point) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def segment_distance(p: Point, a: Point, b: Point) -> Column:
    """To the segment from a to b; to a where they coincide."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = clamp(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square, 0, 1)
    return F.when(square < 1e-18, distance(p, a)).otherwise(F.hypot(p[0] - (a[0] + t * dx), p[1] - (a[1] + t * dy)))


def _cross(o: Point, a: Point, b: Point) -> Column:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def in_triangle(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Inside a triangle that has an area, sides included."""
    d1, d2, d3 = _cross(a, b, p), _cross(b, c, p), _cross(c, a, p)
    return (F.abs(_cross(a, b, c)) > 1e-12) & ~(((d1 < 0) | (d2 < 0) | (d3 < 0)) & ((d1 > 0) | (d2 > 0) | (d3 > 0)))


def hull_distance(p: Point, points: list[Point]) -> Column:
    """Distance to the convex hull of up to four points, absent ones null; null if all are absent.

    Zero in any triangle of the points, else the least distance to a point or to the line between two."""
    there = [q[0].isNotNull() & q[1].isNotNull() for q in points]
    near = [F.when(t, distance(p, q)) for t, q in zip(there, points, strict=True)]
    near += [F.when(there[i] & there[j], segment_distance(p, points[i], points[j])) for i, j in combinations(range(len(points)), 2)]
    inside = F.lit(False)
    for i, j, k in combinations(range(len(points)), 3):
        inside = inside | F.coalesce(there[i] & there[j] & there[k] & in_triangle(p, points[i], points[j], points[k]), F.lit(False))
    return F.when(inside, 0.0).otherwise(F.least(*near))


def hull_vertices(points: Column) -> Column:
    """Of an array of up to four points (x, y): distinct ones that lie in no triangle of the others."""
    points = F.array_distinct(points)
    pair = lambda q: (q["x"], q["y"])

    def keeps(q: Column) -> Column:
        rest = F.filter(points, lambda r: r != q)
        a, b, c = (F.get(rest, F.lit(i)) for i in range(3))
        return (F.size(rest) < 3) | ~in_triangle(pair(q), pair(a), pair(b), pair(c))

    return F.filter(points, keeps)


def point_in_polygon(p: Point, polygon: Column) -> Column:
    """Ray casting over an ordered array of (x, y); false for fewer than three."""
    turned = F.concat(F.slice(polygon, -1, 1), F.slice(polygon, 1, F.greatest(F.size(polygon) - 1, F.lit(0))))
    crosses = lambda a, b: ((a["y"] > p[1]) != (b["y"] > p[1])) & (p[0] < (b["x"] - a["x"]) * (p[1] - a["y"]) / (b["y"] - a["y"]) + a["x"])
    flips = F.zip_with(polygon, turned, lambda a, b: F.coalesce(crosses(a, b), F.lit(False)).cast("int"))
    return (F.size(polygon) >= 3) & (F.aggregate(flips, F.lit(0), lambda s, x: s + x) % 2 == 1)
