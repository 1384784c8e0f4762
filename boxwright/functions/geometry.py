"""Geometry of axis-aligned boxes and points as column expressions.

Boxes are flat columns (min_x, min_y, max_x, max_y), so that scans keep their
statistics; ``Box`` names the four of them.  All predicates are closed: boxes
that touch intersect.  Expressions keep the type of the coordinates, float or
double.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    min_x: Column
    min_y: Column
    max_x: Column
    max_y: Column


class Point(NamedTuple):
    x: Column
    y: Column


def box(prefix: str = "") -> Box:
    """The box columns of the current row; ``prefix`` is an alias with its dot
    or the beginning of the names."""
    return Box(*(F.col(prefix + c) for c in Box._fields))


def point(prefix: str = "") -> Point:
    return Point(F.col(prefix + "x"), F.col(prefix + "y"))


def make_box(min_x: float, min_y: float, max_x: float, max_y: float, kind: str = "double") -> Box:
    """A box of literals; ``kind`` is double or float."""
    return Box(*(F.lit(float(v)).cast(kind) for v in (min_x, min_y, max_x, max_y)))


def make_point(x: float, y: float, kind: str = "double") -> Point:
    return Point(F.lit(float(x)).cast(kind), F.lit(float(y)).cast(kind))


def box_struct(b: Box, id_: Column | None = None) -> Column:
    """A box as one struct value, with id 0 unless one is given."""
    return F.struct((F.lit(0) if id_ is None else id_).cast("bigint").alias("id"), *(c.alias(n) for n, c in zip(Box._fields, b, strict=True)))


def intersects(a: Box, b: Box) -> Column:
    return (a.max_x >= b.min_x) & (a.min_x <= b.max_x) & (a.max_y >= b.min_y) & (a.min_y <= b.max_y)


def contains(outer: Box, inner: Box) -> Column:
    return (outer.min_x <= inner.min_x) & (outer.max_x >= inner.max_x) & (outer.min_y <= inner.min_y) & (outer.max_y >= inner.max_y)


def strictly_inside(p: Point, b: Box) -> Column:
    """Whether a point lies in the interior; points on an edge do not."""
    return (p.x > b.min_x) & (p.x < b.max_x) & (p.y > b.min_y) & (p.y < b.max_y)


def edge_overlaps(a: Box, b: Box) -> Column:
    """Whether any edge coordinate equals the same one of the other box."""
    return (a.min_x == b.min_x) | (a.max_x == b.max_x) | (a.min_y == b.min_y) | (a.max_y == b.max_y)


def equals(a: Box, b: Box) -> Column:
    return (a.min_x == b.min_x) & (a.max_x == b.max_x) & (a.min_y == b.min_y) & (a.max_y == b.max_y)


def distance_sq(b: Box, p: Point) -> Column:
    """Squared distance from a point to a box, 0 inside and on the edge."""
    zero = F.lit(0).cast("float")  # widens to double, if they are
    dx = F.greatest(b.min_x - p.x, p.x - b.max_x, zero)
    dy = F.greatest(b.min_y - p.y, p.y - b.max_y, zero)
    return dx * dx + dy * dy


def distance(b: Box, p: Point) -> Column:
    return F.sqrt(distance_sq(b, p))


def farthest_sq(b: Box, p: Point) -> Column:
    """Squared distance from a point to the farthest point of a box."""
    dx = F.greatest(F.abs(p.x - b.min_x), F.abs(p.x - b.max_x))
    dy = F.greatest(F.abs(p.y - b.min_y), F.abs(p.y - b.max_y))
    return dx * dx + dy * dy


def width(b: Box) -> Column:
    return b.max_x - b.min_x


def height(b: Box) -> Column:
    return b.max_y - b.min_y


def area(b: Box) -> Column:
    return width(b) * height(b)


def aspect_ratio(b: Box) -> Column:
    """Width by height as IEEE has it: infinite or NaN without height."""
    w, h = width(b).cast("double"), height(b).cast("double")
    flat = F.when(w > 0, float("inf")).when(w < 0, float("-inf")).otherwise(float("nan"))
    return F.when(h != 0, F.try_divide(w, h)).otherwise(flat)


def center(b: Box) -> Point:
    half = lambda low, high: (low + high) / 2
    return Point(half(b.min_x, b.max_x), half(b.min_y, b.max_y))


def box_text(b: Box) -> Column:
    return F.format_string("(%.6f, %.6f, %.6f, %.6f)", *(c.cast("double") for c in b))


def point_text(p: Point) -> Column:
    return F.format_string("(%.6f,%.6f)", p.x.cast("double"), p.y.cast("double"))


def is_valid(b: Box) -> Column:
    """Finite coordinates, minimum not above maximum; false for nulls."""
    finite = None
    for c in b:
        one = (F.abs(c) < float("inf")) & ~F.isnan(c)
        finite = one if finite is None else finite & one
    return F.coalesce(finite & (b.min_x <= b.max_x) & (b.min_y <= b.max_y), F.lit(False))


def normalized(b: Box) -> Box:
    return Box(F.least(b.min_x, b.max_x), F.least(b.min_y, b.max_y), F.greatest(b.min_x, b.max_x), F.greatest(b.min_y, b.max_y))
