"""Box and point predicates and distances between numbers, as Columns that Catalyst can push down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import SpatialError


def col(name: str, side: str = "") -> Column:
    return F.col(f"{side}.{name}" if side else name)


def bbox_intersects(min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """Closed: boxes that touch intersect. On stored columns all four tests reach the scan."""
    return (F.col("min_x") <= F.lit(float(max_x))) & (F.col("min_y") <= F.lit(float(max_y))) & (F.col("max_x") >= F.lit(float(min_x))) & (F.col("max_y") >= F.lit(float(min_y)))


def bboxes_intersect(left: str, right: str) -> Column:
    """The same between two sides of a join."""
    a, b = (lambda n: F.col(f"{left}.{n}")), (lambda n: F.col(f"{right}.{n}"))
    return (a("min_x") <= b("max_x")) & (a("min_y") <= b("max_y")) & (a("max_x") >= b("min_x")) & (a("max_y") >= b("min_y"))


def point_in_box(min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    return F.col("x").between(float(min_x), float(max_x)) & F.col("y").between(float(min_y), float(max_y))


def sq_dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return dx * dx + dy * dy


def within_radius(x: float, y: float, radius: float) -> Column:
    """Closed circle. A box a little wider than the circle goes first: it can be pushed down."""
    if radius < 0:
        raise SpatialError(f"radius {radius} is negative")
    wide = radius * (1 + 1e-12) + abs(x) * 1e-15 + abs(y) * 1e-15
    near = point_in_box(x - wide, y - wide, x + wide, y + wide)
    return near & (sq_dist(F.col("x"), F.col("y"), F.lit(float(x)), F.lit(float(y))) <= F.lit(float(radius) ** 2))


def axis_dist(k: Column | float, low: Column, high: Column) -> Column:
    """From a number to an interval; 0 inside of it."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.when(k < low, low - k).when(k > high, k - high).otherwise(F.lit(0.0))
