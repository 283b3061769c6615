"""Distance metrics for nearest-neighbour search; a metric's methods return Columns."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.functions.predicates import axis_dist, sq_dist

MIN_X, MIN_Y, MAX_X, MAX_Y = "min_x", "min_y", "max_x", "max_y"


class Metric(Protocol):
    """What a caller's own metric must have. It may also have ``max_distance()``, the bound and the
    distance of a missing geometry where the caller gives none (else: infinite)."""

    def distance(self, x1: Column, y1: Column, x2: Column, y2: Column) -> Column: ...

    def distance_to_bbox(self, x: Column, y: Column, box: dict[str, Column]) -> Column: ...

    def distance_to_geometry(self, one: Column, other: Column) -> Column: ...

    def reach(self, most: float) -> float | tuple[float, float] | None:
        """Distance along either axis, or along x and y, beyond which nothing is within ``most``;
        None where no box bounds it."""
        ...


def box_columns(side: str = "") -> dict[str, Column]:
    return {n: F.col(f"{side}.{n}" if side else n) for n in (MIN_X, MIN_Y, MAX_X, MAX_Y)}


class PlanarSquared:
    """Squared distance; a bound is compared with the square, as it stands."""

    def distance(self, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return sq_dist(x1, y1, x2, y2)

    def distance_to_bbox(self, x: Column, y: Column, box: dict[str, Column]) -> Column:
        dx, dy = axis_dist(x, box[MIN_X], box[MAX_X]), axis_dist(y, box[MIN_Y], box[MAX_Y])
        return dx * dx + dy * dy

    def distance_to_geometry(self, one: Column, other: Column) -> Column:
        d = geometry.planar_distance(one, other)
        return d * d

    def reach(self, most: float) -> float | None:
        return max(most, 0.0) ** 0.5


class Euclidean(PlanarSquared):
    def distance(self, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return F.sqrt(sq_dist(x1, y1, x2, y2))

    def distance_to_bbox(self, x: Column, y: Column, box: dict[str, Column]) -> Column:
        return F.sqrt(super().distance_to_bbox(x, y, box))

    def distance_to_geometry(self, one: Column, other: Column) -> Column:
        return geometry.planar_distance(one, other)

    def reach(self, most: float) -> float | None:
        return max(most, 0.0)


#: Mean radius of the Earth in metres: a fixed value that distances must agree on.
EARTH = 6371008.8


class Haversine:
    """Great-circle metres between longitudes and latitudes in degrees.

    A box's nearest point is found by clamping, without a wrap at the antimeridian; every row is
    measured, so order and bounds are exact for that distance.
    """

    def __init__(self, radius: float = EARTH):
        self.radius = radius

    def distance(self, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        a = F.pow(F.sin((F.radians(y2) - F.radians(y1)) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin((F.radians(x2) - F.radians(x1)) / 2), 2)
        return F.lit(2 * self.radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))

    def distance_to_bbox(self, x: Column, y: Column, box: dict[str, Column]) -> Column:
        near_x = F.when(x < box[MIN_X], box[MIN_X]).when(x > box[MAX_X], box[MAX_X]).otherwise(x)
        near_y = F.when(y < box[MIN_Y], box[MIN_Y]).when(y > box[MAX_Y], box[MAX_Y]).otherwise(y)
        return self.distance(x, y, near_x, near_y)

    def distance_to_geometry(self, one: Column, other: Column) -> Column:
        """Between centroids; a geometry without one counts as (0, 0)."""
        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        a, b = F.coalesce(geometry.centroid(one), zero), F.coalesce(geometry.centroid(other), zero)
        return self.distance(a["x"], a["y"], b["x"], b["y"])

    def reach(self, most: float) -> float | tuple[float, float] | None:
        """A great circle is no shorter than its difference of latitudes; longitudes bound nothing."""
        return math.inf, math.degrees(max(most, 0.0) / self.radius) * (1 + 1e-9)


METRICS = {"planar_sq": PlanarSquared, "euclidean": Euclidean, "haversine": Haversine}


def metric_of(metric: str | Metric) -> Metric:
    return METRICS[metric]() if isinstance(metric, str) else metric
