"""Box, point and radius search: plain filters on stored columns, so that scans can skip row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.errors import SpatialError
from tessera.functions.predicates import bbox_intersects, point_in_box, within_radius
from tessera.sources.frame import SpatialFrame


def out(df: DataFrame, ids_only: bool, ordered: bool) -> DataFrame:
    df = df.select("id") if ids_only else df
    return df.orderBy("id") if ordered else df


def search(data: SpatialFrame, min_x: float, min_y: float, max_x: float, max_y: float, ids_only: bool = True, ordered: bool = False) -> DataFrame:
    """Boxes that meet the closed query box; an empty frame gives no rows. A set: unordered unless asked."""
    return out(data.as_boxes().df.where(bbox_intersects(min_x, min_y, max_x, max_y)), ids_only, ordered)


def search_point(data: SpatialFrame, x: float, y: float, ids_only: bool = True, ordered: bool = False) -> DataFrame:
    return search(data, x, y, x, y, ids_only, ordered)


def need_points(data: SpatialFrame) -> None:
    if not data.is_points:
        raise SpatialError("this query is for points")


def range_search(data: SpatialFrame, min_x: float, min_y: float, max_x: float, max_y: float, ids_only: bool = True, ordered: bool = False) -> DataFrame:
    """Points in the closed box."""
    need_points(data)
    return out(data.df.where(point_in_box(min_x, min_y, max_x, max_y)), ids_only, ordered)


def within(data: SpatialFrame, x: float, y: float, radius: float, ids_only: bool = True, ordered: bool = False) -> DataFrame:
    """Points at most ``radius`` away; a negative radius is an error."""
    need_points(data)
    return out(data.df.where(within_radius(x, y, radius)), ids_only, ordered)


def search_rect(data: SpatialFrame, rect: tuple[float, float, float, float], **how) -> DataFrame:
    """The same for a box as one value: (min_x, min_y, max_x, max_y)."""
    return search(data, *rect, **how)


def range_rect(data: SpatialFrame, rect: tuple[float, float, float, float], **how) -> DataFrame:
    return range_search(data, *rect, **how)


def within_coord(data: SpatialFrame, coord: tuple[float, float], radius: float, **how) -> DataFrame:
    return within(data, *coord, radius, **how)
