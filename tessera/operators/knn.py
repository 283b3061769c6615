"""Nearest neighbours: of one point (a top-k), and of many (a join within radii that follow density)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.errors import SpatialError
from tessera.functions import geometry
from tessera.functions.metrics import Metric, box_columns, metric_of
from tessera.functions.predicates import bbox_intersects
from tessera.operators import grid
from tessera.operators.join import candidates
from tessera.plans.tables import Written
from tessera.sources.frame import BOX, SpatialFrame


def top(df: DataFrame, k: int | None, most: float | None) -> DataFrame:
    """By (distance, id); without k everything, in order. Planned as a top-k, never a full sort of all."""
    if k is not None and k < 1:
        raise SpatialError("k is at least 1; None means all")
    if most is not None:
        df = df.where(F.col("distance") <= F.lit(float(most)))
    df = df.orderBy("distance", "id")
    return df if k is None else df.limit(k)


def neighbours(data: SpatialFrame, x: float, y: float, k: int | None = None, max_distance: float | None = None, metric: str | Metric = "planar_sq") -> DataFrame:
    """The frame's columns and ``distance``, nearest first, ties by id.

    ``max_distance`` also becomes a box that reaches the scan, under haversine a band of latitudes.
    Under ``planar_sq`` it bounds the square itself. Without it the metric's own bound counts.
    """
    m = metric_of(metric)
    max_distance = bound_of(m, max_distance)
    df = data.as_boxes().df
    if max_distance is not None and (reach := reach_of(m, y, max_distance)) is not None:
        df = df.where(reach_filter(x, y, *reach))
    return top(df.withColumn("distance", m.distance_to_bbox(F.lit(float(x)), F.lit(float(y)), box_columns())), k, max_distance)


def bound_of(metric: Metric, most: float | None) -> float | None:
    """The caller's bound, or else the metric's own if it has a finite one."""
    if most is not None:
        return most
    own = getattr(metric, "max_distance", lambda: math.inf)()
    return None if own == math.inf else own


def reach_of(metric: Metric, y: float, most: float) -> tuple[float, float] | None:
    """How far along x and along y anything within ``most`` can be; None where nothing is known."""
    found = metric.reach(most)
    if found is None or isinstance(found, tuple):
        # a bound along the meridian holds between the poles only
        return found if found is None or abs(y) <= 90 else None
    return found, found


def reach_filter(x: float, y: float, rx: float, ry: float) -> Column:
    """A box that reaches the scan; without a bound along x it is a band of latitudes."""
    wide = lambda r: r * (1 + 1e-9) + (abs(x) + abs(y)) * 1e-15
    if rx == math.inf:
        beyond = (F.col("min_y") < -90) | (F.col("max_y") > 90)
        return beyond | ((F.col("min_y") <= F.lit(y + wide(ry))) & (F.col("max_y") >= F.lit(y - wide(ry))))
    return bbox_intersects(x - wide(rx), y - wide(ry), x + wide(rx), y + wide(ry))


def neighbours_coord(data: SpatialFrame, coord: tuple[float, float], **how) -> DataFrame:
    return neighbours(data, *coord, **how)


def with_geometry(df: DataFrame, geometries: DataFrame, column: str = "geometry") -> DataFrame:
    """Rows with the geometry that another table holds under their id; null where it holds none."""
    return df.join(geometries.select("id", column), "id", "left")


def neighbours_geometry(df: DataFrame, query: Column, k: int | None = None, max_distance: float | None = None, metric: str | Metric = "euclidean", column: str = "geometry") -> DataFrame:
    """By the distance between geometries; rows without one are as far as the metric goes."""
    m = metric_of(metric)
    own = getattr(m, "max_distance", lambda: math.inf)()
    far = F.coalesce(m.distance_to_geometry(F.col(column), query), F.lit(own))
    return top(df.withColumn("distance", far), k, max_distance)


#: Halvings of the extent down to the finest cells in which boxes are counted.
FINEST = 20
#: Down to here the cells are few enough (5,461) to send them to all executors.
COARSE = 6


def knn_join(queries: SpatialFrame, data: SpatialFrame, k: int, max_distance: float | None = None) -> DataFrame:
    """query_id, rank, id, distance: for every query point its k nearest boxes (Euclidean), ties by id.

    Exact, in three steps. Boxes are counted in cells of every size, from the whole extent to a
    millionth of its side (one aggregation with map-side combine). A query's radius is the diagonal
    of the smallest cell around it that holds k boxes: its k nearest are no farther, whatever the
    density where it lies. Then the squares of that radius meet the boxes in a join on the grid, and
    a top-k follows. Equal queries are asked once, and of equal boxes the k smallest ids are enough,
    so a point shared by a third of all rows is one query or k boxes.

    Fewer than k boxes give all; ``max_distance`` is a bound (closed). Infinite coordinates are
    refused, as are inverted boxes. The extents are taken (one job a side) when this is called.
    """
    if k < 1:
        raise SpatialError("k is at least 1")
    spark = data.df.sparkSession
    save = Written(spark)
    given = queries.df.select(F.col("id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    points = given.select("qx", "qy").distinct()
    alike = Window.partitionBy(*BOX).orderBy("id")
    boxes = data.as_boxes().df.select("id", *BOX)
    boxes = save(boxes.withColumn("rank", F.row_number().over(alike)).where(F.col("rank") <= k).drop("rank"))
    sizes = grid.upright(grid.sizes_of(boxes), "data")
    asked = grid.sizes_of(points.select(*[F.col(c).alias(n) for c, n in zip(("qx", "qy", "qx", "qy"), BOX, strict=True)]))
    if sizes.endless or asked.endless:
        raise SpatialError("a neighbour join takes finite coordinates only")
    if not sizes.n or not asked.n:
        empty = given.select("query_id", F.lit(0).alias("rank")).join(boxes.select("id", F.lit(0.0).alias("distance")).limit(0))
        return empty.select("query_id", "rank", "id", "distance").limit(0)
    x0, y0 = min(sizes.extent[0], asked.extent[0]), min(sizes.extent[1], asked.extent[1])
    span = max(max(sizes.extent[2], asked.extent[2]) - x0, max(sizes.extent[3], asked.extent[3]) - y0) or 1.0

    def cells(x: str, y: str, low: int, high: int) -> Column:
        """The cells of a place at the levels low to high, as numbers."""
        cx, cy = (F.least(F.floor((F.col(c) - o) / F.lit(span) * F.lit(float(1 << FINEST))), F.lit((1 << FINEST) - 1)).cast("long") for c, o in ((x, x0), (y, y0)))
        at = lambda level: F.lit(level << 2 * FINEST) + F.shiftleft(F.shiftright(cx, FINEST - level), FINEST) + F.shiftright(cy, FINEST - level)
        return F.explode(F.array(*[at(level) for level in range(low, high + 1)]))

    counts = boxes.select(cells("min_x", "min_y", 0, FINEST).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    dense = save(counts.where(F.col("n") >= k).select("cell"))
    coarse = points.select("qx", "qy", cells("qx", "qy", 0, COARSE).alias("cell")).join(F.broadcast(dense.where(F.col("cell") < (COARSE + 1) << 2 * FINEST)), "cell")
    fine = points.select("qx", "qy", cells("qx", "qy", COARSE + 1, FINEST).alias("cell")).join(dense, "cell")
    level = F.shiftright(F.max("cell"), 2 * FINEST)
    known = coarse.unionByName(fine).groupBy("qx", "qy").agg(level.alias("level"))
    # without k boxes in all, the radius reaches everything
    reach = F.coalesce(F.lit(math.sqrt(2.0) * span) / F.pow(F.lit(2.0), F.col("level")), F.lit(2.0 * span))
    if max_distance is not None:
        reach = F.least(reach, F.lit(float(max_distance)))
    wide = reach * (1 + 1e-9) + (F.abs("qx") + F.abs("qy")) * 1e-12
    squares = points.join(known, ["qx", "qy"], "left").withColumn("reach", wide)
    squares = squares.select("qx", "qy", *[(F.col(c) + F.col("reach") * by).alias(n) for c, by, n in zip(("qx", "qy", "qx", "qy"), (-1, -1, 1, 1), BOX, strict=True)])
    distance = metric_of("euclidean").distance_to_bbox(F.col("l.qx"), F.col("l.qy"), box_columns("r"))
    hits = candidates(save(squares), boxes).select("l.qx", "l.qy", "r.id", distance.alias("distance"))
    if max_distance is not None:
        hits = hits.where(F.col("distance") <= F.lit(float(max_distance)))
    near = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qx", "qy").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return given.join(near, ["qx", "qy"]).select("query_id", "rank", "id", "distance")
