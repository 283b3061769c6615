"""One query for each operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.functions.curve import hilbert_of
from tessera.functions.metrics import EARTH, Euclidean, Haversine, box_columns
from tessera.functions.predicates import axis_dist, bbox_intersects, sq_dist
from tessera.operators import cluster, join, kd, knn, meta, search
from tessera.plans.tables import VIEWS, view
from tessera.sources import buffer
from tessera.sources.frame import BOX, SpatialFrame, boxes, extent, points
from tessera.streaming.search import drained, stream_static_join

Query = Callable[[SparkSession, str], DataFrame]
#: The queries' constants: a box, a point and a radius within the views' extents.
QUERY_BOX = (40.0, 100.0, 130.0, 250.0)
AT = (61.0, 203.0)
RADIUS = 40.0
ALSO = (90.0, 203.0)
LONLAT = (-74.0, 40.7)


def orders(spark: SparkSession, sf: str, node_size: int = 16) -> SpatialFrame:
    return boxes(view(spark, sf, "boxes_orders"), node_size=node_size)


def parts(spark: SparkSession, sf: str) -> SpatialFrame:
    return boxes(view(spark, sf, "boxes_part"))


def order_points(spark: SparkSession, sf: str) -> SpatialFrame:
    return points(view(spark, sf, "pts_orders"))


def customers(spark: SparkSession, sf: str) -> SpatialFrame:
    return boxes(view(spark, sf, "lonlat_customer"), ["lon", "lat", "lon", "lat"])


def ranked(df: DataFrame, digits: int) -> DataFrame:
    return df.select("id", F.round("distance", digits).alias("distance"))


def shapes(df: DataFrame) -> DataFrame:
    """A third of the orders as points, a third as level lines, a third as squares."""
    x, y = F.col("min_x"), F.col("min_y")
    far = F.lit(2.0)
    shape = (
        F.when(F.col("id") % 3 == 0, geometry.point(x, y))
        .when(F.col("id") % 3 == 1, geometry.line(geometry.vertex(x, y), geometry.vertex(x + far, y)))
        .otherwise(geometry.polygon(geometry.vertex(x, y), geometry.vertex(x + far, y), geometry.vertex(x + far, y + far), geometry.vertex(x, y + far)))
    )
    return df.select("id", shape.alias("geometry"))


def many_shapes(df: DataFrame) -> DataFrame:
    """A third of the orders as two points, a third as two squares, a third as a point and a level line."""
    x, y = F.col("min_x"), F.col("min_y")

    def square(at: Column) -> Column:
        return geometry.polygon(geometry.vertex(at, y), geometry.vertex(at + 2.0, y), geometry.vertex(at + 2.0, y + 2.0), geometry.vertex(at, y + 2.0))

    shape = (
        F.when(F.col("id") % 3 == 0, geometry.collection(geometry.point(x, y), geometry.point(x + 3.0, y + 1.0)))
        .when(F.col("id") % 3 == 1, geometry.collection(square(x), square(x + 5.0)))
        .otherwise(geometry.collection(geometry.point(x, y), geometry.line(geometry.vertex(x + 1.0, y + 1.0), geometry.vertex(x + 4.0, y + 1.0))))
    )
    return df.select("id", shape.alias("geometry"))


def narrow(spark: SparkSession, sf: str) -> DataFrame:
    """What comes back from a buffer of 32-bit floats."""
    return buffer.decode_rtree(spark, buffer.rtree_pieces(numbered(orders(spark, sf)), coord_type="float32")).drop("pos")


def kd_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The k-d tree's nodes, and how many children of the root's left and right each is."""
    nodes = kd.kd_traversal(order_points(spark, sf))
    ids = F.coalesce(F.array_join("leaf_ids", ","), F.lit(""))
    return nodes.fillna(-1, ["middle_id", "left_lo", "left_hi", "right_lo", "right_hi"]).select("lo", "hi", "axis", "middle_id", "left_lo", "left_hi", "right_lo", "right_hi", ids.alias("leaf_ids"))


def top_children(spark: SparkSession, sf: str) -> DataFrame:
    """The children of the tree's root."""
    nodes = cluster.tree_nodes(orders(spark, sf))
    return cluster.children(nodes, cluster.root(nodes)).select("level", "pos", "parent_pos", *BOX)


def boxed(df: DataFrame) -> DataFrame:
    return df.select("id", *[F.round(F.col(f"box.{c}"), 6).alias(c) for c in BOX])


def lonlat_points(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "lonlat_customer").select("id", geometry.point(F.col("lon"), F.col("lat")).alias("geometry"))


def numbered(data: SpatialFrame) -> SpatialFrame:
    """The frame with insertion indexes for ids, as buffers hold them."""
    df = cluster.insertion_index(data.df).drop("id").withColumnRenamed("insertion_index", "id")
    return SpatialFrame(df.select("id", *data.roles), data.roles, data.node_size)


def stream_within(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    located = stream.select(F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    return drained(spark, search.within(points(located), 50.0, 50.0, 30.0), "within")


def stream_join(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    located = stream.select(F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    return drained(spark, stream_static_join(points(located), parts(spark, sf)), "join")


def queries() -> dict[str, Query]:
    at = lambda df, m, *k: ranked(knn.neighbours(df, *AT, *k, metric=m), 6)
    return {
        "index_extent": lambda s, d: extent(orders(s, d)),
        "insertion_index": lambda s, d: cluster.insertion_index(view(s, d, "boxes_orders")).select("id", "insertion_index"),
        "bbox_search": lambda s, d: search.search(orders(s, d), *QUERY_BOX),
        "point_search": lambda s, d: search.search_point(orders(s, d), *AT),
        "kd_range": lambda s, d: search.range_search(order_points(s, d), *QUERY_BOX),
        "kd_within": lambda s, d: search.within(order_points(s, d), *AT, RADIUS),
        "bbox_intersects": lambda s, d: orders(s, d).df.select("id", bbox_intersects(*QUERY_BOX).alias("hit")),
        "axis_dist": lambda s, d: orders(s, d).df.select("id", F.round(axis_dist(AT[0], F.col("min_x"), F.col("max_x")), 6).alias("dx"), F.round(axis_dist(AT[1], F.col("min_y"), F.col("max_y")), 6).alias("dy")),
        "knn_planar": lambda s, d: at(orders(s, d), "planar_sq", 25),
        "knn_planar_maxdist": lambda s, d: at(orders(s, d), "planar_sq", None, 30.0),
        "knn_euclid": lambda s, d: at(orders(s, d), "euclidean", 25),
        "knn_euclid_maxdist": lambda s, d: at(orders(s, d), "euclidean", None, 30.0),
        "knn_haversine": lambda s, d: ranked(knn.neighbours(customers(s, d), *LONLAT, 25, metric="haversine"), 3),
        "knn_geometry": lambda s, d: ranked(knn.neighbours_geometry(shapes(orders(s, d).df), geometry.point(*AT), 25), 6),
        "knn_geometry_multi": lambda s, d: ranked(knn.neighbours_geometry(many_shapes(orders(s, d).df), geometry.collection(geometry.point(*AT), geometry.point(*ALSO)), 40), 6),
        "knn_join": lambda s, d: knn.knn_join(points(view(s, d, "pts_orders").where("id % 50 = 0")), orders(s, d), 5).select("query_id", "rank", "id", F.round("distance", 6).alias("distance")),
        "dist_euclid": lambda s, d: orders(s, d).df.select("id", F.round(Euclidean().distance_to_bbox(F.lit(AT[0]), F.lit(AT[1]), box_columns()), 6).alias("distance")),
        "dist_haversine": lambda s, d: customers(s, d).df.select("id", F.round(Haversine().distance_to_bbox(F.lit(LONLAT[0]), F.lit(LONLAT[1]), box_columns()), 3).alias("distance")),
        "tree_join": lambda s, d: join.tree_join(orders(s, d), parts(s, d)),
        "tree_self_join": lambda s, d: join.self_join(orders(s, d)),
        "join_semi": lambda s, d: join.semi(orders(s, d), parts(s, d)).select("id"),
        "join_anti": lambda s, d: join.anti(orders(s, d), parts(s, d)).select("id"),
        "hilbert_key": lambda s, d: hilbert_of(orders(s, d)).select("id", "key"),
        "hilbert_partitions": lambda s, d: cluster.partitions(orders(s, d)),
        "str_partitions": lambda s, d: cluster.partitions(orders(s, d), "str"),
        "partition_boxes": lambda s, d: cluster.partition_boxes(orders(s, d)),
        "boxes_at_level_0": lambda s, d: cluster.boxes_at_level(orders(s, d), 0),
        "boxes_at_level_1": lambda s, d: cluster.boxes_at_level(orders(s, d), 1),
        "boxes_at_level_2": lambda s, d: cluster.boxes_at_level(orders(s, d), 2),
        "tree_nodes": lambda s, d: cluster.tree_nodes(orders(s, d)).fillna(-1, ["child_start", "child_end", "id"]),
        "kd_partitions": lambda s, d: kd.kd_partitions(order_points(s, d)),
        "kd_nodes": lambda s, d: kd.kd_nodes(order_points(s, d)).fillna(-1, ["middle_id"]),
        "rtree_metadata": lambda s, d: meta.rtree_metadata(orders(s, d)),
        "kdtree_metadata": lambda s, d: meta.kdtree_metadata(order_points(s, d)),
        "f32_box": lambda s, d: meta.f32_boxes(orders(s, d)).select("id", *[F.col(c).cast("double").alias(c) for c in BOX]),
        "extent_agg": lambda s, d: cluster.around(orders(s, d).df, (F.col("id") % 8).alias("part")),
        "geom_bbox": lambda s, d: boxed(shapes(orders(s, d).df).select("id", geometry.bbox(F.col("geometry")).alias("box"))),
        "knn_geometry_haversine": lambda s, d: ranked(knn.neighbours_geometry(lonlat_points(s, d), geometry.point(*LONLAT), 25, metric="haversine"), 3),
        "rtree_buffer": lambda s, d: buffer.decode_rtree(s, buffer.rtree_pieces(numbered(orders(s, d)))).drop("pos"),
        "kdtree_buffer": lambda s, d: buffer.decode_kdtree(s, buffer.kdtree_pieces(numbered(order_points(s, d)))).drop("pos"),
        "rtree_buffer_f32": narrow,
        "rtree_children": top_children,
        "kd_traversal": kd_walk,
        "within_coord": lambda s, d: search.within_coord(order_points(s, d), AT, RADIUS),
        "range_rect": lambda s, d: search.range_rect(order_points(s, d), QUERY_BOX),
        "search_rect": lambda s, d: search.search_rect(orders(s, d), QUERY_BOX, ids_only=False),
        "sq_dist": lambda s, d: order_points(s, d).df.select("id", F.round(sq_dist(F.col("x"), F.col("y"), F.lit(AT[0]), F.lit(AT[1])), 6).alias("distance")),
        "knn_haversine_maxdist": lambda s, d: ranked(knn.neighbours(customers(s, d), *LONLAT, None, 2e6, metric="haversine"), 3),
        "join_refined": lambda s, d: join.refined(orders(s, d), parts(s, d), F.col("l.max_x") - F.col("r.min_x") >= 1),
        "stream_within": stream_within,
        "stream_join": stream_join,
    }


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(orders(spark, sf_dir), *QUERY_BOX, ids_only=False)


def with_views(sql: str, *more: str) -> str:
    """The SQL over those views that it names; ``more``: further CTEs."""
    used = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in sql or any(name in m for m in more)]
    return "WITH RECURSIVE " + ", ".join([*used, *more]) + " " + sql if used or more else sql


def near(k: int | None, most: float | None, distance: str, source: str, digits: int) -> str:
    where = f"WHERE d <= {most}" if most is not None else ""
    limit = f"LIMIT {k}" if k else ""
    return with_views(f"SELECT id, round(d, {digits}) AS distance FROM (SELECT id, {distance} AS d FROM {source}) {where} ORDER BY d, id {limit}")


def clamp(k: float, low: str, high: str) -> str:
    return f"CASE WHEN {k} < {low} THEN {low} - {k} WHEN {k} > {high} THEN {k} - {high} ELSE 0.0 END"


DX, DY = clamp(AT[0], "min_x", "max_x"), clamp(AT[1], "min_y", "max_y")
SQ = f"(({DX}) * ({DX}) + ({DY}) * ({DY}))"
HAVERSINE = (
    f"{2 * EARTH} * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians({LONLAT[1]})) / 2), 2) + "
    f"cos(radians({LONLAT[1]})) * cos(radians(lat)) * pow(sin((radians(lon) - radians({LONLAT[0]})) / 2), 2))))"
)
MEET = "l.min_x <= r.max_x AND l.min_y <= r.max_y AND l.max_x >= r.min_x AND l.max_y >= r.min_y"
IN_BOX = f"min_x <= {QUERY_BOX[2]} AND min_y <= {QUERY_BOX[3]} AND max_x >= {QUERY_BOX[0]} AND max_y >= {QUERY_BOX[1]}"


def hilbert_ctes() -> list[str]:
    """h: id, box, key, by sixteen steps of the textbook curve."""
    ctes = [
        "e AS (SELECT min(min_x) AS ex, min(min_y) AS ey, max(max_x) - min(min_x) AS ew, max(max_y) - min(min_y) AS eh FROM boxes_orders)",
        """h16 AS (SELECT id, min_x, min_y, max_x, max_y, 0::BIGINT AS k,
            CASE WHEN ew > 0 THEN floor(65535.0 * ((min_x + max_x) / 2 - ex) / ew)::BIGINT ELSE 0 END AS cx,
            CASE WHEN eh > 0 THEN floor(65535.0 * ((min_y + max_y) / 2 - ey) / eh)::BIGINT ELSE 0 END AS cy FROM boxes_orders, e)""",
    ]
    for bit in reversed(range(16)):
        rx, ry = f"((cx >> {bit}) & 1)", f"((cy >> {bit}) & 1)"
        flip = f"({ry} = 0 AND {rx} = 1)"
        a, b = f"(CASE WHEN {flip} THEN 65535 - cx ELSE cx END)", f"(CASE WHEN {flip} THEN 65535 - cy ELSE cy END)"
        ctes.append(
            f"h{bit} AS MATERIALIZED (SELECT id, min_x, min_y, max_x, max_y, k + (xor(3 * {rx}, {ry}) << {2 * bit}) AS k, "
            f"CASE WHEN {ry} = 0 THEN {b} ELSE {a} END AS cx, CASE WHEN {ry} = 0 THEN {a} ELSE {b} END AS cy FROM h{bit + 1})"
        )
    ctes.append("p AS (SELECT id, min_x, min_y, max_x, max_y, k AS key, row_number() OVER (ORDER BY k, id) - 1 AS pos FROM h0)")
    return ctes


def on_curve(sql: str) -> str:
    return with_views(sql, *hilbert_ctes())


def around_sql(every: int, name: str = "pos") -> str:
    return on_curve(f"SELECT (pos // {every})::BIGINT AS {name}, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM p GROUP BY 1")


def kd_ctes(node_size: int = 64, steps: int = 24) -> list[str]:
    ctes = ["k0 AS (SELECT id, x, y, 0::BIGINT AS lo, (count(*) OVER ()) - 1 AS hi, 0 AS depth, false AS middle, count(*) OVER () - 1 > 64 AS open FROM pts_orders)"]
    for k in range(steps):
        axis = "y" if k % 2 else "x"
        ctes.append(f"r{k} AS MATERIALIZED (SELECT *, CASE WHEN open THEN lo + row_number() OVER (PARTITION BY open, lo ORDER BY {axis}, id) - 1 END AS pos, (lo + hi) // 2 AS m FROM k{k})")
        ctes.append(
            f"""k{k + 1} AS MATERIALIZED (SELECT id, x, y, CASE WHEN open AND pos > m THEN m + 1 ELSE lo END AS lo, CASE WHEN open AND pos < m THEN m - 1 ELSE hi END AS hi,
            CASE WHEN open AND pos <> m THEN depth + 1 ELSE depth END AS depth, middle OR (open AND pos = m) AS middle,
            open AND pos <> m AND (CASE WHEN pos < m THEN m - 1 ELSE hi END) - (CASE WHEN pos > m THEN m + 1 ELSE lo END) > {node_size} AS open FROM r{k})"""
        )
    ctes.append(f"kd AS (SELECT id, lo::BIGINT AS lo, hi::BIGINT AS hi, depth::INTEGER AS depth, middle FROM k{steps})")
    return ctes


def tree_sql(node_size: int = 16, levels: int = 8) -> str:
    parts_of = ["SELECT 0 AS level, pos, min_x, min_y, max_x, max_y, (-1)::BIGINT AS child_start, (-1)::BIGINT AS child_end, id FROM p"]
    ctes = [*hilbert_ctes(), "n0 AS (SELECT count(*) AS n FROM p)"]
    for k in range(1, levels):
        ctes.append(f"n{k} AS (SELECT CASE WHEN n > 1 THEN (n + {node_size - 1}) // {node_size} ELSE 0 END AS n FROM n{k - 1})")
        parts_of.append(
            f"""SELECT {k}, (pos // {node_size**k})::BIGINT AS q, min(min_x), min(min_y), max(max_x), max(max_y), ((pos // {node_size**k}) * {node_size})::BIGINT,
            least((pos // {node_size**k} + 1) * {node_size}, (SELECT n FROM n{k - 1}))::BIGINT, (-1)::BIGINT FROM p WHERE (SELECT n FROM n{k}) > 0 GROUP BY pos // {node_size**k}"""
        )
    return with_views(" UNION ALL ".join(parts_of), *ctes)


def f32_sql(c: str) -> str:
    near = f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"
    step = f"greatest(abs({near}) * {meta.NUDGE!r}, {meta.LEAST!r})"
    test, moved = (f"{near} > {c}", f"{near} - {step}") if c.startswith("min") else (f"{near} < {c}", f"{near} + {step}")
    return f"CAST(CASE WHEN {test} THEN CAST({moved} AS FLOAT) ELSE CAST({c} AS FLOAT) END AS DOUBLE) AS {c}"


def oracle_sql() -> dict[str, str]:
    shape_dx = f"CASE WHEN id % 3 = 0 THEN abs(min_x - {AT[0]}) ELSE {clamp(AT[0], 'min_x', '(min_x + 2)')} END"
    shape_dy = f"CASE WHEN id % 3 = 2 THEN {clamp(AT[1], 'min_y', '(min_y + 2)')} ELSE abs(min_y - {AT[1]}) END"
    away = lambda at, low, high, y0, y1: f"sqrt(pow({clamp(at[0], low, high)}, 2) + pow({clamp(at[1], y0, y1)}, 2))"
    parts_of = (
        (("min_x", "min_x", "min_y", "min_y"), ("(min_x + 3)", "(min_x + 3)", "(min_y + 1)", "(min_y + 1)")),
        (("min_x", "(min_x + 2)", "min_y", "(min_y + 2)"), ("(min_x + 5)", "(min_x + 7)", "min_y", "(min_y + 2)")),
        (("min_x", "min_x", "min_y", "min_y"), ("(min_x + 1)", "(min_x + 4)", "(min_y + 1)", "(min_y + 1)")),
    )
    multi = "CASE id % 3 " + " ".join(f"WHEN {k} THEN least({', '.join(away(at, *p) for at in (AT, ALSO) for p in two)})" for k, two in enumerate(parts_of)) + " END"
    n = "SELECT count(*) AS n FROM orders"
    levels = ", ".join(f"l{k} AS (SELECT CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 0 END AS n FROM l{k - 1})" for k in range(1, 8))
    every = [f"(SELECT n FROM l{k})" for k in range(8)]
    nodes = " + ".join(every)
    bounds = " || ".join([f"(4 * {every[0]})::VARCHAR"] + [f"(CASE WHEN {every[k]} > 0 THEN ',' || (4 * ({' + '.join(every[: k + 1])}))::VARCHAR ELSE '' END)" for k in range(1, 8)])
    return {
        "index_extent": with_views("SELECT min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM boxes_orders"),
        "insertion_index": with_views("SELECT id, row_number() OVER (ORDER BY id) - 1 AS insertion_index FROM boxes_orders"),
        "bbox_search": with_views(f"SELECT id FROM boxes_orders WHERE {IN_BOX}"),
        "point_search": with_views(f"SELECT id FROM boxes_orders WHERE min_x <= {AT[0]} AND max_x >= {AT[0]} AND min_y <= {AT[1]} AND max_y >= {AT[1]}"),
        "kd_range": with_views(f"SELECT id FROM pts_orders WHERE x BETWEEN {QUERY_BOX[0]} AND {QUERY_BOX[2]} AND y BETWEEN {QUERY_BOX[1]} AND {QUERY_BOX[3]}"),
        "kd_within": with_views(f"SELECT id FROM pts_orders WHERE (x - {AT[0]}) * (x - {AT[0]}) + (y - {AT[1]}) * (y - {AT[1]}) <= {RADIUS**2}"),
        "bbox_intersects": with_views(f"SELECT id, {IN_BOX} AS hit FROM boxes_orders"),
        "axis_dist": with_views(f"SELECT id, round({DX}, 6) AS dx, round({DY}, 6) AS dy FROM boxes_orders"),
        "knn_planar": near(25, None, SQ, "boxes_orders", 6),
        "knn_planar_maxdist": near(None, 30.0, SQ, "boxes_orders", 6),
        "knn_euclid": near(25, None, f"sqrt({SQ})", "boxes_orders", 6),
        "knn_euclid_maxdist": near(None, 30.0, f"sqrt({SQ})", "boxes_orders", 6),
        "knn_haversine": near(25, None, HAVERSINE, "lonlat_customer", 3),
        "knn_geometry": near(25, None, f"sqrt(pow({shape_dx}, 2) + pow({shape_dy}, 2))", "boxes_orders", 6),
        "knn_geometry_multi": near(40, None, multi, "boxes_orders", 6),
        "knn_join": with_views(
            """SELECT query_id, rank::INTEGER AS rank, id, round(d, 6) AS distance FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (
            SELECT q.id AS query_id, b.id, sqrt(pow(greatest(b.min_x - q.x, q.x - b.max_x, 0), 2) + pow(greatest(b.min_y - q.y, q.y - b.max_y, 0), 2)) AS d
            FROM pts_orders q, boxes_orders b WHERE q.id % 50 = 0)) WHERE rank <= 5"""
        ),
        "dist_euclid": with_views(f"SELECT id, round(sqrt({SQ}), 6) AS distance FROM boxes_orders"),
        "dist_haversine": with_views(f"SELECT id, round({HAVERSINE}, 3) AS distance FROM lonlat_customer"),
        "tree_join": with_views(f'SELECT l.id AS "left", r.id AS "right" FROM boxes_orders l JOIN boxes_part r ON {MEET}'),
        "tree_self_join": with_views(f'SELECT l.id AS "left", r.id AS "right" FROM boxes_orders l JOIN boxes_orders r ON {MEET}'),
        "join_semi": with_views(f"SELECT l.id FROM boxes_orders l WHERE EXISTS (SELECT 1 FROM boxes_part r WHERE {MEET})"),
        "join_anti": with_views(f"SELECT l.id FROM boxes_orders l WHERE NOT EXISTS (SELECT 1 FROM boxes_part r WHERE {MEET})"),
        "hilbert_key": on_curve("SELECT id, key FROM p"),
        "hilbert_partitions": on_curve("SELECT id, (pos // 16)::BIGINT AS partition_id FROM p"),
        "str_partitions": with_views(
            """SELECT id, ((row_number() OVER (ORDER BY slice, cy, id) - 1) // 16)::BIGINT AS partition_id FROM (
            SELECT id, cy, (row_number() OVER (ORDER BY cx, id) - 1) // per AS slice FROM (
            SELECT id, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, count(*) OVER () AS n,
            ceil(count(*) OVER () / ceil(sqrt(ceil(count(*) OVER () / 16.0))))::BIGINT AS per FROM boxes_orders))"""
        ),
        "partition_boxes": around_sql(16, "partition_id"),
        "boxes_at_level_0": on_curve("SELECT pos, min_x, min_y, max_x, max_y, id FROM p"),
        "boxes_at_level_1": around_sql(16),
        "boxes_at_level_2": around_sql(256),
        "tree_nodes": tree_sql(),
        "kd_partitions": with_views("SELECT id, lo, hi, depth, middle FROM kd", *kd_ctes()),
        "kd_nodes": with_views("SELECT lo, hi, max(depth % 2)::INTEGER AS axis, coalesce(max(CASE WHEN middle THEN id END), -1) AS middle_id, hi - lo + 1 AS n FROM kd GROUP BY lo, hi", *kd_ctes()),
        "rtree_metadata": f"""WITH l0 AS ({n}), {levels} SELECT {every[0]} AS num_items, 16::BIGINT AS node_size, ({nodes})::BIGINT AS num_nodes,
            (1 + {' + '.join(f'(CASE WHEN {e} > 0 THEN 1 ELSE 0 END)' for e in every[1:])})::BIGINT AS num_levels, {bounds} AS level_bounds,
            (8 + ({nodes}) * (32 + CASE WHEN ({nodes}) < 16384 THEN 2 ELSE 4 END))::BIGINT AS num_bytes""",
        "kdtree_metadata": f"""WITH l0 AS ({n}) SELECT n AS num_items, 64::BIGINT AS node_size,
            (8 + n * w + (8 - (n * w) % 8) % 8 + 16 * n)::BIGINT AS num_bytes FROM (SELECT n, CASE WHEN n < 65536 THEN 2 ELSE 4 END AS w FROM l0)""",
        "f32_box": with_views(f"SELECT id, {', '.join(f32_sql(c) for c in BOX)} FROM boxes_orders"),
        "extent_agg": with_views("SELECT id % 8 AS part, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM boxes_orders GROUP BY 1"),
        "geom_bbox": with_views(
            """SELECT id, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(CASE WHEN id % 3 = 0 THEN min_x ELSE min_x + 2 END, 6) AS max_x,
            round(CASE WHEN id % 3 = 2 THEN min_y + 2 ELSE min_y END, 6) AS max_y FROM boxes_orders"""
        ),
        "knn_geometry_haversine": near(25, None, HAVERSINE, "lonlat_customer", 3),
        "rtree_buffer": with_views("SELECT row_number() OVER (ORDER BY id) - 1 AS id, min_x, min_y, max_x, max_y FROM boxes_orders"),
        "kdtree_buffer": with_views("SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y FROM pts_orders"),
        "rtree_buffer_f32": with_views(f"SELECT row_number() OVER (ORDER BY id) - 1 AS id, {', '.join(f32_sql(c) for c in BOX)} FROM boxes_orders"),
        "rtree_children": with_views(
            f"""SELECT level, pos, parent_pos, min_x, min_y, max_x, max_y FROM (
            SELECT *, pos // 16 AS parent_pos FROM ({' UNION ALL '.join(f"SELECT {k}::INTEGER AS level, (pos // {16**k})::BIGINT AS pos, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM p GROUP BY 2" for k in range(8))}))
            WHERE level = (SELECT greatest(1, ceil(log2(count(*)) / 4))::INTEGER - 1 FROM p)""",
            *hilbert_ctes(),
        ),
        "kd_traversal": with_views(
            """SELECT lo, hi, axis, middle_id, CASE WHEN middle_id < 0 THEN -1 ELSE lo END AS left_lo, CASE WHEN middle_id < 0 THEN -1 ELSE (lo + hi) // 2 - 1 END AS left_hi,
            CASE WHEN middle_id < 0 THEN -1 ELSE (lo + hi) // 2 + 1 END AS right_lo, CASE WHEN middle_id < 0 THEN -1 ELSE hi END AS right_hi, leaf_ids FROM (
            SELECT lo, hi, max(depth % 2)::INTEGER AS axis, coalesce(max(CASE WHEN middle THEN id END), -1) AS middle_id,
            coalesce(string_agg(CASE WHEN NOT middle THEN id END::VARCHAR, ',' ORDER BY id), '') AS leaf_ids FROM kd GROUP BY lo, hi)""",
            *kd_ctes(),
        ),
        "within_coord": with_views(f"SELECT id FROM pts_orders WHERE (x - {AT[0]}) * (x - {AT[0]}) + (y - {AT[1]}) * (y - {AT[1]}) <= {RADIUS**2}"),
        "range_rect": with_views(f"SELECT id FROM pts_orders WHERE x BETWEEN {QUERY_BOX[0]} AND {QUERY_BOX[2]} AND y BETWEEN {QUERY_BOX[1]} AND {QUERY_BOX[3]}"),
        "search_rect": with_views(f"SELECT id, min_x, min_y, max_x, max_y FROM boxes_orders WHERE {IN_BOX}"),
        "sq_dist": with_views(f"SELECT id, round((x - {AT[0]}) * (x - {AT[0]}) + (y - {AT[1]}) * (y - {AT[1]}), 6) AS distance FROM pts_orders"),
        "knn_haversine_maxdist": near(None, 2e6, HAVERSINE, "lonlat_customer", 3),
        "join_refined": with_views(f'SELECT l.id AS "left", r.id AS "right" FROM boxes_orders l JOIN boxes_part r ON {MEET} WHERE l.max_x - r.min_x >= 1'),
        "stream_within": with_views("SELECT id FROM pts_events WHERE (x - 50) * (x - 50) + (y - 50) * (y - 50) <= 900"),
        "stream_join": with_views('SELECT l.id AS "left", r.id AS "right" FROM pts_events l JOIN boxes_part r ON l.x BETWEEN r.min_x AND r.max_x AND l.y BETWEEN r.min_y AND r.max_y'),
    }
