import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import SpatialError, boxes
from tessera.functions import geometry
from tessera.functions.metrics import Euclidean, Haversine
from tessera.operators import knn, search
from tessera.sources.frame import extent
from tests.fixtures import CITIES, box_frame, ids, point_frame, random_boxes


def test_three_boxes(spark):
    data = box_frame(spark, [(0, 0, 2, 2), (1, 1, 3, 3), (2, 2, 4, 4)])
    assert ids(search.search(data, 0.5, 0.5, 1.5, 1.5)) == [0, 1]
    assert [r["id"] for r in knn.neighbours(data, 5, 5).collect()] == [2, 1, 0]


def test_touching_counts_and_one_box(spark):
    data = box_frame(spark, [(-20, -20, 1020, 1020)])
    assert ids(search.search(data, 0, 0, 0, 0)) == [0]
    assert ids(search.search(data, 1020, 1020, 1030, 1030)) == [0]
    assert ids(search.search(data, 1020.001, 1020, 1030, 1030)) == []


@pytest.mark.parametrize("n", [0, 1, 4, 16, 20])
def test_diagonal_points_are_found_alone(spark, n):
    data = box_frame(spark, [(i, i, i, i) for i in range(n)])
    assert ids(search.search(data, -1, -1, n, n)) == list(range(n))
    if n:
        assert ids(search.search_point(data, n - 1, n - 1)) == [n - 1]


def test_search_against_brute_force(spark):
    rows = random_boxes(300, 1)
    data = box_frame(spark, rows)
    for q in random_boxes(5, 2, side=200):
        hit = (rows[:, 0] <= q[2]) & (rows[:, 1] <= q[3]) & (rows[:, 2] >= q[0]) & (rows[:, 3] >= q[1])
        assert ids(search.search(data, *q)) == np.flatnonzero(hit).tolist()


def test_predicates_reach_the_scan(spark, tmp_path):
    box_frame(spark, random_boxes(100, 3)).df.write.parquet(str(tmp_path / "b"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = search.search(boxes(spark.read.parquet(str(tmp_path / "b"))), 0, 0, 10, 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(min_x" in plan and "GreaterThanOrEqual(max_y" in plan


def test_points(spark):
    data = point_frame(spark, [(0, 2), (1, 3), (2, 4)])
    assert ids(search.range_search(data, 2, 4, 7, 9)) == [2]
    assert ids(search.within(data, 0, 2, math.sqrt(2))) == [0, 1]
    with pytest.raises(SpatialError):
        search.within(data, 0, 0, -1)
    with pytest.raises(SpatialError):
        search.range_search(data.as_boxes(), 0, 0, 1, 1)


def test_front_ends_and_bad_rows(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, 1.0, 1.0, "a"), (2, None, 0.0, 1.0, 1.0, "b"), (3, float("nan"), 0.0, 1.0, 1.0, "c")],
        "key long, min_x double, min_y double, max_x double, max_y double, id string",
    )
    assert ids(search.search(boxes(df, key="key"), -9, -9, 9, 9)) == [1]
    packed = df.where("key = 1").select("key", F.array("min_x", "min_y", "max_x", "max_y").alias("a"), F.struct("min_x", "min_y", "max_x", "max_y").alias("s"))
    assert ids(boxes(packed, "a", "key").df) == ids(boxes(packed, "s", "key").df) == [1]
    with pytest.raises(SpatialError):
        boxes(df, ["min_x"], "key")
    with pytest.raises(SpatialError):
        boxes(df, key="key", node_size=1)
    assert extent(box_frame(spark, [])).first()["min_x"] is None


def test_bound_is_on_the_metric_itself(spark):
    rows = [(10, 10, 11, 11), (53, 50, 53, 50), (50, 57, 50, 57), (62, 50, 62, 50)]
    data = box_frame(spark, rows)
    assert ids(knn.neighbours(data, 50, 50, max_distance=12)) == [1]
    assert ids(knn.neighbours(data, 50, 50, max_distance=12, metric="euclidean")) == [1, 2, 3]
    with pytest.raises(SpatialError):
        knn.neighbours(data, 0, 0, 0)
    assert knn.neighbours(box_frame(spark, []), 0, 0, 3).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    data = box_frame(spark, [(1, 0, 1, 0), (-1, 0, -1, 0), (0, 1, 0, 1)])
    assert [r["id"] for r in knn.neighbours(data, 0, 0, 2).collect()] == [0, 1]


def test_cities(spark):
    data = box_frame(spark, [(x, y, x, y) for _, x, y in CITIES])
    rows = knn.neighbours(data, -74.0, 40.7, metric="haversine").collect()
    assert [r["id"] for r in rows] == [0, 1, 2]
    assert rows[1]["distance"] == pytest.approx(5_572_812.6, abs=0.5)
    rows = knn.neighbours(data, -74.0, 40.7, metric=Haversine(6378137.0)).collect()
    assert rows[1]["distance"] == pytest.approx(5_579_047.8, abs=0.5)


def test_callers_metric(spark):
    class Manhattan(Euclidean):
        def distance_to_bbox(self, x, y, box):
            return F.abs(x - box["min_x"]) + F.abs(y - box["min_y"])

        def reach(self, most):
            return None

    data = box_frame(spark, [(3, 3, 3, 3), (5, 0, 5, 0)])
    assert [r["id"] for r in knn.neighbours(data, 0, 0, metric=Manhattan()).collect()] == [1, 0]


def test_geometry_distances(spark):
    v = geometry.vertex
    square = geometry.polygon(v(0, 0), v(4, 0), v(4, 4), v(0, 4))
    cases = {
        "a": (geometry.point(0, 0), geometry.point(3, 4), 5.0),
        "b": (geometry.point(5, 7), geometry.line(v(0, 2), v(10, 2)), 5.0),
        "c": (geometry.point(1, 1), square, 0.0),
        "d": (geometry.point(7, 8), square, 5.0),
        "e": (geometry.line(v(-1, 2), v(9, 2)), square, 0.0),
        "f": (geometry.polygon(v(1, 1), v(2, 1), v(2, 2)), square, 0.0),
    }
    row = spark.range(1).select(*[geometry.planar_distance(x, y).alias(k) for k, (x, y, _) in cases.items()], geometry.centroid(square).alias("centre"), geometry.bbox(square).alias("box")).first()
    for k, (_, _, want) in cases.items():
        assert row[k] == pytest.approx(want), k
    assert tuple(row["centre"]) == pytest.approx((2, 2)) and tuple(row["box"]) == (0, 0, 4, 4)


def test_many_parts(spark):
    v, point, line, polygon, many = geometry.vertex, geometry.point, geometry.line, geometry.polygon, geometry.collection
    square = polygon(v(0, 0), v(10, 0), v(10, 10), v(0, 10))
    far = polygon(v(50, 50), v(60, 50), v(60, 60), v(50, 60))
    holed = polygon(v(0, 0), v(10, 0), v(10, 10), v(0, 10), holes=((v(2, 2), v(8, 2), v(8, 8), v(2, 8)),))
    cases = {
        "points": (many(point(100, 100), point(5, 5)), square, 0.0),
        "lines": (many(line(v(20, 20), v(14, 20)), line(v(1, 1), v(2, 2))), square, 0.0),
        "polygons": (point(55, 55), many(square, far), 0.0),
        "between": (point(30, 5), many(square, far), 20.0),
        "hole": (point(5, 5), holed, 3.0),
        "in_hole": (polygon(v(4, 4), v(5, 4), v(5, 5)), many(holed, far), 2.0),
        "mixed": (many(point(-3, -4), line(v(90, 0), v(90, 9))), many(square, point(0, -4)), 3.0),
        "around": (many(point(700, 0), polygon(v(-9, -9), v(99, -9), v(99, 99), v(-9, 99))), many(square, far), 0.0),
    }
    none = F.array().cast(geometry.TYPE)
    row = spark.range(1).select(
        *[geometry.planar_distance(x, y).alias(k) for k, (x, y, _) in cases.items()],
        *[geometry.planar_distance(y, x).alias(f"{k}_") for k, (x, y, _) in cases.items()],
        geometry.planar_distance(none, square).alias("none"),
        geometry.bbox(many(square, far)).alias("box"), geometry.bbox(none).alias("no_box"),
        geometry.centroid(many(square, far, point(500, 500))).alias("both"), geometry.centroid(holed).alias("holed"),
        geometry.centroid(many(line(v(0, 0), v(4, 0)), point(9, 9))).alias("line"), geometry.centroid(many(point(0, 0), point(4, 8))).alias("dots"),
        geometry.centroid(none).alias("nowhere"),
        geometry.centroid(polygon(v(0, 0), v(0, 10), v(10, 10), v(10, 0), holes=((v(0, 0), v(5, 0), v(5, 10), v(0, 10)),))).alias("half"),
    ).first()
    for k, (_, _, want) in cases.items():
        assert row[k] == row[f"{k}_"] == pytest.approx(want), k
    assert row["none"] is row["no_box"] is row["nowhere"] is None and tuple(row["box"]) == (0, 0, 60, 60)
    assert tuple(row["both"]) == pytest.approx((30, 30)) and tuple(row["holed"]) == pytest.approx((5, 5)) and tuple(row["half"]) == pytest.approx((7.5, 5))
    assert tuple(row["line"]) == pytest.approx((2, 0)) and tuple(row["dots"]) == pytest.approx((2, 4))


def test_a_metric_has_its_own_bound(spark):
    class Near(Euclidean):
        def max_distance(self):
            return 5.0

    data = box_frame(spark, [(3, 3, 3, 3), (50, 0, 50, 0)])
    assert ids(knn.neighbours(data, 0, 0, metric=Near())) == [0] and ids(knn.neighbours(data, 0, 0, metric=Near(), max_distance=60)) == [0, 1]
    rows = spark.range(1).select("id", F.lit(None).cast(geometry.TYPE).alias("geometry"))
    assert knn.neighbours_geometry(rows, geometry.point(0, 0), metric=Near()).first()["distance"] == 5.0


def test_a_haversine_bound_is_a_band_of_latitudes(spark):
    rng = np.random.default_rng(12)
    rows = [(x, y, x, y) for x, y in zip(rng.uniform(-180, 180, 300).tolist(), rng.uniform(-90, 90, 300).tolist())] + [(0, 95, 0, 95)]
    data = box_frame(spark, rows)
    for x, y, most in ((10, 50, 2e6), (170, -89, 1e6), (0, 0, 0.0), (-5, 89.9, 3e6)):
        got = knn.neighbours(data, x, y, max_distance=most, metric="haversine")
        far = knn.neighbours(data, x, y, metric="haversine").where(F.col("distance") <= most)
        assert got.collect() == far.collect()
    plan = knn.neighbours(data, 10, 50, max_distance=1e6, metric="haversine")._jdf.queryExecution().optimizedPlan().toString()
    assert "min_y" in plan and "<= 58.9" in plan


def test_geometry_neighbours(spark):
    rows = spark.createDataFrame([(k, 5.0 * k + 1) for k in range(3)], "id long, v double").select("id", geometry.point(F.col("v"), F.col("v")).alias("geometry"))
    rows = rows.unionByName(spark.range(9, 10).select("id", F.lit(None).cast(geometry.TYPE).alias("geometry")))
    got = knn.neighbours_geometry(rows, geometry.point(3, 3)).collect()
    assert [r["id"] for r in got] == [0, 1, 2, 9] and got[-1]["distance"] == math.inf


def test_knn_join_against_brute_force(spark):
    rows = np.concatenate([random_boxes(300, 4), [[0, 0, 900, 900]]])
    asked = random_boxes(40, 5)[:, :2] * 1.5 - 200
    got = knn.knn_join(point_frame(spark, asked), box_frame(spark, rows), 4).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["id"])
    for i, (x, y) in enumerate(asked):
        dx = np.maximum(np.maximum(rows[:, 0] - x, x - rows[:, 2]), 0)
        dy = np.maximum(np.maximum(rows[:, 1] - y, y - rows[:, 3]), 0)
        assert by[i] == np.lexsort((np.arange(len(rows)), np.hypot(dx, dy)))[:4].tolist()
    assert knn.knn_join(point_frame(spark, []), box_frame(spark, rows), 4).count() == 0
    bound = knn.knn_join(point_frame(spark, asked), box_frame(spark, rows), 4, max_distance=30.0).collect()
    assert sorted(map(tuple, bound)) == sorted(tuple(r) for r in got if r["distance"] <= 30.0)
    assert knn.knn_join(point_frame(spark, asked), box_frame(spark, rows[:2]), 4).count() == 80


def test_knn_join_of_crowds(spark):
    rng = np.random.default_rng(13)
    dense = rng.normal(0, 1e-4, (300, 2)) + 500
    xy = np.concatenate([dense, np.tile([[7.0, 7.0]], (200, 1)), rng.uniform(0, 1000, (50, 2))])
    asked = np.concatenate([dense[:20], np.tile([[7.0, 7.0]], (30, 1)), rng.uniform(-500, 1500, (20, 2)), [[500.0, 500.001]]])
    got = knn.knn_join(point_frame(spark, asked), box_frame(spark, np.concatenate([xy, xy], 1)), 5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["id"])
    for i, q in enumerate(asked):
        assert by[i] == np.lexsort((np.arange(len(xy)), np.hypot(*(xy - q).T)))[:5].tolist(), i
    with pytest.raises(SpatialError):
        knn.knn_join(point_frame(spark, asked), box_frame(spark, [(0, 0, math.inf, 1)]), 5)
