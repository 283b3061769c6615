import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import SpatialError
from tessera.functions import geometry
from tessera.operators import knn, search
from tessera.sources import buffer
from tessera.sources.frame import together
from tessera.sources.wkb import from_wkb, parsed
from tests.fixtures import box_frame, ids, point_frame, random_boxes


def wkb_point(x, y, order="<"):
    return struct.pack(order + "BIdd", order == "<", 1, x, y)


def test_wkb_distances(spark):
    rows = spark.createDataFrame([(k, bytearray(wkb_point(x, y, "<>"[k % 2]))) for k, (x, y) in enumerate([(0, 0), (3, 4), (6, 8)])] + [(3, None)], "id long, raw binary")
    got = knn.neighbours_geometry(rows.select("id", from_wkb("raw").alias("geometry")), geometry.point(1, 1)).collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3]
    assert [r["distance"] for r in got[:3]] == pytest.approx([1.414, 3.606, 8.602], abs=1e-3)


def test_wkb_kinds():
    ring = struct.pack("<I6d", 3, 0, 0, 4, 0, 0, 3)
    polygon = struct.pack("<BII", 1, 3, 1) + ring
    assert [p["kind"] for p in parsed(polygon)] == ["polygon"] and len(parsed(polygon)[0]["rings"][0]) == 3
    many = struct.pack("<BII", 1, 4, 2) + wkb_point(1, 2) + wkb_point(3, 4)
    assert [p["rings"][0][0]["x"] for p in parsed(many)] == [1, 3]
    two = struct.pack("<BII", 1, 6, 2) + polygon + polygon
    mixed = struct.pack("<BII", 1, 7, 3) + many + two + struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    assert [p["kind"] for p in parsed(mixed)] == ["point", "point", "polygon", "polygon", "line"]
    assert parsed(wkb_point(float("nan"), float("nan"))) == [] == parsed(struct.pack("<BII", 1, 7, 0))
    z = {"x": 1.0, "y": 2.0}
    flat = [{"kind": "point", "rings": [[z]]}]
    assert parsed(struct.pack("<BI3d", 1, 1001, 1, 2, 9)) == parsed(struct.pack("<BI3d", 1, 0x80000001, 1, 2, 9)) == flat
    assert parsed(struct.pack("<BII4d", 1, 0xE0000001, 4326, 1, 2, 8, 9)) == parsed(struct.pack(">BI4d", 0, 3001, 1, 2, 8, 9)) == flat
    for bad in (polygon[:-1], struct.pack("<BII", 1, 8, 0), struct.pack("<BII", 1, 4001, 0), b""):
        with pytest.raises(SpatialError):
            parsed(bad)


def test_malformed_wkb_is_null(spark):
    rows = spark.createDataFrame([(0, bytearray(wkb_point(3, 4))), (1, bytearray(b"\x01\x09")), (2, None)], "id long, raw binary")
    got = {r["id"]: r["g"] for r in rows.select("id", from_wkb("raw").alias("g")).collect()}
    assert got[0][0]["rings"][0][0]["x"] == 3 and got[1] is None and got[2] is None
    with pytest.raises(Exception, match="too soon"):
        rows.select(from_wkb("raw", strict=True)).collect()


def test_batches_and_one_value_arguments(spark):
    data = together(box_frame(spark, [(0, 0, 1, 1)]), box_frame(spark, [(5, 5, 6, 6)]))
    assert data.df.count() == 2 and search.search_rect(data, (0, 0, 9, 9)).count() == 2
    assert knn.neighbours_coord(data, (5, 5), k=1).first()["distance"] == 0
    dots = point_frame(spark, [(0, 2), (2, 4)])
    assert ids(search.range_rect(dots, (2, 4, 7, 9))) == [1] and ids(search.within_coord(dots, (0, 2), 1)) == [0]
    with pytest.raises(SpatialError):
        together(data, dots)
    again = together(data, box_frame(spark, [(7, 7, 8, 8), (9, 9, 9, 9)]), renumber=True)
    assert [r["id"] for r in again.df.orderBy("min_x", "id").collect()] == [0, 1, 2, 3] or sorted(ids(again.df)) == [0, 1, 2, 3]
    found = knn.with_geometry(dots.df, spark.range(1).select("id", geometry.point(F.lit(0.0), F.lit(0.0)).alias("geometry"))).orderBy("id").collect()
    assert found[0]["geometry"] is not None and found[1]["geometry"] is None


def test_buffers_hold_insertion_indexes_alone(spark):
    data = box_frame(spark, [(0, 0, 1, 1)])
    far = type(data)(data.df.withColumn("id", F.col("id") + 7), data.roles, data.node_size)
    with pytest.raises(SpatialError):
        buffer.encode_rtree(far)


def test_buffers_in_pieces_have_no_bound_of_one_process(spark, monkeypatch):
    from tessera.operators import meta
    from tessera.plans import queries

    monkeypatch.setattr(buffer, "PIECE", 16)
    rows = random_boxes(300, 33)
    data, dots = box_frame(spark, rows), point_frame(spark, rows[:, :2])
    tree, kd_tree = buffer.rtree_pieces(data), buffer.kdtree_pieces(dots)
    raw = tree.joined()
    assert tree.rows.count() > 3 and buffer.metadata_of(raw) == meta.RTreeMetadata(300)
    assert buffer.decode_rtree(spark, tree).orderBy("pos").collect() == buffer.decode_rtree(spark, raw).collect()
    assert buffer.decode_kdtree(spark, kd_tree).orderBy("pos").collect() == buffer.decode_kdtree(spark, kd_tree.joined()).collect()
    for wrong in (lambda: buffer.decode_kdtree(spark, tree), lambda: buffer.decode_rtree(spark, kd_tree)):
        with pytest.raises(SpatialError):
            wrong()
    # every node's first child as an offset of four to a box, in level order
    width = meta.RTreeMetadata(300).index_width
    assert np.frombuffer(raw[-22 * width :], f"<u{width}").tolist() == [64 * k for k in range(19)] + [4 * 300, 4 * 316, 4 * 319]
    monkeypatch.setattr(buffer, "MOST", 100)
    with pytest.raises(SpatialError):
        buffer.encode_rtree(data)
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert [queries.queries()[q](spark, sf).count() for q in ("rtree_buffer", "kdtree_buffer", "rtree_buffer_f32")] == [n] * 3
