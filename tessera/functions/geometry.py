"""Geometries as arrays of parts, and their boxes, centroids and distances.

A part is a struct<kind:string, rings:array<array<struct<x:double,y:double>>>>: a point has one ring of
one vertex, a line one ring, a polygon its shell and then its holes, each closed. Multi-part
geometries and collections are arrays of several parts, of one kind or of many; an empty geometry has
none. All functions are Columns over higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double>"
PART = f"struct<kind:string,rings:array<array<{VERTEX}>>>"
TYPE = f"array<{PART}>"


def vertex(x: Column | float, y: Column | float) -> Column:
    x, y = (c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def part(kind: str, *rings: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), F.array(*rings).alias("rings")))


def point(x: Column | float, y: Column | float) -> Column:
    return part("point", F.array(vertex(x, y)))


def line(*vertices: Column) -> Column:
    return part("line", F.array(*vertices))


def polygon(*vertices: Column, holes: tuple[tuple[Column, ...], ...] = ()) -> Column:
    """A polygon with holes; the first vertex of each ring is repeated at the end."""
    return part("polygon", *[F.array(*ring, ring[0]) for ring in (vertices, *holes)])


def collection(*geometries: Column) -> Column:
    """Several geometries as one; of one kind they are its multi-part form."""
    return F.concat(*geometries)


def vertices_of(geometry: Column) -> Column:
    return F.flatten(F.flatten(F.transform(geometry, lambda p: p["rings"])))


def bbox(geometry: Column) -> Column:
    """The least box as a struct; null for a geometry without vertices."""
    flat = vertices_of(geometry)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
    return F.when(F.size(flat) > 0, box)


def edges_of(ring: Column) -> Column:
    """A ring's edges as structs a, b; a single vertex is an edge without length."""
    pairs = F.transform(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("a"), F.get(ring, i + 1).alias("b")))
    return F.when(F.size(ring) == 1, F.transform(ring, lambda a: F.struct(a.alias("a"), a.alias("b")))).otherwise(pairs)


def segments(one: Column) -> Column:
    """All edges of a part."""
    return F.flatten(F.transform(one["rings"], edges_of))


def point_segment_sq(p: Column, s: Column) -> Column:
    """Squared distance from a vertex to an edge."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    length = dx * dx + dy * dy
    along = F.when(length > 0, ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / length).otherwise(0.0)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = p["x"] - (s["a"]["x"] + along * dx), p["y"] - (s["a"]["y"] + along * dy)
    return ex * ex + ey * ey


def side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def cross(s: Column, t: Column) -> Column:
    """Whether two edges cross in their interiors; touching ends are at distance 0 anyway."""
    return (side(s["a"], s["b"], t["a"]) * side(s["a"], s["b"], t["b"]) < 0) & (side(t["a"], t["b"], s["a"]) * side(t["a"], t["b"], s["b"]) < 0)


def inside(p: Column, one: Column) -> Column:
    """Whether a vertex is within a polygon and in none of its holes, by counting the edges to its right."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = F.when(spans, (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return spans & (p["x"] < at)

    return (one["kind"] == "polygon") & (F.size(F.filter(segments(one), crosses)) % 2 == 1)


def part_distance_sq(one: Column, other: Column) -> Column:
    """Squared; a part that no edge of the other meets lies wholly inside of it or wholly outside,
    which its first vertex tells."""

    def edge_sq(u: Column, v: Column) -> Column:
        ends = F.least(point_segment_sq(u["a"], v), point_segment_sq(u["b"], v), point_segment_sq(v["a"], u), point_segment_sq(v["b"], u))
        return F.when(cross(u, v), 0.0).otherwise(ends)

    far = F.array_min(F.transform(segments(one), lambda u: F.array_min(F.transform(segments(other), lambda v: edge_sq(u, v)))))
    first = lambda g: F.get(F.get(g["rings"], F.lit(0)), F.lit(0))
    return F.when(inside(first(one), other) | inside(first(other), one), 0.0).otherwise(far)


def planar_distance(one: Column, other: Column) -> Column:
    """Least planar distance between any two parts; 0 where they meet or one contains the other, null
    if one is empty."""
    return F.sqrt(F.array_min(F.transform(one, lambda p: F.array_min(F.transform(other, lambda q: part_distance_sq(p, q))))))


def centroid(geometry: Column) -> Column:
    """Of the polygons by area, without these of the lines by length, else the mean of the vertices;
    null for an empty geometry. Holes count against their shell, however either is turned."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def plus(acc: Column, w: Column, x: Column, y: Column) -> Column:
        return F.struct((acc["w"] + w).alias("w"), (acc["x"] + x).alias("x"), (acc["y"] + y).alias("y"))

    def by_area(acc: Column, s: Column) -> Column:
        w = s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
        return plus(acc, w, (s["a"]["x"] + s["b"]["x"]) * w, (s["a"]["y"] + s["b"]["y"]) * w)

    def by_length(acc: Column, s: Column) -> Column:
        w = F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
        return plus(acc, w, (s["a"]["x"] + s["b"]["x"]) / 2 * w, (s["a"]["y"] + s["b"]["y"]) / 2 * w)

    def ring_area(ring: Column, k: Column) -> Column:
        """Positive for the shell, negative for a hole."""

        def turned(total: Column) -> Column:
            sign = F.when(k == 0, F.signum(total["w"])).otherwise(-F.signum(total["w"]))
            return F.struct((total["w"] * sign).alias("w"), (total["x"] * sign).alias("x"), (total["y"] * sign).alias("y"))

        return F.aggregate(edges_of(ring), zero, by_area, turned)

    polygons = F.filter(geometry, lambda p: p["kind"] == "polygon")
    rings = F.flatten(F.transform(polygons, lambda p: F.transform(p["rings"], ring_area)))
    area = F.aggregate(rings, zero, lambda acc, r: plus(acc, r["w"], r["x"], r["y"]))
    edges = F.flatten(F.transform(geometry, segments))
    length = F.aggregate(edges, zero, by_length)
    flat = vertices_of(geometry)
    n = F.size(flat)
    mean = F.when(n > 0, vertex(F.aggregate(flat, F.lit(0.0), lambda acc, p: acc + p["x"]) / n, F.aggregate(flat, F.lit(0.0), lambda acc, p: acc + p["y"]) / n))
    of_area = F.when(area["w"] > 0, vertex(area["x"] / (3 * area["w"]), area["y"] / (3 * area["w"])))
    of_length = F.when(length["w"] > 0, vertex(length["x"] / length["w"], length["y"] / length["w"]))
    return F.coalesce(of_area, of_length, mean)
