"""Geometries from well-known binary, of all seven kinds, with or without Z, M and a reference system."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import SpatialError
from tessera.functions.geometry import TYPE

# Fixed values of the format: the codes of the kinds, and the extended form's flags.
POINT, LINE, POLYGON, POINTS, LINES, POLYGONS, COLLECTION = 1, 2, 3, 4, 5, 6, 7
FLAG_Z, FLAG_M, FLAG_SRID = 0x80000000, 0x40000000, 0x20000000


def parsed(raw: bytes) -> list[dict] | None:
    """The parts; null for null, an error for unknown kinds or bytes that end too soon.

    Z and M are read over and dropped, as is the reference system's number.
    """
    if raw is None:
        return None
    at = 0

    def take(form: str, order: str) -> tuple:
        nonlocal at
        found = struct.unpack_from(order + form, raw, at)
        at += struct.calcsize(order + form)
        return found

    def vertices(order: str, n: int, width: int) -> list[dict]:
        flat = take(f"{width * n}d", order)
        return [{"x": x, "y": y} for x, y in zip(flat[::width], flat[1::width], strict=True)]

    def one(depth: int) -> list[dict]:
        order = "<" if take("B", "<")[0] else ">"
        (code,) = take("I", order)
        if code & FLAG_SRID:
            take("I", order)
        flags, plain = code & (FLAG_Z | FLAG_M), code & ~(FLAG_Z | FLAG_M | FLAG_SRID)
        kind, more = plain % 1000, plain // 1000  # thousands: 1 has Z, 2 has M, 3 both
        if more > 3 or depth > 32:
            raise SpatialError(f"kind {code} is not supported")
        width = 2 + (more in (1, 3) or bool(flags & FLAG_Z)) + (more in (2, 3) or bool(flags & FLAG_M))
        if kind == POINT:
            (p,) = vertices(order, 1, width)
            return [] if p["x"] != p["x"] else [{"kind": "point", "rings": [[p]]}]  # an empty point is written as NaN
        n = take("I", order)[0]
        if kind == LINE:
            return [{"kind": "line", "rings": [vertices(order, n, width)]}] if n else []
        if kind == POLYGON:
            rings = [r for r in (vertices(order, take("I", order)[0], width) for _ in range(n)) if r]
            return [{"kind": "polygon", "rings": rings}] if rings else []
        if kind in (POINTS, LINES, POLYGONS, COLLECTION):
            return [p for _ in range(n) for p in one(depth + 1)]
        raise SpatialError(f"kind {code} is not supported")

    try:
        return one(0)
    except struct.error as e:
        raise SpatialError("the geometry ends too soon") from e


def from_wkb(column: str | Column, strict: bool = False) -> Column:
    """A binary column as geometries, in Arrow batches: Spark has no function for it. Malformed
    values give null; with ``strict`` they end the job."""

    @F.pandas_udf(TYPE)
    def decode(raw: pd.Series) -> pd.Series:
        def parts(r: bytes) -> list[dict] | None:
            try:
                return parsed(r)
            except SpatialError:
                if strict:
                    raise
                return None

        return raw.map(parts)

    return decode(column)
