"""The Hilbert curve of order 16 over a frame's extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.frame import SpatialFrame, extent

ORDER = 16
CELLS = (1 << ORDER) - 1
#: Bits of each coordinate that one look-up takes.
NIBBLE = 4


def step_table(bits: int = NIBBLE) -> list[int]:
    """For each state and each square of side 2**bits: the state after it, and the square's number.

    The curve is followed from the largest square to the smallest: each step takes a bit of x and of
    y, and turns or mirrors what is left. What that does to later bits is one of four states: both
    coordinates complemented or not, swapped or not.
    """
    side = 1 << bits
    table = []
    for state in range(4):
        for square in range(side * side):
            x, y, after, number = square >> bits, square & side - 1, state, 0
            if state & 2:
                x, y = side - 1 - x, side - 1 - y
            if state & 1:
                x, y = y, x
            for bit in reversed(range(bits)):
                rx, ry = x >> bit & 1, y >> bit & 1
                number = number << 2 | 3 * rx ^ ry
                if not ry:
                    if rx:
                        x, y, after = side - 1 - x, side - 1 - y, after ^ 2
                    x, y, after = y, x, after ^ 1
            table.append(after << 2 * bits | number)
    return table


def hilbert_steps(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """Adds the curve's number (0 to 2**32 - 1) of the cell (x, y), two longs of 0 to 65535, by four
    look-ups of four bits each. Steps are columns of their own, so no expression is repeated."""
    names = df.columns
    table = F.expr(f"cast(split('{','.join(map(str, step_table()))}', ',') as array<int>)")
    mask, squares = (1 << NIBBLE) - 1, 2 * NIBBLE
    df = df.select("*", F.col(x).alias("__x"), F.col(y).alias("__y"), F.lit(0).cast("long").alias("__d"), F.lit(0).alias("__at"))
    for low in range(ORDER - NIBBLE, -1, -NIBBLE):
        here = lambda c: F.shiftright(c, low).bitwiseAND(F.lit(mask).cast("long"))  # noqa: B023, E731
        place = F.shiftleft(F.shiftright("__at", squares), squares) + F.shiftleft(here("__x"), NIBBLE).cast("int") + here("__y").cast("int")
        df = df.select(*names, "__x", "__y", "__d", F.get(table, place).alias("__at"))
        number = F.col("__at").bitwiseAND(F.lit((1 << squares) - 1)).cast("long")
        df = df.select(*names, "__x", "__y", (F.shiftleft("__d", squares) + number).alias("__d"), "__at")
    return df.select(*names, F.col("__d").alias(out))


def cell(centre: Column, low: float, high: float) -> Column:
    """A centre's cell along one axis; 0 where the extent has none."""
    if not high > low:
        # not a constant: folded into the curve's steps it would make the optimizer unroll them
        return F.floor(centre * F.lit(0.0)).cast("long")
    return F.floor(F.lit(float(CELLS)) * (centre - F.lit(low)) / F.lit(high - low)).cast("long")


def hilbert_of(data: SpatialFrame) -> DataFrame:
    """The frame's rows with ``key``: the curve number of their centres. The extent is taken first."""
    names = data.df.columns
    low_x, low_y, high_x, high_y = ("x", "y", "x", "y") if data.is_points else data.roles
    box = extent(data).first()
    bounds = [0.0 if v is None else v for v in box]
    cells = data.df.withColumns(
        {
            "__cx": cell((F.col(low_x) + F.col(high_x)) / 2, bounds[0], bounds[2]),
            "__cy": cell((F.col(low_y) + F.col(high_y)) / 2, bounds[1], bounds[3]),
        }
    ).select(*names, "__cx", "__cy")
    return hilbert_steps(cells, "__cx", "__cy", "key").drop("__cx", "__cy")
