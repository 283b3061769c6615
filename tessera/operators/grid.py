"""Hierarchical grids: every box lies in at most four cells of the level of its own size."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import SpatialError
from tessera.sources.frame import BOX

#: Levels on either side of the base; a cell of level l has the base's side times 2**l.
DEEPEST, WIDEST = -16, 47
#: Stands for the exponent of a side of zero, and of an endless one.
NO_SIDE, ENDLESS = -10_000, 10_000
#: Filed rows up to which a side is sent whole to every executor (some 10 MB); beyond that both are shuffled.
SENT = 100_000


def side_of() -> Column:
    return F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))


def exponent_of(side: Column) -> Column:
    """The least power of two that is no smaller than the side."""
    return F.when(side <= 0, NO_SIDE).when(side == math.inf, ENDLESS).otherwise(F.ceil(F.log2(side))).cast("int")


def within(level: int) -> int:
    return min(max(level, DEEPEST), WIDEST)


@dataclass(frozen=True)
class Sizes:
    """What one pass over a table of boxes says of them."""

    rows: dict[int, int]  # for each exponent of the larger side
    total: float  # of all finite sides
    inverted: bool
    endless: bool  # a coordinate is infinite
    extent: tuple[float, float, float, float] | None  # of the finite coordinates

    @property
    def n(self) -> int:
        return sum(self.rows.values())

    def levels(self, base: int) -> list[int]:
        """The distinct levels over a base of two to the power of ``base``: 64 at most."""
        return sorted({within(e - base) for e in self.rows})

    def filed(self, base: int, levels: list[int] | None = None, above: bool = False) -> int:
        """Rows at most that ``filed`` makes of the table."""
        here = lambda v: 1 if levels is None else sum(w > v if above else w >= v for w in levels)
        return sum(4 * n * here(within(e - base)) for e, n in self.rows.items())


def sizes_of(df: DataFrame) -> Sizes:
    """One aggregation with map-side combine; a row for each power of two comes back."""
    endless = F.lit(False)
    for c in BOX:
        endless = endless | (F.abs(F.col(c)) == math.inf)
    finite = lambda c: F.when(F.abs(F.col(c)) != math.inf, F.col(c))
    side = side_of()
    found = (
        df.groupBy(exponent_of(side).alias("e"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.when((side > 0) & (side < math.inf), side)).alias("total"),
            F.max((F.col("min_x") > F.col("max_x")) | (F.col("min_y") > F.col("max_y"))).alias("inverted"),
            F.max(endless).alias("endless"),
            F.min(F.least(finite("min_x"), finite("max_x"))).alias("x0"),
            F.min(F.least(finite("min_y"), finite("max_y"))).alias("y0"),
            F.max(F.greatest(finite("min_x"), finite("max_x"))).alias("x1"),
            F.max(F.greatest(finite("min_y"), finite("max_y"))).alias("y1"),
        )
        .collect()
    )
    low = lambda c: min((r[c] for r in found if r[c] is not None), default=0.0)
    high = lambda c: max((r[c] for r in found if r[c] is not None), default=0.0)
    extent = (low("x0"), low("y0"), high("x1"), high("y1")) if found else None
    return Sizes(
        {r["e"]: r["n"] for r in found}, sum(r["total"] or 0.0 for r in found), any(r["inverted"] for r in found), any(r["endless"] for r in found), extent
    )


def base_of(*sizes: Sizes) -> int:
    """The power of two at the mean larger side of all boxes."""
    n, total = sum(s.n for s in sizes), sum(s.total for s in sizes)
    return math.ceil(math.log2(total / n)) if n and 0 < total / n < math.inf else 0


def level_of(side: Column, base: int) -> Column:
    return F.greatest(F.lit(DEEPEST), F.least(F.lit(WIDEST), exponent_of(side) - base)).cast("int")


def width(level: Column, base: int) -> Column:
    return F.pow(F.lit(2.0), level + base)


def cell_of(value: Column, level: Column, base: int) -> Column:
    return F.floor(value / width(level, base)).cast("long")


def with_cells(df: DataFrame, base: int) -> DataFrame:
    """A row for each cell of column ``level`` that the box covers: at its own level four at most."""

    def span(low: str, high: str) -> Column:
        return F.sequence(cell_of(F.col(low), F.col("level"), base), cell_of(F.col(high), F.col("level"), base))

    return df.withColumn("cx", F.explode(span("min_x", "max_x"))).withColumn("cy", F.explode(span("min_y", "max_y")))


def filed(df: DataFrame, base: int, levels: list[int] | None = None, above: bool = False) -> DataFrame:
    """The boxes in the cells of their own level; with ``levels`` in those of each of these that is
    no lower than their own, or with ``above`` higher."""
    df = df.withColumn("level", level_of(side_of(), base))
    if levels is not None:
        all_levels = F.array(*[F.lit(v) for v in levels]).cast("array<int>")
        df = df.withColumn("level", F.explode(F.filter(all_levels, lambda v: v > F.col("level") if above else v >= F.col("level"))))
    return with_cells(df, base)


def told(l: DataFrame, r: DataFrame, most_l: float, most_r: int, semi: bool = False) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    """Both sides of a join on cells, with its strategy named by the rows that they can have. Spark's own
    guess follows the size of the files read, whatever ``filed`` multiplies, and would gather on the
    driver what it takes for small."""
    if most_r <= SENT:
        return l, r.hint("broadcast")
    if most_l <= SENT and not semi:
        return l.hint("broadcast"), r
    return l, r.hint("merge")


def within_extent(df: DataFrame, *sizes: Sizes, pads: int = 1, finite: bool = False) -> DataFrame:
    """Infinite coordinates brought to just beyond all finite ones, which changes no intersection;
    with ``finite`` the finite ones beyond the extent instead."""
    if not any(s.endless for s in sizes):
        return df
    known = [s.extent for s in sizes if s.extent]
    for c, at in (("min_x", 0), ("min_y", 1), ("max_x", 0), ("max_y", 1)):
        low, high = min(e[at] for e in known), max(e[at + 2] for e in known)
        low, high = low - pads * max(1.0, abs(low) * 1e-9), high + pads * max(1.0, abs(high) * 1e-9)
        brought = F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))
        df = df.withColumn(c, F.when((F.abs(F.col(c)) == math.inf) != F.lit(finite), brought).otherwise(F.col(c)))
    return df


def upright(sizes: Sizes, side: str) -> Sizes:
    if sizes.inverted:
        raise SpatialError(f"the {side} side of a join holds inverted boxes")
    return sizes
