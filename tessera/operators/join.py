"""Joins on box intersection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import bboxes_intersect
from tessera.operators import grid
from tessera.plans.tables import Written
from tessera.sources.frame import BOX, SpatialFrame, unused


def plain(data: SpatialFrame) -> DataFrame:
    return data.as_boxes().df.select("id", *BOX)


def prepared(a: DataFrame, b: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int, grid.Sizes, grid.Sizes]:
    """Both sides with finite boxes, the base of their grid and the sizes of each: one pass a side; of
    one side alone both are that."""
    one = grid.upright(grid.sizes_of(a), "left")
    other = one if b is None else grid.upright(grid.sizes_of(b), "right")
    if one.endless or other.endless:
        a, b = grid.within_extent(a, one, other), None if b is None else grid.within_extent(b, one, other)
        one = grid.sizes_of(a)
        other = one if b is None else grid.sizes_of(b)
    return a, a if b is None else b, grid.base_of(one, other), one, other


def same_cell():
    return (F.col("l.level") == F.col("r.level")) & (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy")) & bboxes_intersect("l", "r")


def in_cells(l: DataFrame, r: DataFrame, base: int, most_l: int, most_r: int) -> DataFrame:  # noqa: E741
    """Filed rows l and r that meet, in the cell that holds the corner of their common part."""
    size = grid.width(F.col("l.level"), base)
    corner = (F.floor(F.greatest("l.min_x", "r.min_x") / size) == F.col("l.cx")) & (F.floor(F.greatest("l.min_y", "r.min_y") / size) == F.col("l.cy"))
    l, r = grid.told(l.alias("l"), r.alias("r"), most_l, most_r)  # noqa: E741
    return l.join(r, same_cell() & corner)


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows l and r (structs of the sides' columns, which hold a box each) of every pair that meets.

    A pair is found at the level of its larger box: there either box covers four cells at most, so
    one equality join on (level, cell) finds all pairs whatever the mix of sizes, and the cell that
    holds the corner of the common part emits it. A box is filed once for each level of the other
    side that is wider than its own. A crowded cell is a skewed key, which AQE splits.
    """
    names_a, names_b = a.columns, b.columns
    a, b, base, one, other = prepared(a, b)
    levels_a, levels_b = one.levels(base), other.levels(base)

    def met(l: DataFrame, r: DataFrame, most_l: int, most_r: int) -> DataFrame:  # noqa: E741
        pairs = in_cells(l, r, base, most_l, most_r)
        return pairs.select(F.struct(*[F.col(f"l.`{c}`") for c in names_a]).alias("l"), F.struct(*[F.col(f"r.`{c}`") for c in names_b]).alias("r"))

    # the left box is the larger or of the same level, then the right one is larger
    larger = met(grid.filed(a, base), grid.filed(b, base, levels_a), one.filed(base), other.filed(base, levels_a))
    smaller = met(grid.filed(a, base, levels_b, above=True), grid.filed(b, base), one.filed(base, levels_b, above=True), other.filed(base))
    return larger.unionByName(smaller)


def tree_join(left: SpatialFrame, right: SpatialFrame) -> DataFrame:
    """left, right: ids of every pair of boxes that meet (closed), each once; a frame joined with
    itself gives (i, i) and both (i, j) and (j, i).

    Inverted boxes are an error; infinite coordinates meet what they reach; a null id is paired like
    any other. The boxes' sizes are counted (one job a side) when this is called.
    """
    if left.df is right.df:
        return self_join(left)
    return candidates(plain(left), plain(right)).select(F.col("l.id").alias("left"), F.col("r.id").alias("right"))


def self_join(data: SpatialFrame) -> DataFrame:
    """``tree_join`` of a frame with itself by one join: the larger box of a pair finds the smaller, and
    the pair is given in both directions; boxes of one level find each other."""
    a, b, base, sizes, _ = prepared(plain(data))
    levels = sizes.levels(base)
    found = in_cells(grid.filed(a, base), grid.filed(b, base, levels), base, sizes.filed(base), sizes.filed(base, levels))
    ids = F.struct(F.col("l.id").alias("left"), F.col("r.id").alias("right"))
    back = F.struct(F.col("r.id").alias("left"), F.col("l.id").alias("right"))
    smaller = grid.level_of(F.greatest(F.col("r.max_x") - F.col("r.min_x"), F.col("r.max_y") - F.col("r.min_y")), base) < F.col("l.level")
    return found.select(F.explode(F.when(smaller, F.array(ids, back)).otherwise(F.array(ids))).alias("pair")).select("pair.left", "pair.right")


def parted(left: SpatialFrame, right: SpatialFrame, how: str) -> DataFrame:
    """Rows of the left frame are numbered in a written table, so neither null nor equal ids matter;
    a semi join on cells then marks numbers, and no pair is ever formed."""
    row = unused("row", left.df.columns)
    numbered = Written(left.df.sparkSession)(left.df.withColumn(row, F.monotonically_increasing_id()))
    low_x, low_y, high_x, high_y = ("x", "y", "x", "y") if left.is_points else left.roles
    own = numbered.select(F.col(row).alias("id"), *[F.col(c).alias(n) for c, n in zip((low_x, low_y, high_x, high_y), BOX, strict=True)])
    a, b, base, one, other = prepared(own, plain(right))
    levels_a, levels_b = one.levels(base), other.levels(base)
    sides = (
        (grid.filed(a, base), grid.filed(b, base, levels_a), other.filed(base, levels_a)),
        (grid.filed(a, base, levels_b, above=True), grid.filed(b, base), other.filed(base)),
    )
    sides = [grid.told(l.alias("l"), r.alias("r"), math.inf, most, semi=True) for l, r, most in sides]  # noqa: E741
    hits = [l.join(r, same_cell(), "left_semi").select(F.col("id").alias(row)) for l, r in sides]  # noqa: E741
    return numbered.join(hits[0].unionByName(hits[1]).distinct().hint("merge"), row, how).drop(row)


def semi(left: SpatialFrame, right: SpatialFrame) -> DataFrame:
    """Rows of the left frame that meet some box of the right."""
    return parted(left, right, "left_semi")


def anti(left: SpatialFrame, right: SpatialFrame) -> DataFrame:
    """Rows of the left frame that meet no box of the right."""
    return parted(left, right, "left_anti")


def refined(left: SpatialFrame, right: SpatialFrame, condition) -> DataFrame:
    """Candidate pairs that an exact condition on both rows (aliases l and r) confirms; rows are
    found again by id, so those without one are not. Both joins sort and merge: Spark would take a
    table for as small as its file."""
    pairs = tree_join(left, right)
    return (
        pairs.join(left.df.alias("l").hint("merge"), F.col("left") == F.col("l.id"))
        .join(right.df.alias("r").hint("merge"), F.col("right") == F.col("r.id"))
        .where(condition)
        .select("left", "right")
    )
