"""Clustering: global positions, Hilbert and sort-tile orders, partitions, and the boxes of tree levels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import SpatialError
from tessera.functions.curve import hilbert_of
from tessera.plans.tables import Written
from tessera.sources.frame import BOX, SpatialFrame


def positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """Adds each row's 0-based place in the order of all rows, without gathering them in one task.

    Rows are range-partitioned and sorted, and that layout is written with each row's number in its
    partition; then the partitions' counts (one row each) give every partition's first place.
    """
    spark = df.sparkSession
    save = Written(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    laid = save(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = laid.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__part").collect()  # a row a partition
    shift, at = [], 0
    for r in counts:
        shift.append((r["__part"], at - r["first"]))
        at += r["n"]
    table = F.broadcast(spark.createDataFrame(shift, "__part int, __shift long"))
    return laid.join(table, "__part").withColumn(out, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def insertion_index(df: DataFrame, key: str = "id") -> DataFrame:
    """0-based position by the caller's key: what an append-only builder would have numbered."""
    return positions(df, [key], "insertion_index")


def hilbert_order(data: SpatialFrame) -> DataFrame:
    return positions(hilbert_of(data), ["key", "id"]).drop("key")


def slices_of(n: int, node_size: int) -> tuple[int, int]:
    """How many vertical slices sort-tile packing cuts, and how many items each holds."""
    slices = max(1, math.ceil(math.sqrt(math.ceil(n / node_size))))
    return slices, max(1, math.ceil(n / slices))


def str_order(data: SpatialFrame) -> DataFrame:
    """By centre x into slices of equal count, each by centre y: two position passes."""
    flat = data.as_boxes().df
    _, per = slices_of(flat.count(), data.node_size)
    centred = flat.withColumns({"__cx": (F.col("min_x") + F.col("max_x")) / 2, "__cy": (F.col("min_y") + F.col("max_y")) / 2})
    ranked = positions(centred, ["__cx", "id"], "__x").withColumn("slice", F.floor(F.col("__x") / per).cast("long"))
    return positions(ranked, ["slice", "__cy", "id"]).drop("__cx", "__cy", "__x")


def packed(data: SpatialFrame, method: str | Callable[[SpatialFrame], list[Column]] = "hilbert") -> DataFrame:
    """The frame's rows with ``pos``, the place in packed order. With one node at most nothing is
    sorted but by id. A callable gives sort-key columns of the caller's own."""
    flat = data.as_boxes()
    if flat.df.limit(data.node_size + 1).count() <= data.node_size:
        return positions(flat.df, ["id"])
    if callable(method):
        keys = {f"__key{k}": c for k, c in enumerate(method(flat))}
        return positions(flat.df.withColumns(keys), [*keys, "id"]).drop(*keys)
    if method == "hilbert":
        return hilbert_order(flat)
    if method == "str":
        return str_order(flat).drop("slice")
    raise SpatialError(f"{method} is neither hilbert nor str")


def partitions(data: SpatialFrame, method: str = "hilbert") -> DataFrame:
    """id, partition_id: runs of node_size rows in packed order; the last takes the remainder."""
    return packed(data, method).select("id", F.floor(F.col("pos") / data.node_size).cast("long").alias("partition_id"))


def around(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def partition_boxes(data: SpatialFrame, method: str = "hilbert") -> DataFrame:
    rows = packed(data, method)
    return around(rows, F.floor(F.col("pos") / data.node_size).cast("long").alias("partition_id"))


def boxes_at_level(data: SpatialFrame, level: int, method: str = "hilbert") -> DataFrame:
    """pos and box of every node of a level; level 0 is the items themselves, with their ids."""
    from tessera.operators.meta import level_sizes

    n = data.df.count()
    if not 0 <= level < len(level_sizes(n, data.node_size)):
        raise SpatialError(f"level {level} is out of range")
    rows = packed(data, method)
    if level == 0:
        return rows.select("pos", *BOX, "id")
    return around(rows, F.floor(F.col("pos") / data.node_size**level).cast("long").alias("pos"))


def tree_nodes(data: SpatialFrame, method: str = "hilbert") -> DataFrame:
    """level, pos, box, child_start, child_end, id: the whole tree as rows.

    Children of a node are the rows of the level below at pos child_start until child_end; leaves
    have ids instead. Each level is aggregated from the one below, a node_size-th of its size.
    """
    from tessera.operators.meta import level_sizes

    save = Written(data.df.sparkSession)
    rows = save(packed(data, method).select("pos", *BOX, "id"))
    sizes = level_sizes(rows.count(), data.node_size)
    none = F.lit(None).cast("long")
    made = [rows.select(F.lit(0).alias("level"), "pos", *BOX, none.alias("child_start"), none.alias("child_end"), "id")]
    below = rows
    for level in range(1, len(sizes)):
        below = around(below, F.floor(F.col("pos") / data.node_size).cast("long").alias("pos"))
        start = F.col("pos") * data.node_size
        end = F.least(start + data.node_size, F.lit(sizes[level - 1]).cast("long"))
        made.append(below.select(F.lit(level).alias("level"), "pos", *BOX, start.alias("child_start"), end.alias("child_end"), F.lit(None).cast("long").alias("id")))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out




def root(nodes: DataFrame) -> DataFrame:
    """Of the rows of ``tree_nodes`` the one at the top; none for an empty tree."""
    return nodes.orderBy(F.desc("level"), "pos").limit(1)


def is_leaf() -> Column:
    """Whether a row of ``tree_nodes`` is an item, which has an id and no children."""
    return F.col("level") == 0


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``tree_nodes`` that are children of some of them, with ``parent_pos``: an equality
    join on (level, pos). Items have none."""
    below = F.sequence(F.col("child_start"), F.col("child_end") - 1)
    keys = parents.where(~is_leaf()).select((F.col("level") - 1).alias("level"), F.explode(below).alias("pos"), F.col("pos").alias("parent_pos"))
    return nodes.join(keys, ["level", "pos"])
