"""The k-d tree as tables: recursive median splits on alternating axes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import SpatialError
from tessera.operators.cluster import positions
from tessera.operators.search import need_points
from tessera.plans.tables import Written
from tessera.sources.frame import SpatialFrame

#: Points of an interval that one task splits to the end; larger ones are split by all.
LOCAL = 200_000
SPLIT = pa.schema([("pos", pa.int64()), ("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("lo", pa.int64()), ("hi", pa.int64()), ("depth", pa.int32()), ("middle", pa.bool_())])


def finish(node_size: int, rows: pa.Table) -> pa.Table:
    """Split one interval to the end. Rows: id, x, y, lo, hi, depth."""
    ids, x, y = (rows[c].to_numpy() for c in ("id", "x", "y"))
    lo, depth = rows["lo"][0].as_py(), rows["depth"][0].as_py()
    out: list[tuple[np.ndarray, ...]] = []

    def emit(at: int, who: np.ndarray, a: int, b: int, d: int, middle: bool) -> None:
        k = len(who)
        out.append((np.arange(at, at + k), ids[who], x[who], y[who], np.full(k, a), np.full(k, b), np.full(k, d, np.int32), np.full(k, middle)))

    stack = [(np.arange(len(ids)), lo, lo + len(ids) - 1, depth)]
    while stack:
        who, a, b, d = stack.pop()
        if b - a <= node_size:
            order = np.lexsort((ids[who],))
            emit(a, who[order], a, b, d, False)
            continue
        who = who[np.lexsort((ids[who], (y if d % 2 else x)[who]))]
        m = (a + b) >> 1
        emit(m, who[m - a : m - a + 1], a, b, d, True)
        stack += [(who[: m - a], a, m - 1, d + 1), (who[m - a + 1 :], m + 1, b, d + 1)]
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=SPLIT)


#: Share of an interval's rows on either side of its middle that are ranked to find it.
BRACKET = 0.005


def middles(open_rows: DataFrame, axis: str, save: Written, bracket: float = BRACKET) -> DataFrame:
    """lo, m, and x, y, id, row of the point at the middle m of each open interval.

    Quantiles (sketches that combine on the map side) enclose the middle; rows below them are
    counted, and only those between, about a hundredth of all, are ranked by range partitioning.
    Where very many points share a coordinate these are more, but never in one task.
    """
    v = F.col(axis)
    around = save(open_rows.groupBy("lo", "hi").agg(F.percentile_approx(v, [0.5 - bracket, 0.5 + bracket], F.lit(1000)).alias("q")))
    met = open_rows.join(around.select("lo", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")), "lo")
    below = met.groupBy("lo").agg(F.sum((v < F.col("low")).cast("long")).alias("below"))
    ranked = positions(met.where(v.between(F.col("low"), F.col("high"))).select("lo", "hi", "id", "x", "y", "row"), ["lo", axis, "id", "row"], "at")
    first = ranked.groupBy("lo").agg(F.min("at").alias("first"))
    m = F.shiftright(F.col("lo") + F.col("hi"), 1)
    found = ranked.join(first, "lo").join(below, "lo").where(F.col("at") - F.col("first") + F.col("below") + F.col("lo") == m)
    found = save(found.select("lo", "hi", m.alias("m"), "id", "x", "y", "row"))
    if bracket < 0.5 and found.count() < around.count():  # a sketch was off by more than it promises
        return middles(open_rows, axis, save, 0.5)
    return found


def kd_order(data: SpatialFrame, local: int = LOCAL) -> DataFrame:
    """pos, id, x, y, lo, hi, depth, middle: each point's place, and the node that it belongs to: the
    interval lo to hi (inclusive), split at depth; ``middle`` points split theirs, others are leaves'.

    Ties are broken by id; in a leaf points stand by id. An interval beyond ``local`` points is split
    at its middle, which is found without sorting its rows: a depth takes two scans, and a row is
    sent to its half by comparing it with the middle. All rows are shuffled once, when their
    intervals are small enough to be one task's work.
    """
    need_points(data)
    spark = data.df.sparkSession
    save = Written(spark)
    schema = "pos long, id long, x double, y double, lo long, hi long, depth int, middle boolean"
    done = spark.createDataFrame([], schema)
    points = data.df.select(F.col("id").cast("long").alias("id"), "x", "y")
    n = points.count()
    depth, size, behind = 0, n, []
    if size > max(local, data.node_size + 1):
        points = save(points.withColumn("row", F.monotonically_increasing_id()))
    open_rows = points.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(n - 1).cast("long")})
    while size > max(local, data.node_size + 1):
        axis = "y" if depth % 2 else "x"
        split = middles(open_rows, axis, save)
        done = done.unionByName(split.select(F.col("m").alias("pos"), "id", "x", "y", "lo", "hi", F.lit(depth).alias("depth"), F.lit(True).alias("middle")))
        # a row for each open interval: Spark sends it to all executors while it is small
        cut = split.select("lo", "m", F.struct(axis, "id", "row").alias("at"))
        sides = open_rows.join(cut, "lo").withColumn("own", F.struct(axis, "id", "row")).where("own != at")
        left = F.col("own") < F.col("at")
        open_rows = sides.select(
            "id", "x", "y", "row", F.when(left, F.col("lo")).otherwise(F.col("m") + 1).alias("lo"), F.when(left, F.col("m") - 1).otherwise(F.col("hi")).alias("hi")
        )
        depth += 1
        size = (size + 1) // 2
        if depth % 4 == 0:
            points = save(open_rows)
            open_rows, behind = points, [*behind, points]
            save.drop(*behind[:-1])
    node_size = data.node_size
    rest = open_rows.select("id", "x", "y", "lo", "hi", F.lit(depth).alias("depth")).groupBy("lo").applyInArrow(lambda rows: finish(node_size, rows), schema)
    return done.unionByName(rest)


def kd_partitions(data: SpatialFrame) -> DataFrame:
    """id, lo, hi, depth, middle."""
    return kd_order(data).select("id", "lo", "hi", "depth", "middle")


def kd_nodes(data: SpatialFrame) -> DataFrame:
    """lo, hi, axis (0: x), middle_id (null for leaves), n: one row for each node of the tree."""
    return nodes_of(kd_order(data))


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lo", "hi").agg(
        F.max(F.col("depth") % 2).cast("int").alias("axis"), F.max(F.when(F.col("middle"), F.col("id"))).alias("middle_id"), F.count("*").alias("own")
    ).select("lo", "hi", "axis", "middle_id", (F.col("hi") - F.col("lo") + 1).alias("n"))


def kd_traversal(data: SpatialFrame) -> DataFrame:
    """The nodes with what a walk needs: left_lo, left_hi, right_lo, right_hi (the children's keys, in
    neither of which the middle point is; null for a leaf) and leaf_ids (a leaf's points by id; null
    for others). The root is the node of lo 0 and the largest hi. A leaf has node_size + 1 points at most.
    """
    nodes = kd_order(data).groupBy("lo", "hi").agg(
        F.max(F.col("depth") % 2).cast("int").alias("axis"),
        F.max(F.when(F.col("middle"), F.col("id"))).alias("middle_id"),
        F.sort_array(F.collect_list(F.when(~F.col("middle"), F.col("id")))).alias("ids"),
    )
    m, inner = F.shiftright(F.col("lo") + F.col("hi"), 1), F.col("middle_id").isNotNull()
    keys = {"left_lo": F.col("lo"), "left_hi": m - 1, "right_lo": m + 1, "right_hi": F.col("hi")}
    return nodes.select("lo", "hi", "axis", "middle_id", *[F.when(inner, c).alias(n) for n, c in keys.items()], F.when(~inner, F.col("ids")).alias("leaf_ids"))


def child_nodes(nodes: DataFrame, parents: DataFrame, side: str) -> DataFrame:
    """The rows of ``kd_traversal`` that are the left or right children of some of them."""
    if side not in ("left", "right"):
        raise SpatialError(f"{side} is neither left nor right")
    keys = parents.select(F.col(f"{side}_lo").alias("lo"), F.col(f"{side}_hi").alias("hi"))
    return nodes.join(keys, ["lo", "hi"], "left_semi")
