"""Search and stream-static joins on Structured Streaming sources.

The filters keep no state, so they run on a stream as on a table. A join with a static side is an
equality join on grid cells whose sizes follow the static side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.predicates import bbox_intersects
from tessera.operators import grid
from tessera.operators.join import same_cell
from tessera.plans.tables import shared_dir
from tessera.sources.frame import BOX, SpatialFrame


def stream_static_join(stream: SpatialFrame, static: SpatialFrame) -> DataFrame:
    """left (of the stream), right: pairs of boxes that meet, each once; works on tables as well.

    A stream has no statistics, so the grid follows the static side's sizes, counted once when this is
    called. Boxes of the stream are cut to the static side's extent, beyond which nothing meets them:
    that bounds their levels, and static boxes are filed at each of these that is wider than their own.
    """
    left, right = (f.as_boxes().df.select("id", *BOX) for f in (stream, static))
    sizes = grid.upright(grid.sizes_of(right), "static")
    if sizes.endless:  # infinite coordinates lie beyond all finite ones of the stream, which lie beyond the static side's
        left, right = grid.within_extent(grid.within_extent(left, sizes, finite=True), sizes, pads=2), grid.within_extent(right, sizes, pads=2)
        sizes = grid.sizes_of(right)
    x0, y0, x1, y1 = sizes.extent or (0.0, 0.0, 0.0, 0.0)
    base = grid.base_of(sizes)
    left = left.where(bbox_intersects(x0, y0, x1, y1))
    for c, low, high in (("min_x", x0, x1), ("min_y", y0, y1), ("max_x", x0, x1), ("max_y", y0, y1)):
        left = left.withColumn(c, F.greatest(F.lit(low), F.least(F.lit(high), F.col(c))))
    span = max(x1 - x0, y1 - y0)
    top = min(max(math.ceil(math.log2(span)) - base, grid.DEEPEST), grid.WIDEST) if span > 0 else grid.DEEPEST
    levels = sizes.levels(base)

    def met(l: DataFrame, r: DataFrame, most: int) -> DataFrame:  # noqa: E741
        size = grid.width(F.col("l.level"), base)
        corner = (F.floor(F.greatest("l.min_x", "r.min_x") / size) == F.col("l.cx")) & (F.floor(F.greatest("l.min_y", "r.min_y") / size) == F.col("l.cy"))
        l, r = grid.told(l.alias("l"), r.alias("r"), math.inf, most)  # noqa: E741
        return l.join(r, same_cell() & corner).select(F.col("l.id").alias("left"), F.col("r.id").alias("right"))

    # points are at the deepest level, whatever comes
    every = [grid.DEEPEST] if stream.is_points else list(range(grid.DEEPEST, top + 1))
    larger = met(grid.filed(left, base), grid.filed(right, base, every), sizes.filed(base, every))
    return larger.unionByName(met(grid.filed(left, base, levels, above=True), grid.filed(right, base), sizes.filed(base)))


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Everything a stream has now, through a Parquet sink with its own checkpoint."""
    import uuid

    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
