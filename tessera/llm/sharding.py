"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows of equal text are one atomic group. Groups stand in the order of a hash of their text, and the
row of groups is cut into shards so that the largest shard is as small as can be: the smallest
capacity for which a greedy walk needs no more shards than there are is found by binary search.

The walk runs on the driver over a bounded summary, never over the groups: bytes are summed in
ranges of the hash, and only ranges where a cut may fall are split further, until the walk that may
cut anywhere in a range and the walk that may cut only between ranges give the same capacity. That
capacity is then exact; within it the cuts are set as evenly as they can be. A group larger than an even share gets a shard of its own, and the others
share the remaining shards.

Defined cases: a null text has no bytes and groups with empty texts; repeated rows stay together,
each with its own slot; null doc_ids come first in a group's order; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Written, stretches

#: Bits of a group's place in the order.
PLACE = 60
#: Bits of the first summary, and by how many a range is split.
FIRST, MORE = 14, 7
#: Bytes that a row takes besides its text.
OVERHEAD = 8


def walk(sizes: list[int], fluid: list[bool], capacity: int, shards: int) -> list[float] | None:
    """Where a greedy walk cuts (a range's number, or within it if fluid), None if shards run out."""
    cuts: list[float] = []
    room = capacity
    for k, size in enumerate(sizes):
        if size <= room:
            room -= size
            continue
        if not fluid[k]:
            if size > capacity:
                return None
            cuts.append(k)
            room = capacity - size
        else:
            size -= room
            cuts.append(k + 0.5)
            more, last = divmod(size, capacity)
            if last == 0 and more:
                more, last = more - 1, capacity
            cuts += [k + 0.5] * more
            room = capacity - last
        if len(cuts) >= shards:
            return None
    return cuts


def smallest(sizes: list[int], fluid: list[bool], shards: int, low: int, high: int) -> int:
    """The smallest capacity that suffices, by binary search."""
    while low < high:
        middle = (low + high) // 2
        if walk(sizes, fluid, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def summarize(groups: DataFrame, ranges: list[tuple[int, int]], width: int) -> list[tuple[int, int, bool]]:
    """(begin, bytes, single) of the filled ranges of ``width`` bits within the given stretches."""
    inside = groups
    if ranges:
        place = F.col("place")
        where = F.lit(False)
        for a, b in ranges:
            where = where | ((place >= a) & (place < b))
        inside = groups.where(where)
    rows = (
        inside.groupBy(F.shiftright("place", width).alias("r"))
        .agg(F.sum("size").alias("size"), F.min("place").alias("low"), F.max("place").alias("high"))
        .collect()
    )
    return sorted((r["r"] << width, int(r["size"]), r["low"] == r["high"]) for r in rows)


def cut_places(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """The places at which shards after the first begin, and the capacity of the fullest.

    ``groups``: place (long, distinct), size. The driver holds at most 2**FIRST ranges and, round by
    round, the parts of those few in which a cut may fall.
    """
    width = PLACE - FIRST
    parts = {b: (width, size, single) for b, size, single in summarize(groups, [], width)}
    while True:
        begins = sorted(parts)
        sizes = [parts[b][1] for b in begins]
        fluid = [not parts[b][2] for b in begins]
        solid = [False] * len(begins)
        total = sum(sizes)
        if not total:
            return [], 0
        least = max(-(-total // shards), max((s for s, f in zip(sizes, fluid, strict=True) if not f), default=0))
        low = smallest(sizes, fluid, shards, least, total)
        high = smallest(sizes, solid, shards, low, total)
        if low == high:
            return [begins[c] for c in even_cuts(sizes, high, shards) if c < len(begins)], high
        # the k-th cut lies between those of the strictest and of the loosest walk
        late = walk(sizes, fluid, high, shards)
        early = strict_walk(sizes, fluid, low)
        open_parts = set()
        for k, first in enumerate(early):
            until = late[k] if k < len(late) else len(sizes) - 1
            open_parts.update(i for i in range(int(first), int(until) + 1) if i < len(sizes) and fluid[i])
        by_width: dict[int, list[int]] = {}
        for i in open_parts:
            by_width.setdefault(parts[begins[i]][0], []).append(begins[i])
        for width, found in by_width.items():
            ranges = joined([(b, b + (1 << width)) for b in sorted(found)])
            for b in found:
                del parts[b]
            finer = max(0, width - MORE)
            for b, size, single in summarize(groups, ranges, finer):
                parts[b] = (finer, size, single or finer == 0)


def strict_walk(sizes: list[int], fluid: list[bool], capacity: int) -> list[int]:
    """The earliest range in which each cut can fall: a fluid range that does not fit is cut at its start."""
    cuts, room = [], capacity
    for k, size in enumerate(sizes):
        if size > room:
            cuts.append(k)
            room = max(0, capacity - size)
        else:
            room -= size
    return cuts


def even_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """The range with which each shard after the first begins: of the cuts that keep every shard
    within the capacity, those nearest an even share of what is left."""
    reach = [0, *itertools.accumulate(sizes)]
    earliest, at = [], len(sizes)  # where a shard may begin so that the rest fits in those after it
    for _ in range(shards - 1):
        at = bisect.bisect_left(reach, reach[at] - capacity)
        earliest.append(at)
    cuts, last = [], 0
    for k, first in enumerate(reversed(earliest), 1):
        goal = reach[last] + (reach[-1] - reach[last]) / (shards - k + 1)
        near = bisect.bisect_left(reach, goal)
        if near and goal - reach[near - 1] < reach[min(near, len(sizes))] - goal:
            near -= 1
        latest = bisect.bisect_right(reach, reach[last] + capacity) - 1
        last = min(max(near, first, last), latest)
        cuts.append(last)
    return cuts


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null under this law).

    Slots are counted without a window over a shard: rows are range-partitioned by (shard, place,
    doc_id), numbered in their partition, and start from the counts of the partitions before.
    """
    spark = docs.sparkSession
    written = Written(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
            "doc_id",
            (F.octet_length("t") + OVERHEAD).cast("long").alias("size"),
            F.crc32("t").alias("text_crc32"),
            F.conv(F.substring(F.md5("t"), 1, PLACE // 4), 16, 10).cast("long").alias("place"),
        )
    )
    groups = written(rows.groupBy("place").agg(F.sum("size").alias("size")))
    # groups beyond an even share of what is left stand alone; there can be at most ``shards`` of them
    largest = [(int(r["place"]), int(r["size"])) for r in groups.orderBy(F.desc("size"), "place").limit(shards).collect()]
    rest = int(groups.agg(F.sum("size")).first()[0] or 0)
    alone: list[int] = []
    for place, size in largest:
        if shards - len(alone) > 1 and size * (shards - len(alone)) > rest:
            alone.append(place)
            rest -= size
    others = groups.where(~F.col("place").isin(alone)) if alone else groups
    cuts, _ = cut_places(others, shards - len(alone))
    number = F.lit(len(alone))
    for c in cuts:
        number = number + F.when(F.col("place") >= c, 1).otherwise(0)
    for k, place in enumerate(alone):
        number = F.when(F.col("place") == place, k).otherwise(number)
    dealt = (
        rows.withColumn("shard", number.cast("int"))
        .repartitionByRange(stretches(spark), "shard", "place", "doc_id")
        .sortWithinPartitions("shard", "place", "doc_id")
    )
    # monotonically_increasing_id is (partition, row in it); both are kept, as reading deals rows anew
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    starts = dealt.groupBy("part", "shard").agg(F.min("at").alias("from"), F.count("*").alias("n")).collect()  # partitions + shards rows
    begun: dict[int, int] = {}
    offsets = []
    for r in sorted(starts, key=lambda r: (r["shard"], r["part"])):
        offsets.append((r["part"], r["shard"], begun.get(r["shard"], 0) - r["from"]))
        begun[r["shard"]] = begun.get(r["shard"], 0) + r["n"]
    table = F.broadcast(spark.createDataFrame(offsets, "part int, shard int, shift long"))
    return dealt.join(table, ["part", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
