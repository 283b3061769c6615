"""Packing of tokenised documents into sequences by first-fit decreasing.

Every document becomes its ids and an end id, cut into whole sequences and a remainder. The
remainders meet in randomised groups of bounded size; in each group they are placed longest first
into the first sequence with room, found through a tournament tree of the sequences' free room.
Ids are never shuffled: a piece's checksum is taken where the text was encoded.

Defined cases: a null or empty text is its end id alone; repeated rows are packed as often as they
occur; null doc_ids pass through; a text of any length gives as many whole sequences as it fills;
extra columns are not read; an empty table packs to no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import Written, small

#: Remainders in a group, on average: bounds a task's memory, and a group wastes one sequence at most.
GROUP = 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(tokenizer: str, width: int, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sequences and the remainder of each document."""
    known = bpe.id_bytes(tokenizer)
    table = known.table
    tail = np.array([end], "<u4").tobytes()
    for batch in small(batches):
        rows: list[tuple] = []
        lists = known.prepare(batch.column(1).to_pylist())
        for doc_id, chunks in zip(batch.column(0).to_pylist(), lists, strict=True):
            ids = b"".join([table[c] for c in chunks]) + tail
            total = len(ids) // 4
            for start in range(0, total, width):
                part = ids[4 * start : 4 * (start + width)]
                rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        )


def first_fit(lengths: list[int], width: int) -> list[int]:
    """The bin of each length, given longest first. A tournament tree holds the free room of all
    bins that may be needed; its winner upwards from the left is the first bin with room."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    tree = [width] * (2 * leaves)
    bins = []
    for need in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bins.append(at - leaves)
        tree[at] -= need
        while at > 1:
            at //= 2
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
    return bins


def pack_group(width: int, key: tuple, rows: pa.Table) -> pa.Table:
    lengths = rows["length"].to_numpy()
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    bins = np.array(first_fit(lengths.tolist(), width), np.int64)
    by_bin = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[by_bin]) - lengths[by_bin]
    begun = np.concatenate([[True], np.diff(bins[by_bin]) != 0])
    offsets = np.empty_like(lengths)
    offsets[by_bin] = before - np.maximum.accumulate(np.where(begun, before, 0))
    rows = rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).take(pa.array(order))
    sequences = -1 - (key[0].as_py() * GROUP_SPAN + bins)
    return rows.append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))


#: More sequences than a group can open: group numbers times this keep sequence ids apart.
GROUP_SPAN = 1 << 31


def pack(docs: DataFrame, tokenizer: str, width: int = 4096, end: int = 2, group: int = GROUP) -> DataFrame:
    """One row for each piece. Remainders are grouped by a random number, so no key can gather rows
    in one task; whole sequences need no shuffle at all.

    Whole sequences are numbered from 0 by row, those of remainders from -1 downwards by group.
    """
    spark = docs.sparkSession
    written = Written(spark)
    pieces = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(functools.partial(cut, tokenizer, width, end), PIECE)
        .withColumn("row", F.monotonically_increasing_id())
    )
    n = pieces.where(F.col("length") < width).count()
    groups = max(1, n // group)
    whole = pieces.where(F.col("length") == width).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = (
        pieces.where(F.col("length") < width)
        .withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(lambda key, rows: pack_group(width, key, rows), OUT)
    )
    return whole.unionByName(rest)
