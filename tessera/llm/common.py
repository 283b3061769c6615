"""Shared pieces of the training-data operators: tables, written intermediates, linking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.tables import Written

T = TypeVar("T")
#: Texts that a Python worker turns into lists at once.
ARROW_ROWS = 1000

#: Words whose hashes a Python worker remembers: about 50 MB.
REMEMBERED = 300_000
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_CACHE: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], T]) -> T:
    """What a Python worker remembers between tasks: the latest kind only, so kinds never add up."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows: what a worker makes of a slice goes before the next. Spark
    bounds a batch itself by bytes (spark.sql.execution.arrow.maxBytesPerBatch) as well as by rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def stretches(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, written: Written) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: columns a, b (long, a != b, in any direction, repeats allowed). Returns node, label
    (smallest node of the component) for every node of an edge other than the label itself. Each
    round is two aggregations with map-side combine and two joins, so a node with very many edges
    is split by AQE instead of meeting in one task; nothing is gathered on the driver but a count.
    """
    cur = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: the larger end gathers its smaller neighbours around the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(joined.select("a", F.col("m").alias("b")))
            .where("a != b")
            .distinct()
        )
        nxt = written(small)
        sign = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        written.drop(cur)
        cur = nxt
        if sign == seen:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = sign


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by their first ``keys`` columns, in tables that hold whole groups, and each group's
    rows: (from, until). Only a group that goes on is held back."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, list[tuple[int, int]]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        fresh = np.zeros(rows.num_rows, bool)
        fresh[:1] = True
        for c in range(keys):
            values = rows.column(c).to_numpy()
            fresh[1:] |= values[1:] != values[:-1]
        begin = np.flatnonzero(fresh).tolist()
        return rows, list(zip(begin, [*begin[1:], rows.num_rows], strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[-1].as_py() for c in range(keys)]
        ends = np.ones(batch.num_rows, bool)  # rows of the batch's last group
        for c in range(keys):
            ends &= batch.column(c).to_numpy(zero_copy_only=False) == last[c]
        start = batch.num_rows - int(ends.sum())
        if start or (held and [held[-1].column(c)[-1].as_py() for c in range(keys)] != last):
            if start:
                held.append(batch.slice(0, start))
            yield out()
            held = []
        held.append(batch.slice(start))
    if held:
        yield out()


def whole_row(docs: DataFrame) -> Column:
    """A row's columns as one struct, so that no name of an operator's own can clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def with_text(docs: DataFrame, text: Column, cut: Column, name: str = "text", length: str | None = None) -> list[Column]:
    """The columns of ``docs`` from struct ``row``, with another text where ``cut`` holds, and there
    with its characters counted anew in column ``length``, if there is such a column."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    new = {name: text.cast(kinds[name])}
    if length in kinds:
        new[length] = F.length(text).cast(kinds[length])
    return [(F.when(cut, new[c]).otherwise(F.col("row").getField(c)) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns]


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """A string column's texts in UTF-8, as they lie in the batch."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words between the six ASCII spaces, A-Z lower-cased, in UTF-8. Bytes are lower-cased and split
    by just these characters."""
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()


def hashed(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = worker_cache("word hashes", dict)
    if len(known) > REMEMBERED:
        known.clear()
    digest = xxhash.xxh64_intdigest
    for w in set(words).difference(known):
        known[w] = digest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
