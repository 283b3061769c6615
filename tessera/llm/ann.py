"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of residuals are fitted by k-means on a bounded sample
(``SAMPLE`` vectors with the lowest hashes); every vector is indexed. A query is compared with the
lists of its nearest centroids, as many as brute force on the sample says that it takes, for vectors
of the sample and for queries: an asymmetric distance table scores all codes of a list, and those that
may be among the best, by how far their vectors are off from their codes, are ranked by the exact
distance on the original vectors.

Equal vectors are one entry that knows its smallest ids, so a vector shared by a third of all rows
is searched once. Lists are dealt in blocks of bounded size, so a hot list is many tasks' work. A
block is sent once for every BLOCK queries that ask for it, and not at all if none does.

Defined cases: vectors null, zero, or with null or non-finite components take no part, nor do those
whose length is not the commonest; of rows with one id the least vector counts; with fewer
candidates than k all are returned; ties go to the smaller id; extra columns are not read; empty
tables give no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Written

#: Vectors that centroids and codebooks are fitted on at most.
SAMPLE = 32_768
#: Lists at most, and vectors of the sample for each at least; they grow with the root of the number
#: of vectors. Beyond some four million vectors lists no longer multiply but lengthen.
LISTS, FOR_LIST = 4_096, 8
#: Share of true neighbours that the searched lists must hold, by brute force on the sample.
COVERED = 0.97
SUBSPACES, CODES = 16, 256
#: Entries of a list, and queries to it, that one task holds at once.
BLOCK = 4_096
#: Vectors of the sample, and queries, whose neighbours brute force finds there.
TRIALS = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centers))
        empty = n == 0
        centers = np.where(empty[:, None], centers, sums / np.maximum(n, 1)[:, None])
        if empty.any():
            centers[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return centers


def squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)


def nearest(x: np.ndarray, centers: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([squares(x[i : i + step], centers).argmin(1) for i in range(0, max(1, len(x)), step)])


@dataclass
class Index:
    centers: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # for each part of the dimensions, codes x its dimensions
    parts: list[slice]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centers)
        rest = x - self.centers[own]
        return own, np.stack([nearest(rest[:, p], b).astype(np.uint8) for p, b in zip(self.parts, self.books, strict=True)], 1)


def fit(x: np.ndarray, lists: int) -> Index:
    centers = kmeans(x, lists)
    rest = x - centers[nearest(x, centers)]
    edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return Index(centers, [kmeans(rest[:, p], CODES) for p in parts], parts)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def listed(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entry, vector -> list, codes, entry, vector."""
    for batch in batches:
        if batch.num_rows:
            own, codes = index.encode(matrix(batch.column(1), index.centers.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(0), batch.column(1)], names=["list", "codes", "entry", "vector"]
            )


@dataclass
class Blocks:
    """Lists dealt to blocks of bounded size: neighbouring lists share one, a large list has several."""

    first: np.ndarray  # of each list
    parts: np.ndarray


def dealt(index: Index, sizes: dict[int, int], most: int) -> Blocks:
    """Lists in the order of their centres' main direction, cut when a block is full."""
    centred = index.centers - index.centers.mean(0)
    main = np.linalg.svd(centred, full_matrices=False)[2][0]
    first, parts = np.zeros(len(centred), np.int64), np.ones(len(centred), np.int64)
    block, held = 0, 0
    for k in np.argsort(centred @ main, kind="stable").tolist():
        n = sizes.get(k, 0)
        if held and held + n > most:
            block, held = block + 1, 0
        first[k], parts[k] = block, max(1, -(-n // most))
        held += n
        if parts[k] > 1:
            block, held = block + int(parts[k]), 0
    return Blocks(first, parts)


def probed(index: Index, blocks: Blocks, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, vector -> a row for each block to search, with the lists to search in it."""
    for batch in batches:
        far = squares(matrix(batch.column(1), index.centers.shape[1]), index.centers) if batch.num_rows else np.empty((0, 1))
        rows, where, lists = [], [], []
        for i, row in enumerate(far):
            near = np.argpartition(row, probes - 1)[:probes] if probes < len(row) else np.arange(len(row))
            near = near[np.argsort(blocks.first[near], kind="stable")]
            for part in np.split(near, np.flatnonzero(np.diff(blocks.first[near])) + 1):
                # a list of several blocks shares none of them
                for extra in range(int(blocks.parts[part].max())):
                    rows.append(i)
                    where.append(int(blocks.first[part[0]]) + extra)
                    lists.append(part[blocks.parts[part] > extra].astype(np.int32))
        if rows:
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(lists, pa.list_(pa.int32()))], names=["block", "query", "vector", "lists"]
            )


FOUND = pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("score", pa.float64())])


def search_block(index: Index, k: int, queries: pa.Table, entries: pa.Table) -> pa.Table:
    """For each query the k best entries of the block, ranked exactly. By the table an entry is as far as
    its codes, give or take how far it is off from them: those that cannot be among the k go unread."""
    if not queries.num_rows or not entries.num_rows:
        return FOUND.empty_table()
    width = index.centers.shape[1]
    q = matrix(queries["vector"].combine_chunks(), width)
    x = matrix(entries["vector"].combine_chunks(), width)
    codes = np.frombuffer(b"".join(entries["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
    ids, owners = entries["entry"].to_numpy(), queries["query"].to_numpy()
    coded = index.centers[entries["list"].to_numpy()]
    for s, (part, book) in enumerate(zip(index.parts, index.books, strict=True)):
        coded[:, part] += book[codes[:, s]]
    # what rounding may add to either distance, too
    off = np.sqrt(((x - coded) ** 2).sum(1)) + 1e-6 * np.sqrt((x**2).sum(1).max() + (q**2).sum(1).max())
    asks: dict[int, list[int]] = {}
    for i, lists in enumerate(queries["lists"].to_pylist()):
        for one in lists:
            asks.setdefault(one, []).append(i)
    candidates: list[list[np.ndarray]] = [[] for _ in range(len(q))]
    about: list[list[np.ndarray]] = [[] for _ in range(len(q))]
    own = entries["list"].to_numpy()
    order = np.argsort(own, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        mine = asks.get(int(own[rows[0]]), [])
        for at in range(0, len(mine), 64):
            some = mine[at : at + 64]
            rest = q[some] - index.centers[own[rows[0]]]
            far = np.zeros((len(some), len(rows)))
            for s, (part, book) in enumerate(zip(index.parts, index.books, strict=True)):
                far += squares(rest[:, part], book)[:, codes[rows, s]]
            for i, line in zip(some, far, strict=True):
                candidates[i].append(rows)
                about[i].append(line)
    out = []
    for i, found in enumerate(candidates):
        if found:
            rows, line = np.concatenate(found), np.sqrt(np.maximum(np.concatenate(about[i]), 0))
            if len(rows) > k:
                bound = np.partition(line + off[rows], k - 1)[k - 1]
                rows = rows[line - off[rows] <= bound]
            exact = np.sqrt(((x[rows] - q[i]) ** 2).sum(1))
            best = np.lexsort((ids[rows], exact))[:k]
            out.append((np.full(len(best), owners[i]), ids[rows[best]], exact[best]))
    if not out:
        return FOUND.empty_table()
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=FOUND)


def probes_for(index: Index, sample: np.ndarray, k: int, target: float, asked: np.ndarray | None = None, trials: int = TRIALS) -> int:
    """The fewest lists a query must search so that they hold ``target`` of the true neighbours,
    measured by brute force against the sample for some of its vectors, and for the queries of
    ``asked``, which may lie elsewhere: the larger of both; all of them for 1."""
    if target >= 1:
        return len(index.centers)
    own = nearest(sample, index.centers)
    most = 0
    for some in (sample[np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int)], asked):
        ranks = []
        for v in () if some is None else some:
            far = ((sample - v) ** 2).sum(1)
            near = np.argsort(far, kind="stable")
            near = near[far[near] > 0][:k]  # entries are distinct: only itself is at zero
            order = np.argsort(squares(v[None], index.centers)[0])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ranks.append(place[own[near]])
        found = np.concatenate(ranks) if ranks else np.empty(0)
        if len(found):
            most = max(most, int(np.quantile(found, target, method="higher")) + 1)
    return min(len(index.centers), most or len(index.centers))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vector of the rows that take part, one for each id."""
    vector = F.col("embedding").cast("array<float>")
    fine = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0)
    plain = F.transform(vector, lambda v: v + F.lit(0.0).cast("float"))  # negative zero is zero
    one = rows.where("vec_id IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    one = one.select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("vector"))
    common = one.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).select("n")
    one = one.join(F.broadcast(common), F.size("vector") == F.col("n"), "left_semi")  # a single row
    return one.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def entries_of(one: DataFrame, k: int) -> DataFrame:
    """vector, entry (its smallest id), ids (its k + 1 smallest): equal vectors are one entry."""
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.element_at("ids", 1))


def neighbours(rows: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` its k nearest found."""
    spark = rows.sparkSession
    written = Written(spark)
    one = written(usable(rows))
    entries = written(entries_of(one, k))
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.select("entry", "vector").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE)
    x = np.array([r["vector"] for r in sample.select("vector").toLocalIterator()], np.float64)
    lists = max(1, min(LISTS, len(x) // FOR_LIST, 1 << round(math.log2(max(1.0, 2 * math.sqrt(n))))))
    index = fit(x, lists)
    filed = written(
        entries.select("entry", "vector").mapInArrow(functools.partial(listed, index), "list int, codes binary, entry long, vector array<float>")
    )
    asked = written(one.where(F.col("vec_id") % every == 0).join(entries.select("vector", "entry"), "vector").select("vec_id", "entry"))
    queries = asked.select("entry").distinct().join(entries.select("entry", "vector"), "entry")
    tried = queries.orderBy(F.xxhash64("entry"), "entry").limit(TRIALS).collect()
    probes = probes_for(index, x, k, COVERED, np.array([r["vector"] for r in tried], np.float64))
    sizes = {r["list"]: r["n"] for r in filed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    blocks = dealt(index, sizes, BLOCK)
    places = [(k, int(blocks.first[k]), int(blocks.parts[k])) for k in sizes]
    places = F.broadcast(spark.createDataFrame(places, "list int, first long, parts long"))
    wanted = written(
        queries.select(F.col("entry").alias("query"), "vector").mapInArrow(
            functools.partial(probed, index, blocks, probes), "block long, query long, vector array<float>, lists array<int>"
        )
    )
    # queries beyond a block's size are dealt to several tasks, each of which sees all of its entries
    demand = written(wanted.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("asks")))
    left = wanted.join(demand, "block").withColumn("ask", F.pmod(F.xxhash64("query"), "asks")).drop("asks")
    right = filed.join(places, "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("entry"), "parts")).join(demand, "block")
    right = right.withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1))).select("block", "ask", "list", "entry", "codes", "vector")
    found = left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInArrow(
        lambda queries, entries: search_block(index, k + 1, queries, entries), "query long, entry long, score double"
    )
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "entry"))).where(F.col("r") <= k + 1)
    named = best.join(entries.select("entry", "ids"), "entry").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    # the nearest entries' ids, (k + 1) squared at most, in order; a query leaves itself out
    each = F.flatten(F.transform("near", lambda e: F.transform(e["ids"], lambda v: F.struct(e["score"].alias("score"), v.alias("vec_id")))))
    named = named.select("query", F.slice(F.sort_array(each), 1, k + 1).alias("near"))
    answers = asked.join(named, asked["entry"] == named["query"]).select(
        F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda v: v["vec_id"] != F.col("vec_id")), 1, k)).alias("at", "hit")
    )
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
