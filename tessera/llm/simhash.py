"""SimHash near-duplicates: pigeonhole blocks, Hamming check, linked groups.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Two fingerprints at
``distance`` bits or fewer agree in all but ``distance`` of any partition of the bits, so with
``blocks`` blocks they share the value of some choice of ``blocks - distance`` of them: every
choice is a table, its blocks' bits the key. Distinct fingerprints meet on equal keys, are verified
by counting differing bits, and what links is written as a spanning forest of each bucket, never as
all pairs: the buckets are searched breadth first over those not yet reached.

``near_groups`` does so for fingerprints of 64 bits and loses no link. ``one_of_each`` keeps one text of
each group whose five-word shingles agree to 0.8: too far for exact pigeonhole tables, so wide
fingerprints meet on any of many equal blocks. Those that a first comparison connects are a group of
candidates, each fingerprint in one group only, and are searched breadth first on all of their bits, so
no link is lost to a spanning forest of mere candidates.

Defined cases: null and empty texts and texts without a word have fingerprint zero and link like
any other; repeated rows share a fingerprint; null doc_ids never become a component's id unless no
other row is in it (then null); extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Written, components, hashed, raw_texts, small, stretches, whole_groups, whole_row, words_of

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
SEED = 42
#: Wide fingerprints: SKETCH bits for a first comparison, then those that blocks are taken from.
SKETCH, BITS_WIDE = 128, 1856
#: Texts whose five-word shingles agree to 0.8 (Jaccard) differ in this share of the bits on average;
#: such a pair shares a block with this probability.
MEAN, FOUND = 0.1515, 0.994
#: Bits of a block at least; of texts that have nothing in common a bucket should hold so many.
BLOCK_BITS, STRANGERS = 18, 256
LANES = np.array([(0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64) for k in range(BITS_WIDE // 64)], np.uint64)
#: Share of all bits, and number of the sketch's, that may differ: a pair at 0.8 passes the first
#: comparison with a probability of 0.999, two unrelated texts with one of some 10^-8.
DIFFER, NEAR = 0.168, 32
#: Rows of one bucket that one task holds at once; larger buckets are met chunk by chunk.
CHUNK = 32768


def fingerprint(text: str | bytes | None, width: int = 3) -> int:
    words = words_of(text)
    if not words:
        return 0
    raw = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(raw, SEED)
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    begin = [0, *(gaps[: len(words) - width] + 1).tolist()]
    end = [*gaps[width - 1 :].tolist(), len(raw)]
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        fps = np.array([fingerprint(t, width) for t in raw_texts(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        functools.partial(fingerprints, width), "doc_id long, fp long"
    )


def masks(distance: int, blocks: int) -> list[int]:
    """For each table, the bits that its key takes."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(parts, blocks - distance)]


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ, of fingerprints (uint64) or of rows of several such words."""
    counts = np.bitwise_count(x ^ y)
    return counts.sum(-1) if counts.ndim > 1 else counts


def forest(fps: np.ndarray, distance: float) -> list[tuple[int, int]]:
    """Spanning links (by place) of the fingerprints that are within distance of each other."""
    links = []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = differing(fps[rest], fps[one]) <= distance
            if near.any():
                found = rest[near].tolist()
                links += [(int(one), f) for f in found]
                front += found
                rest = rest[~near]
    return links


#: Buckets up to this size are compared all with all, many buckets at a time.
SMALL = 48


def bucket_forest(fps: np.ndarray, cuts: list[tuple[int, int]], distance: float) -> list[tuple[int, int]]:
    """Spanning links (by place) within each bucket, its rows from one cut to the other."""
    sizes = np.array([hi - lo for lo, hi in cuts])
    bucket = np.repeat(np.arange(len(cuts)), sizes)
    small = np.flatnonzero((sizes <= SMALL)[bucket])
    links: list[tuple[int, int]] = []
    step = 1
    while len(small):  # rows that still have one of their bucket ``step`` rows on
        small = small[small + step < len(fps)]
        small = small[bucket[small] == bucket[small + step]]
        near = small[differing(fps[small], fps[small + step]) <= distance]
        links += zip(near.tolist(), (near + step).tolist(), strict=True)
        step += 1
    links = spanning(links)
    for k in np.flatnonzero(sizes > SMALL).tolist():
        lo, hi = cuts[k]
        links += [(lo + x, lo + y) for x, y in forest(fps[lo:hi], distance)]
    return links


def stars(links: list[tuple[int, int]], ids: np.ndarray) -> list[tuple[int, int]]:
    """For what links connect, the smallest id with each other one."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            above.update({y: x} if ids[x] < ids[y] else {x: y})
    return [(int(ids[root(x)]), int(ids[x])) for x in {x for link in links for x in link} if root(x) != x]


def one_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """b, a sorted by both: of each b its centres a, one for each bucket at most -> links that connect
    the same: the least centre with b and with the others. Many members have the same centres."""
    for rows, _ in whole_groups(batches, 1):
        b, a = rows["b"].to_numpy(), rows["a"].to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        least = np.repeat(a[begin], np.diff(np.append(begin, len(b))))
        links = np.unique(np.concatenate([np.stack([a[begin], b[begin]], 1), np.stack([least, a], 1)[least != a]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def bucket_links(distance: float, bits: tuple[str, ...], batches: Iterator[pa.RecordBatch], star: bool = False) -> Iterator[pa.RecordBatch]:
    """key, i, j, id and fingerprints in columns ``bits``, sorted by bucket (key, i, j) -> a, b: spanning
    links of each bucket, or stars that connect the same. One column of longs, several, or one of bytes."""
    for rows, cuts in whole_groups(batches, 3):
        ids = rows["id"].to_numpy()
        if pa.types.is_binary(rows.schema.field(bits[0]).type):
            fps = np.frombuffer(b"".join(rows[bits[0]].to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        else:
            fps = np.stack([rows[c].to_numpy().view(np.uint64) for c in bits], 1)
        links = bucket_forest(fps[:, 0] if fps.shape[1] == 1 else fps, cuts, distance)
        if links:
            pairs = np.array(stars(links, ids)) if star else ids[np.array(links)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links without those between rows that earlier ones connect."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    kept = []
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            above[y] = x
            kept.append((a, b))
    return kept


def fingerprint_links(fps: DataFrame, distance: int, blocks: int, chunk: int = CHUNK) -> DataFrame:
    """a, b (fingerprints as longs): links that connect all that are within distance."""
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for t, m in enumerate(masks(distance, blocks))]
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("x")).select(F.xxhash64("x.t", "x.k").alias("key"), "fp", F.col("fp").alias("id"))
    return buckets(keyed, chunk).mapInArrow(functools.partial(bucket_links, distance, ("fp",)), "a long, b long")


def buckets(keyed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``keyed`` (key, id and fingerprints; an id comes once in a bucket) with key, i, j,
    sorted by bucket, each whole in one partition.

    A bucket beyond ``chunk`` rows is dealt into chunks by hash, and every two chunks meet in a
    bucket of their own, so no task holds more than about two chunks and no pair is missed. Such
    buckets are counted with map-side combine and written; Spark checks their size before it sends
    them to all executors.
    """
    spark = keyed.sparkSession
    large = Written(spark)(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk))
    met = keyed.join(large, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / F.lit(chunk)), F.lit(1)).cast("long"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *[c for c in keyed.columns if c != "key"])
    return met.repartition(stretches(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def near_groups(docs: DataFrame, distance: int = 3, blocks: int = 6, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), fp, component_id of every row of docs."""
    written = Written(docs.sparkSession)
    marked = written(with_fingerprints(docs, width))
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(fingerprint_links(fps.select("fp"), distance, blocks), written)
    linked = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    groups = linked.join(least, "label").select("fp", "component_id")
    return marked.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp"
    )


def one_of_each(docs: DataFrame, differ: float = DIFFER) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of its smallest doc_id, then of the
    least text mark.

    Similar: five-word shingles agree to 0.8 or more, estimated from the share of bits that differ
    between two wide fingerprints. Rows are known by doc_id and a mark of their text (xxhash64).
    Texts go through Arrow once and are shuffled once, by that pair; of repeated rows all but one go
    before the shuffle.
    """
    spark = docs.sparkSession
    written = Written(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_mark().alias("mark"))
    marked = written(given.mapInArrow(wide_rows, "doc_id long, mark long, id long, bits binary"))
    # of each fingerprint and of each group the smallest id, then the least mark; null ids come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")).alias("first")
    wide = written(marked.groupBy("id").agg(F.min("bits").alias("bits"), first))
    labels = components(similar_links(wide.select("id", "bits"), differ), written)
    linked = wide.select("id", "first").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    keep = written(linked.groupBy("label").agg(F.min("first").alias("first")).select("first.*"))
    keys = ["none", "id", "mark"]
    named = docs.select(whole_row(docs), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_mark().alias("mark"))
    one = named.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where("nth = 1")
    return one.join(keep.hint("merge"), keys, "left_semi").select("row.*")


def text_mark() -> Column:
    """xxhash64 of the text; a null text is told apart from an empty one."""
    return F.xxhash64(F.col("text").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))


def wide_bits(text: str | bytes | None, width: int = 5) -> np.ndarray:
    """0 or 1 for each of BITS_WIDE bits: the majority over the text's distinct word shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(BITS_WIDE, np.uint8)
    hashes = hashed(words)
    n = max(1, len(words) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    mixed = np.unique(mixed)
    counts = np.zeros(BITS_WIDE, np.int64)
    for at in range(0, len(mixed), 255):  # sums of 255 bits fit a byte
        x = mixed[at : at + 255, None] ^ LANES
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (2 * counts > len(mixed)).astype(np.uint8)


def wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        bits = [np.packbits(wide_bits(t), bitorder="little").tobytes() for t in raw_texts(batch.column("text"))]
        ids = np.array([xxhash.xxh64_intdigest(b) for b in bits], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(ids), pa.array(bits, pa.binary())], names=["doc_id", "mark", "id", "bits"])


def blocks_for(n: int) -> np.ndarray:
    """The bits of each block, for so many fingerprints: blocks x bits, places beyond the sketch.

    A block grows by a bit with every doubling beyond STRANGERS fingerprints a value, so buckets of
    unrelated texts do not grow with the table; as longer blocks agree less often, there are more of
    them (96 of 18 bits, then of 19 ...). While the bits suffice each is in one block.
    """
    bits = max(BLOCK_BITS, math.ceil(math.log2(max(n, 1) / STRANGERS)))
    blocks = math.ceil(math.log1p(-FOUND) / math.log1p(-((1 - MEAN) ** bits)))
    rng = np.random.default_rng(bits)
    free, rows = np.empty(0, np.int64), []
    for _ in range(blocks):
        if len(free) < bits:
            free = np.arange(SKETCH, BITS_WIDE) if not rows else rng.permutation(np.arange(SKETCH, BITS_WIDE))
        rows.append(free[:bits])
        free = free[bits:]
    return np.array(rows)


def block_rows(blocks: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, bits -> a row for each block: key (block and its bits), the sketch, id."""
    weights = np.uint64(1) << np.arange(blocks.shape[1], dtype=np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    # one to one for each block: only two blocks' keys can be equal by chance
    salts = np.array([xxhash.xxh64_intdigest(b"block", k) for k in range(len(blocks))], np.uint64)
    for batch in small(batches, 500):
        raw = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        keys = (np.stack([(bits[:, b] * weights).sum(1, dtype=np.uint64) for b in blocks], 1) ^ salts) * odd
        sketch = np.repeat(np.ascontiguousarray(raw[:, : SKETCH // 8]).view(np.int64), len(blocks), 0).T
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), len(blocks))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *[pa.array(np.ascontiguousarray(x)) for x in sketch], pa.array(ids)], names=["key", "s0", "s1", "id"])


def similar_links(wide: DataFrame, differ: float = DIFFER, chunk: int = CHUNK) -> DataFrame:
    """a, b (ids): links between wide fingerprints of which a share of at most ``differ`` bits differs.

    Two that share the bits of any block meet. What the sketches connect over all buckets is a group
    of candidates, found as components of each bucket's spanning links; a fingerprint is in one group
    only, however many blocks it shares. Only links that all bits verify span a group, since a forest
    of the candidates could pass by a true link. Rows of groups and links grow with the rows, not
    their square, but for groups beyond ``chunk``, of which every two chunks meet.
    """
    spark = wide.sparkSession
    written = Written(spark)
    keyed = wide.mapInArrow(functools.partial(block_rows, blocks_for(wide.count())), "key long, s0 long, s1 long, id long")
    rough = buckets(keyed, chunk).mapInArrow(functools.partial(bucket_links, NEAR, ("s0", "s1"), star=True), "a long, b long")
    # a member of many buckets has as many centres, which most of its group share: reduced before any join
    dealt = rough.select("b", "a").repartition(stretches(spark), "b").sortWithinPartitions("b", "a")
    labels = components(dealt.mapInArrow(one_star, "a long, b long"), written)
    groups = labels.select(F.col("label").alias("key"), F.col("node").alias("id"))
    groups = groups.unionByName(groups.select("key", F.col("key").alias("id")).distinct())
    met = written(groups.join(wide.select("id", "bits"), "id").select("key", "bits", "id"))
    return buckets(met, chunk).mapInArrow(functools.partial(bucket_links, differ * BITS_WIDE, ("bits",)), "a long, b long")
