"""Packed index buffers: encoding a frame, as bytes or in pieces, and reading such a buffer as rows.

R-tree buffer: byte 0xfb; version 3 and coordinate type in one byte; node size (16 bits); item count
(32 bits); the boxes of all levels, items first; then an index for each box: an item's insertion
index, or the offset (four to a box) of a node's first child. k-d buffer: byte 0xdb; version 1 and
type; node size; count; ids; zeros to a multiple of eight; coordinates. All little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import SpatialError
from tessera.operators.cluster import tree_nodes
from tessera.operators.kd import kd_order
from tessera.operators.meta import KDTreeMetadata, RTreeMetadata, level_sizes, narrowed
from tessera.sources.frame import BOX, POINT, SpatialFrame, boxes, points

# Fixed values of the two formats.
RTREE_MAGIC, RTREE_VERSION = 0xFB, 3
KD_MAGIC, KD_VERSION = 0xDB, 1
HEADER = 8
TYPES = ("int8", "uint8", "uint8", "int16", "uint16", "int32", "uint32", "float32", "float64")
CODES = {"int8": 0, "uint8": 1, "int16": 3, "uint16": 4, "int32": 5, "uint32": 6, "float32": 7, "float64": 8}
#: Items that a buffer's bytes in one process may have: beyond that it is in pieces.
MOST = 10_000_000
#: Nodes or points that are dealt to a task together, and a run's at most.
PIECE = 65_536


def header(magic: int, version: int, coord_type: str, node_size: int, n: int) -> bytes:
    return struct.pack("<BBHI", magic, version << 4 | CODES[coord_type], node_size, n)


def bounded(n: int) -> None:
    if n > MOST:
        raise SpatialError(f"{n} items are too many for the bytes of one buffer; make it in pieces")


def fitted(data: SpatialFrame, coord_type: str) -> SpatialFrame:
    """The frame with coordinates that the type can hold: boxes are rounded outward to 32-bit floats,
    points to the nearest; integers must hold every value as it is."""
    kind = np.dtype(coord_type)
    if kind == np.float64:
        return data
    if kind == np.float32:
        narrow = (lambda c: F.col(c).cast("float")) if data.is_points else (lambda c: narrowed(c, c.startswith("min")))
        return SpatialFrame(data.df.withColumns({c: narrow(c).cast("double") for c in data.roles}), data.roles, data.node_size, data.others)
    limits = np.iinfo(kind)
    wrong = F.lit(False)
    for c in data.roles:
        wrong = wrong | (F.col(c) != F.floor(F.col(c)).cast("double")) | ~F.col(c).between(float(limits.min), float(limits.max))
    if data.df.where(wrong).limit(1).count():
        raise SpatialError(f"{coord_type} cannot hold all coordinates")
    return data


@dataclass(frozen=True)
class Pieces:
    """A buffer of any size as rows of its bytes: ``at`` (the number of a run's first node, or point),
    ``coords`` and ``numbers`` (the run's parts of the two sections). Runs are made and read by
    executors, so nothing but counts reaches the driver; ``joined`` gives the bytes of a small one."""

    meta: RTreeMetadata | KDTreeMetadata
    rows: DataFrame

    def joined(self) -> bytes:
        bounded(self.meta.num_items)
        rows = self.rows.toArrow()
        order = np.argsort(rows["at"].to_numpy())
        coords, numbers = (b"".join(rows[c].take(pa.array(order)).to_pylist()) for c in ("coords", "numbers"))
        meta = self.meta
        if isinstance(meta, RTreeMetadata):
            return header(RTREE_MAGIC, RTREE_VERSION, meta.coord_type, meta.node_size, meta.num_items) + coords + numbers
        return header(KD_MAGIC, KD_VERSION, meta.coord_type, meta.node_size, meta.num_items) + numbers + bytes(meta.padding) + coords


def pieces_of(meta: RTreeMetadata | KDTreeMetadata, rows: DataFrame) -> Pieces:
    """Rows: at, number and the coordinates. Runs are as long as an Arrow batch, PIECE at most."""
    kind, width, piece = np.dtype(meta.coord_type).newbyteorder("<"), meta.index_width, PIECE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, *places = (c.to_numpy() for c in batch.columns)
            if not len(at):
                continue
            coords, number = np.stack(places, 1).astype(kind), number.astype(f"<u{width}")
            cuts = [0, *(np.flatnonzero((np.diff(at) != 1) | (at[1:] % piece == 0)) + 1).tolist(), len(at)]
            runs = list(zip(cuts[:-1], cuts[1:], strict=True))
            columns = [pa.array(at[cuts[:-1]]), pa.array([coords[i:j].tobytes() for i, j in runs], pa.binary()), pa.array([number[i:j].tobytes() for i, j in runs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "coords", "numbers"])

    dealt = rows.repartition(F.floor(F.col("at") / piece)).sortWithinPartitions("at")
    return Pieces(meta, dealt.mapInArrow(pack, "at long, coords binary, numbers binary"))


def counted(data: SpatialFrame) -> int:
    """The number of items, whose ids are insertion indexes: one job."""
    n, low, high = data.df.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if low is not None and (low < 0 or high >= n):
        raise SpatialError("a buffer's ids are insertion indexes, 0 to the number of items less one")
    return n


def rtree_pieces(data: SpatialFrame, method: str = "hilbert", coord_type: str = "float64") -> Pieces:
    """The packed tree, of as many items as its 32-bit offsets reach. ``method`` orders it."""
    n = counted(data)
    meta = RTreeMetadata(n, data.node_size, coord_type)
    if 4 * meta.num_nodes > 1 << 32:
        raise SpatialError(f"{n} items are too many for offsets of 32 bits")
    begin = np.concatenate([[0], np.cumsum(level_sizes(n, data.node_size))]).tolist()
    first = lambda level: F.get(F.array(*[F.lit(b).cast("long") for b in begin]), level)
    child = F.when(F.col("level") > 0, 4 * (first(F.greatest(F.col("level"), F.lit(1)) - 1) + F.col("child_start"))).otherwise(F.col("id").cast("long"))
    nodes = tree_nodes(fitted(data.as_boxes(), coord_type), method)
    return pieces_of(meta, nodes.select((first(F.col("level")) + F.col("pos")).alias("at"), F.coalesce(child, F.lit(0)).alias("number"), *BOX))


def kdtree_pieces(data: SpatialFrame, coord_type: str = "float64") -> Pieces:
    n = counted(data)
    if n >= 1 << 32:
        raise SpatialError(f"{n} items are too many for a count of 32 bits")
    rows = kd_order(fitted(data, coord_type))
    return pieces_of(KDTreeMetadata(n, data.node_size, coord_type), rows.select(F.col("pos").alias("at"), F.coalesce("id", F.lit(0)).alias("number"), "x", "y"))


def encode_rtree(data: SpatialFrame, method: str = "hilbert", coord_type: str = "float64") -> bytes:
    """The packed tree of at most MOST items as bytes of one process; ``rtree_pieces`` has no such bound."""
    bounded(data.df.count())
    return rtree_pieces(data, method, coord_type).joined()


def encode_kdtree(data: SpatialFrame, coord_type: str = "float64") -> bytes:
    bounded(data.df.count())
    return kdtree_pieces(data, coord_type).joined()


def coord_type_of(buffer: bytes) -> str:
    """The coordinate type that the header names."""
    if len(buffer) < HEADER:
        raise SpatialError(f"{len(buffer)} bytes are no index")
    code = buffer[1] & 15
    if buffer[0] not in (RTREE_MAGIC, KD_MAGIC) or code >= len(TYPES):
        raise SpatialError("the buffer is no index")
    return TYPES[code]


def opened(buffer: bytes, magic: int, version: int, kind: type) -> tuple:
    coord_type = coord_type_of(buffer)
    first, second, node_size, n = struct.unpack_from("<BBHI", buffer)
    if first != magic:
        raise SpatialError("the buffer is an index of another kind")
    if second >> 4 != version:
        raise SpatialError(f"version {second >> 4} is not {version}")
    meta = kind(n, node_size, coord_type)
    if len(buffer) != meta.num_bytes:
        raise SpatialError(f"{meta.num_bytes} bytes are expected, there are {len(buffer)}")
    return meta, np.dtype(coord_type).newbyteorder("<")


RTREE_ROW = "pos long, id long, min_x double, min_y double, max_x double, max_y double"
KD_ROW = "pos long, id long, x double, y double"


def rtree_items(buffer: bytes) -> pa.Table:
    """id and box of every item, by packed position."""
    meta, kind = opened(buffer, RTREE_MAGIC, RTREE_VERSION, RTreeMetadata)
    corners = np.frombuffer(buffer, kind, 4 * meta.num_nodes, HEADER).reshape(-1, 4)[: meta.num_items].astype(np.float64)
    at = HEADER + 4 * meta.num_nodes * kind.itemsize
    ids = np.frombuffer(buffer, f"<u{meta.index_width}", meta.num_nodes, at)[: meta.num_items].astype(np.int64)
    return pa.table([np.arange(len(ids)), ids, *np.ascontiguousarray(corners.T)], ["pos", "id", *BOX])


def kdtree_items(buffer: bytes) -> pa.Table:
    meta, kind = opened(buffer, KD_MAGIC, KD_VERSION, KDTreeMetadata)
    ids = np.frombuffer(buffer, f"<u{meta.index_width}", meta.num_items, HEADER).astype(np.int64)
    at = HEADER + meta.num_items * meta.index_width + meta.padding
    coords = np.frombuffer(buffer, kind, 2 * meta.num_items, at).reshape(-1, 2).astype(np.float64)
    return pa.table([np.arange(len(ids)), ids, *np.ascontiguousarray(coords.T)], ["pos", "id", "x", "y"])


def unpacked(pieces: Pieces, columns: tuple[str, ...], row: str) -> DataFrame:
    """The items in a buffer's pieces, by their packed position: read where the pieces lie."""
    meta = pieces.meta
    kind, n = np.dtype(meta.coord_type).newbyteorder("<"), meta.num_items

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, coords, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(numbers, f"<u{meta.index_width}")[: max(0, n - at)].astype(np.int64)
                if len(ids):
                    places = np.frombuffer(coords, kind).reshape(-1, len(columns))[: len(ids)].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(ids))), pa.array(ids), *map(pa.array, np.ascontiguousarray(places.T))], names=["pos", "id", *columns])

    return pieces.rows.mapInArrow(unpack, row)


def decode_rtree(spark: SparkSession, buffer: bytes | Pieces) -> DataFrame:
    """pos, id and box of every item of a buffer, in memory or in pieces."""
    if isinstance(buffer, Pieces):
        if not isinstance(buffer.meta, RTreeMetadata):
            raise SpatialError("the buffer is an index of another kind")
        return unpacked(buffer, BOX, RTREE_ROW)
    return spark.createDataFrame(rtree_items(bytes(buffer)), RTREE_ROW)


def decode_kdtree(spark: SparkSession, buffer: bytes | Pieces) -> DataFrame:
    if isinstance(buffer, Pieces):
        if not isinstance(buffer.meta, KDTreeMetadata):
            raise SpatialError("the buffer is an index of another kind")
        return unpacked(buffer, POINT, KD_ROW)
    return spark.createDataFrame(kdtree_items(bytes(buffer)), KD_ROW)


def is_rtree(head: bytes) -> bool:
    """Which of the two kinds a header is; an error if it is neither."""
    coord_type_of(head)
    return head[0] == RTREE_MAGIC


def read_buffers(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, id and box or point of every item of all buffers that a path or pattern names. They
    are of one kind. Executors read and decode them, a file in one piece (2 GB at most)."""
    files = spark.read.format("binaryFile").load(path)
    heads = files.select(F.substring("content", 1, HEADER).alias("head")).distinct().limit(1).collect()
    if not heads:
        raise SpatialError(f"{path} holds no buffer")
    read, row = (rtree_items, RTREE_ROW) if is_rtree(bytes(heads[0]["head"])) else (kdtree_items, KD_ROW)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                found = read(content.as_py())
                found = found.add_column(0, "path", pa.array([name.as_py()] * found.num_rows, pa.string()))
                yield from found.to_batches(100_000)

    return files.select("path", "content").mapInArrow(decode, f"path string, {row}")


def open_index(spark: SparkSession, source: SpatialFrame | DataFrame | bytes | str) -> SpatialFrame:
    """A frame from anything that holds an index: a frame, a table with the columns of one, a buffer
    (bytes, bytearray or memoryview) or the path of one. The header tells the kind and the node size."""
    if isinstance(source, SpatialFrame):
        return source
    if isinstance(source, DataFrame):
        return boxes(source) if set(BOX) <= set(source.columns) else points(source)
    if isinstance(source, str):
        head = bytes(spark.read.format("binaryFile").load(source).select(F.substring("content", 1, HEADER)).first()[0])
        rows = read_buffers(spark, source)
    else:
        head = bytes(source[:HEADER])
        rows = (decode_rtree if is_rtree(head) else decode_kdtree)(spark, source)
    node_size = struct.unpack_from("<BBHI", head)[2] if len(head) == HEADER else 0
    return boxes(rows, node_size=node_size) if is_rtree(head) else points(rows, node_size=node_size)


def metadata_of(source: SpatialFrame | bytes, coord_type: str = "float64") -> RTreeMetadata | KDTreeMetadata:
    """The metadata of a buffer in memory, validated, or of a frame, by one count."""
    if isinstance(source, SpatialFrame):
        kind = KDTreeMetadata if source.is_points else RTreeMetadata
        return kind(source.df.count(), source.node_size, coord_type)
    raw = bytes(source)
    if is_rtree(raw):
        return opened(raw, RTREE_MAGIC, RTREE_VERSION, RTreeMetadata)[0]
    return opened(raw, KD_MAGIC, KD_VERSION, KDTreeMetadata)[0]


def coord_type_of_column(df: DataFrame, name: str) -> str:
    """The coordinate type that a column's own type corresponds to; a bigint has none, since no
    buffer holds 64-bit integers."""
    kinds = {"tinyint": "int8", "smallint": "int16", "int": "int32", "float": "float32", "double": "float64"}
    found = dict(df.dtypes)[name]
    if found not in kinds:
        raise SpatialError(f"{name} is {found}: not a coordinate type")
    return kinds[found]
