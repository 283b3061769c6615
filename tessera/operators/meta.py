"""Tree shapes and sizes: arithmetic on a count, and the outward rounding of boxes to 32 bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import SpatialError
from tessera.sources.frame import BOX, SpatialFrame

#: Bytes of a coordinate.
WIDTHS = {"int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "int32": 4, "uint32": 4, "float32": 4, "float64": 8}


def check_node_size(node_size: int) -> None:
    if not 2 <= node_size <= 65535:
        raise SpatialError(f"node size {node_size} is not within 2 to 65535")


def level_sizes(n: int, node_size: int) -> list[int]:
    """Nodes of each level from the items up; a tree of one item is that item alone."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // node_size))
    return sizes


def width_of(coord_type: str) -> int:
    try:
        return WIDTHS[{"f32": "float32", "f64": "float64"}.get(coord_type.lower(), coord_type.lower())]
    except KeyError:
        raise SpatialError(f"{coord_type} is no coordinate type") from None


@dataclass(frozen=True)
class RTreeMetadata:
    num_items: int
    node_size: int = 16
    coord_type: str = "float64"

    def __post_init__(self) -> None:
        check_node_size(self.node_size)
        width_of(self.coord_type)

    @property
    def num_nodes(self) -> int:
        return sum(level_sizes(self.num_items, self.node_size))

    @property
    def num_levels(self) -> int:
        return len(level_sizes(self.num_items, self.node_size))

    @property
    def level_bounds(self) -> list[int]:
        """Where each level ends among the coordinates, four to a node, from the items up."""
        out, at = [], 0
        for size in level_sizes(self.num_items, self.node_size):
            at += size
            out.append(4 * at)
        return out

    @property
    def index_width(self) -> int:
        return 2 if self.num_nodes < 16384 else 4

    @property
    def num_bytes(self) -> int:
        return 8 + self.num_nodes * (4 * width_of(self.coord_type) + self.index_width)


@dataclass(frozen=True)
class KDTreeMetadata:
    num_items: int
    node_size: int = 64
    coord_type: str = "float64"

    def __post_init__(self) -> None:
        check_node_size(self.node_size)
        width_of(self.coord_type)

    @property
    def index_width(self) -> int:
        return 2 if self.num_items < 65536 else 4

    @property
    def padding(self) -> int:
        return -(self.num_items * self.index_width) % 8

    @property
    def num_bytes(self) -> int:
        return 8 + self.num_items * self.index_width + self.padding + 2 * self.num_items * width_of(self.coord_type)


def rtree_metadata(data: SpatialFrame, coord_type: str = "float64") -> DataFrame:
    """One row from one count."""
    m = RTreeMetadata(data.df.count(), data.node_size, coord_type)
    row = (m.num_items, m.node_size, m.num_nodes, m.num_levels, ",".join(map(str, m.level_bounds)), m.num_bytes)
    return data.df.sparkSession.createDataFrame([row], "num_items long, node_size long, num_nodes long, num_levels long, level_bounds string, num_bytes long")


def kdtree_metadata(data: SpatialFrame, coord_type: str = "float64") -> DataFrame:
    m = KDTreeMetadata(data.df.count(), data.node_size, coord_type)
    return data.df.sparkSession.createDataFrame([(m.num_items, m.node_size, m.num_bytes)], "num_items long, node_size long, num_bytes long")


#: Six tenths of the gap to the next 32-bit number, or up to twice that: rounding lands on the neighbour.
NUDGE, LEAST = 0.6 * 2.0**-23, 0.75 * 2.0**-149


def narrowed(name: str, down: bool) -> Column:
    """The nearest 32-bit number that is not inside of the 64-bit one."""
    value = F.col(name)
    near = value.cast("float").cast("double")
    step = F.greatest(F.abs(near) * F.lit(NUDGE), F.lit(LEAST))
    wrong, moved = (near > value, near - step) if down else (near < value, near + step)
    return F.when(wrong, moved.cast("float")).otherwise(near.cast("float"))


def f32_boxes(data: SpatialFrame) -> DataFrame:
    """id and the box in 32 bits, rounded outward so that it covers the box in 64."""
    flat = data.as_boxes().df
    return flat.select("id", *[narrowed(c, c.startswith("min")).alias(c) for c in BOX])


def to_f64(value: Column) -> Column:
    """A coordinate of any type as a double."""
    return value.cast("double")


def from_f64(value: Column, coord_type: str) -> Column:
    """A double in a coordinate type; null where the type cannot hold it (a fraction is cut off)."""
    width_of(coord_type)
    if coord_type in ("float32", "float64"):
        return value.cast("float" if coord_type == "float32" else "double")
    bits, signed = int(coord_type.lstrip("uint")), not coord_type.startswith("u")
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long")
    return F.when(whole.between(low, high) & ~F.isnan(value), whole)


def guarded_sqrt(value: Column) -> Column:
    """The square root; null for a negative number."""
    return F.when(value >= 0, F.sqrt(value))
