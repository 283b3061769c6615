"""SpatialFrame: a DataFrame whose columns play the roles of an id and of a box or a point."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SpatialError

BOX = ("min_x", "min_y", "max_x", "max_y")
POINT = ("x", "y")


def unused(name: str, columns: list[str]) -> str:
    """A name, begun like this, that is none of the columns' (which Spark tells apart without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class SpatialFrame:
    """``df`` holds id, the role columns as doubles, and any other columns of the caller's."""

    df: DataFrame
    roles: tuple[str, ...]
    node_size: int = 16
    others: tuple[str, ...] = field(default=())

    @property
    def is_points(self) -> bool:
        return self.roles == POINT

    def as_boxes(self) -> "SpatialFrame":
        """Points as boxes without extent."""
        if not self.is_points:
            return self
        df = self.df.select("id", *[F.col(c).alias(b) for c, b in zip(("x", "y", "x", "y"), BOX, strict=True)], *self.others)
        return SpatialFrame(df, BOX, self.node_size, self.others)

    def checked(self) -> "SpatialFrame":
        """Without rows that no query can place: nulls and NaN (documented as dropped, never matched)."""
        fine = F.lit(True)
        for c in self.roles:
            fine = fine & F.col(c).isNotNull() & ~F.isnan(c)
        return SpatialFrame(self.df.where(fine), self.roles, self.node_size, self.others)

    def __repr__(self) -> str:
        kind = "points" if self.is_points else "boxes"
        return f"SpatialFrame({kind}, node_size={self.node_size}, columns={self.df.columns})"


def role_columns(df: DataFrame, given: str | list[str], names: tuple[str, ...]) -> list[Column]:
    """The coordinates as doubles from separate columns, a struct (by position) or an array column."""
    if isinstance(given, str):
        kind = df.schema[given].dataType
        if isinstance(kind, T.StructType):
            if len(kind.fields) != len(names):
                raise SpatialError(f"{given} has {len(kind.fields)} fields, {len(names)} are needed")
            found = [F.col(given)[f.name] for f in kind.fields]
        elif isinstance(kind, T.ArrayType):
            found = [F.get(given, F.lit(k)) for k in range(len(names))]
        else:
            raise SpatialError(f"{given} is neither a struct nor an array")
    else:
        if len(given) != len(names):
            raise SpatialError(f"{len(names)} columns are needed, {len(given)} were given")
        found = [F.col(c) for c in given]
    return [c.cast("double").alias(n) for c, n in zip(found, names, strict=True)]


def frame(df: DataFrame, given: str | list[str], names: tuple[str, ...], key: str, node_size: int, keep: list[str] | None) -> SpatialFrame:
    if not 2 <= node_size <= 65535:
        raise SpatialError(f"node size {node_size} is not within 2 to 65535")
    keep = [c for c in keep or [] if c not in ("id", *names)]
    return SpatialFrame(df.select(F.col(key).alias("id"), *role_columns(df, given, names), *keep), names, node_size, tuple(keep)).checked()


def boxes(df: DataFrame, given: str | list[str] = list(BOX), key: str = "id", node_size: int = 16, keep: list[str] | None = None) -> SpatialFrame:  # noqa: B006
    """Boxes from four columns, or from one column of structs or arrays; ``keep`` carries others along.

    Rows with a null or NaN coordinate are dropped; inverted boxes are kept as they are.
    """
    return frame(df, given, BOX, key, node_size, keep)


def points(df: DataFrame, given: str | list[str] = list(POINT), key: str = "id", node_size: int = 64, keep: list[str] | None = None) -> SpatialFrame:  # noqa: B006
    """Points from two columns, or from one column of structs or arrays."""
    return frame(df, given, POINT, key, node_size, keep)


def together(*batches: SpatialFrame, renumber: bool = False) -> SpatialFrame:
    """Batches of one kind as one frame. ``renumber`` gives them new ids, as if they had been added
    one after the other: 0-based, by batch and then by the id within it."""
    first = batches[0]
    for other in batches[1:]:
        if other.roles != first.roles:
            raise SpatialError("boxes and points do not mix")
    if not renumber:
        df = first.df
        for other in batches[1:]:
            df = df.unionByName(other.df)
        return SpatialFrame(df, first.roles, first.node_size, first.others)
    from tessera.operators.cluster import positions

    batch = unused("batch", first.df.columns)
    df = first.df.withColumn(batch, F.lit(0))
    for k, other in enumerate(batches[1:], 1):
        df = df.unionByName(other.df.withColumn(batch, F.lit(k)))
    at = unused("at", df.columns)
    df = positions(df, [batch, "id"], at).withColumn("id", F.col(at)).drop(batch, at)
    return SpatialFrame(df.select(*first.df.columns), first.roles, first.node_size, first.others)


def extent(data: SpatialFrame) -> DataFrame:
    """One row: the least box around everything (nulls for an empty frame)."""
    low, high = (data.roles[:2], data.roles[-2:])
    return data.df.agg(
        F.min(low[0]).alias("min_x"), F.min(low[1]).alias("min_y"), F.max(high[0]).alias("max_x"), F.max(high[1]).alias("max_y")
    )


def write_clustered(data: SpatialFrame, path: str, files: int = 0) -> None:
    """Parquet in curve order: near boxes share row groups, so box predicates skip the others."""
    from tessera.functions.curve import hilbert_of

    keyed = hilbert_of(data)
    n = files or int(data.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").drop("key").write.mode("overwrite").parquet(path)
