"""Reading the driver's tables, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import SpatialError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it. Only a session in one process (tests) may do
    without: it gets a temporary folder of its own. On a cluster a missing setting is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is not None:
        return path
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise SpatialError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _LOCAL.get("path") is None:
        _LOCAL["path"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL["path"]


class Written:
    """Writes a table into the shared folder and reads it back, which cuts its lineage for good, so
    a lost executor never costs more than one step.

    ``drop`` removes a table that nothing will read again. A result is lazy and reads the last ones
    when it is used, so those go when the driver ends, or with ``remove_all`` before that.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/tessera-{uuid.uuid4().hex}"
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        # the file system outlives the session, so that tables can go after it was stopped
        _LEFT[path] = (target.getFileSystem(sc._jsc.hadoopConfiguration()), target)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._written_at = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if (path := getattr(df, "_written_at", None)) in _LEFT:
                system, target = _LEFT.pop(path)
                system.delete(target, True)


#: The folder of a session in one process, and the tables still there.
_LOCAL: dict[str, str] = {}
_LEFT: dict[str, tuple] = {}


@atexit.register
def remove_all() -> None:
    """Remove every table written so far."""
    while _LEFT:
        system, target = _LEFT.popitem()[1]
        try:
            system.delete(target, True)
        except (Py4JError, OSError):  # the driver's JVM has gone
            return


#: The driver's tables have no coordinates: these views derive them, alike in Spark SQL and DuckDB.
VIEWS = {
    "boxes_orders": """SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS min_x, o_totalprice / 1000 AS min_y,
        CAST(o_custkey + o_orderkey % 10 AS DOUBLE) AS max_x, o_totalprice / 1000 + o_orderkey % 7 AS max_y FROM orders""",
    "pts_orders": "SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS x, o_totalprice / 1000 AS y FROM orders",
    "lonlat_customer": """SELECT c_custkey AS id, CAST((c_custkey * 137) % 360 - 180 AS DOUBLE) AS lon,
        CAST((c_custkey * 97) % 161 - 80 AS DOUBLE) AS lat FROM customer""",
    "boxes_part": """SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS min_x, p_retailprice / 100 AS min_y,
        CAST(p_size + p_partkey % 3 AS DOUBLE) AS max_x, p_retailprice / 100 + p_partkey % 5 AS max_y FROM part""",
    "pts_events": "SELECT event_id AS id, CAST(user_id AS DOUBLE) AS x, value AS y FROM events",
}
SOURCES = {"boxes_orders": "orders", "pts_orders": "orders", "lonlat_customer": "customer", "boxes_part": "part", "pts_events": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/{SOURCES[name]}.parquet")
    return spark.sql(VIEWS[name].replace(f"FROM {SOURCES[name]}", "FROM {source}"), source=source)
