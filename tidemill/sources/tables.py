"""Reading the tables, and cutting lineage through a table in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_left: dict[str, list[tuple[str, str | None]]] = {}  # by application: folder, and the catalog's table over it
_once: dict[tuple, tuple[tuple[DataFrame, ...], list[str]]] = {}  # what ``once`` made, and the folders it lies in


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder is taken if the session runs on one machine (tests, a laptop); on a cluster
    each executor would write to a disk of its own, so that raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} reach")
        at = f"file://{os.path.join(tempfile.gettempdir(), 'tidemill')}"
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str, catalog: str | None = None) -> str:
    """A path in the shared folder that no other run has; ``release`` deletes it, and drops the table ``catalog`` over it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.setdefault(spark.sparkContext.applicationId, []).append((path, catalog))
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage so that a lost executor never causes an earlier stage to run again;
    unlike an RDD checkpoint the copy is compressed and columns can be pruned from it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """As ``materialize``, in ``parts`` buckets of ``key``: joins and aggregates on it read the table without a shuffle."""
    spark = df.sparkSession
    catalog = f"{name}_{uuid.uuid4().hex}"
    path = new_folder(spark, name, catalog)
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(catalog)
    return spark.table(catalog)


BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, name: str = "small", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, of narrow rows, as a table in the shared folder; broadcast only if its counted rows are at most ``rows``.

    Beyond that Spark joins by shuffle, where adaptive execution splits skewed partitions.
    """
    return hinted(materialize(df, name), rows)


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """As ``broadcast_if_small``, of a table that is written already."""
    return F.broadcast(df) if df.count() <= rows else df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def once(spark: SparkSession, key: tuple, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """The DataFrames of ``make``, over tables in the shared folder, made once in a session for ``key``; again if a table is gone."""
    app = spark.sparkContext.applicationId
    key = (app, spark._jsparkSession.hashCode(), *key)
    if key not in _once or not all(exists(spark, p) for p in _once[key][1]):
        before = len(_left.get(app, []))
        made = make()
        _once[key] = (made, [p for p, _ in _left.get(app, [])[before:]])
    return _once[key][0]


def release(spark: SparkSession) -> int:
    """Delete the tables that this application's operators left in the shared folder; call it once results are written.

    Returns how many there were. DataFrames made before and not yet written can't be read any more.
    """
    jvm, n = spark._jvm, 0
    app = spark.sparkContext.applicationId
    for key in [k for k in _once if k[0] == app]:
        del _once[key]
    for path, catalog in _left.pop(app, []):
        if catalog:
            spark.sql(f"DROP TABLE IF EXISTS {catalog}")
        p = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def given(c) -> F.Column:
    """A value is given if it is neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def nan_to_null(c) -> F.Column:
    return F.when(~F.isnan(c), c)
