"""Role-mapped scans, cached ingest and the box query."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, paths: list[str], roles: dict[str, str], optional: tuple[str, ...] = (), hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Read files or globs, apply the hook, project to roles (role: column).

    Schemas of the files are merged. A missing column is an error, unless its role is optional: then it is null.
    """
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    df = hook(df) if hook else df
    missing = {r: c for r, c in roles.items() if c not in df.columns}
    if bad := set(missing) - set(optional):
        raise KeyError(f"no column for {sorted(bad)}")
    return df.select(*[(F.lit(None) if r in missing else F.col(c)).alias(r) for r, c in roles.items()])


def union_scans(frames: list[DataFrame]) -> DataFrame:
    """Union of scans of differing columns; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def cached(spark: SparkSession, folder: str, parameters: dict, make: Callable[[], DataFrame], partition: list[str]) -> DataFrame:
    """The table that ``make`` gives for ``parameters``, made once: its folder is named by a hash of the parameters.

    A folder counts only with Spark's _SUCCESS, so an ingest that died is made anew.
    """
    name = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder}/ingest-{name}"
    try:
        spark.read.text(f"{path}/_SUCCES[S]").count()
        return spark.read.parquet(path)
    except AnalysisException:
        df = make()
        df.repartition(*partition).write.mode("overwrite").partitionBy(*partition).parquet(path)
        return spark.read.parquet(path)


def get_obs(df: DataFrame, box: tuple[float, float, float, float], start: str, end: str, origin: str) -> DataFrame:
    """Readings in a closed box (lon0, lon1, lat0, lat1) and time range: time in days since ``origin``, lon in 0..360.

    Rows without value are dropped. The order by time is left to the reader, who may sort within partitions.
    """
    lon = F.pmod("lon", F.lit(360.0))
    day = (F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))) / 86400e6
    keep = lon.between(box[0], box[1]) & F.col("lat").between(box[2], box[3]) & F.col("t").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return df.filter(keep & F.col("v").isNotNull()).select("obs_id", "sensor", day.alias("day"), lon.alias("lon"), "lat", "v")
