"""Readings: one row for each obs_id, however often it was delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemill.sources.tables import given


def distinct_readings(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """One row per ``key`` with the named columns; rows without a key are no readings and are left out.

    Deliveries of a reading have the same content, so any of them will do; the aggregate is partial before the
    shuffle, so copies within a partition do not travel. Strings are grouped by, as a buffer of a string would turn the hash
    aggregate into a sort of all rows; deliveries of a key that differ in a string therefore stay apart. Only
    ``cols`` are carried: extra columns of the input, whatever their names, are ignored. An empty input gives an empty result.
    """
    text = strings(df, cols)
    return df.filter(F.col(key).isNotNull()).groupBy(key, *text).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in cols if c not in text]).select(key, *cols)


def strings(df: DataFrame, cols: tuple[str, ...]) -> list[str]:
    return [c for c in cols if isinstance(df.schema[c].dataType, StringType)]


def with_known_time(readings: DataFrame, sensor: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Keep readings whose name_time lies within the mission of their sensor.

    ``sensor`` is a dimension of one row per sensor; Spark broadcasts it only while it stays below
    spark.sql.autoBroadcastJoinThreshold. A sensor missing from it, or with a null bound, has no known
    times. With ``keep_unknown`` the others stay too, with a null name_time.
    """
    mission = (
        sensor.filter(F.col("sensor").isNotNull())
        .groupBy("sensor")
        .agg(F.min("begin_time").alias("_from"), F.max("end_time").alias("_to"))
    )
    known = F.col("name_time").between(F.col("_from"), F.col("_to"))
    if keep_unknown:
        joined = readings.join(mission, "sensor", "left")
        return joined.withColumn("name_time", F.when(known, F.col("name_time"))).drop("_from", "_to")
    return readings.join(mission, "sensor").filter(known).drop("_from", "_to")


def usable(df: DataFrame) -> DataFrame:
    return df.filter(given(F.col("name_var")))
