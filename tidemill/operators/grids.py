"""Regular grids over the extent of points, made by Spark from one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KM_PER_DEG = 111.32


def lonlat_grid(points: DataFrame, step: float) -> DataFrame:
    """j, i, lon, lat of the regular grid over the extent of the points, built by Spark from one row."""
    e = points.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")).filter("w is not null")
    count = lambda a, b: F.sequence(F.lit(0).cast("long"), F.floor((F.col(b) - F.col(a)) / step + 1e-9))
    g = e.withColumn("j", F.explode(count("s", "n"))).withColumn("i", F.explode(count("w", "e")))
    return g.select("j", "i", (F.col("w") + F.col("i") * step).alias("lon"), (F.col("s") + F.col("j") * step).alias("lat"))


def km_grid(points: DataFrame, km: float) -> DataFrame:
    """j, i, lon, lat of a grid of equal spacing in km over the extent of the points."""
    e = points.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")).filter("w is not null")
    g = e.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - F.col("s")) * KM_PER_DEG / km + 1e-9))))
    g = g.withColumn("lat", F.col("s") + F.col("j") * km / KM_PER_DEG).withColumn("per", KM_PER_DEG * F.cos(F.radians("lat")))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("e") - F.col("w")) * F.col("per") / km + 1e-9))))
    return g.select("j", "i", (F.col("w") + F.col("i") * km / F.col("per")).alias("lon"), "lat")
