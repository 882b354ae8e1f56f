"""Filling and further regridding: nearest in time, kernels over nearest readings, triangles, relaxation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.blocks import around
from tidemill.operators.spatial import near_cells


def nearest_in_time(df: DataFrame, key: str, at: str, tie: str, value: str, width: float = 86400.0) -> DataFrame:
    """Add ``nearest``: the value, or the valid one nearest in time of the same key, the earlier on ties; null if there is none."""
    df = around(df, [key], at, tie, value, width)
    near = F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).when(F.col(at) - F.col("_t0") <= F.col("_t1") - F.col(at), F.col("_v0")).otherwise(F.col("_v1"))
    return df.withColumn("nearest", near).drop("_v0", "_t0", "_v1", "_t1")


def nearest_values(sources: DataFrame, targets: DataFrame, k: int, radius_km: float, value: str, source: str, target: str) -> DataFrame:
    """target, source, d, value of the k nearest sources within the radius."""
    near = near_cells(sources.select(source, "lat", "lon"), targets, radius_km, source, target)
    near = near.withColumn("rk", F.row_number().over(W.partitionBy(target).orderBy("d", source))).filter(F.col("rk") <= k).drop("rk")
    return near.join(sources.select(source, value, F.col("lat").alias("slat"), F.col("lon").alias("slon")), source)


def multiquadric(sources: DataFrame, targets: DataFrame, k: int, radius_km: float, value: str, source: str, target: str) -> DataFrame:
    """Multiquadric interpolation through the k nearest sources: a k x k system for each target, solved in batches."""
    near = nearest_values(sources, targets, k, radius_km, value, source, target).join(targets.select(target, F.col("lat").alias("tlat"), F.col("lon").alias("tlon")), target)
    y, x = (F.col("slat") - F.col("tlat")) * 111.0, (F.pmod(F.col("slon") - F.col("tlon") + 180, F.lit(360.0)) - 180) * 111.0 * F.cos(F.radians("tlat"))
    sets = near.groupBy(target).agg(F.sort_array(F.collect_list(F.struct(source, x.alias("x"), y.alias("y"), F.col(value).alias("v")))).alias("s"))
    sets = sets.select(target, *[F.col("s")[c].alias(c) for c in "xyv"])

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            size = part["v"].map(len).to_numpy()
            out = np.empty(len(part))
            for n in np.unique(size):  # at most k sizes; all systems of a size are solved at once
                rows = np.flatnonzero(size == n)
                px, py, v = (np.stack(part[c].to_numpy()[rows]) for c in "xyv")
                d2 = (px[:, :, None] - px[:, None, :]) ** 2 + (py[:, :, None] - py[:, None, :]) ** 2
                eps2 = np.maximum(d2.mean(axis=(1, 2)), 1e-6)
                # sources at one place make a singular system: the pseudo-inverse gives them equal weights
                w = (np.linalg.pinv(np.sqrt(d2 + eps2[:, None, None]), rcond=1e-12) @ v[:, :, None])[:, :, 0]
                out[rows] = (np.sqrt(px**2 + py**2 + eps2[:, None]) * w).sum(axis=1)
            yield pd.DataFrame({target: part[target], value: out})

    return sets.mapInPandas(run, f"{target} long, {value} double")


def on_triangles(points: DataFrame, grid: DataFrame, cell: float, value: str, point: str = "obs_id") -> DataFrame:
    """Barycentric interpolation on a lattice whose quads are split along the diagonal; null where one of three corners is missing."""
    n_i = round(360 / cell)
    y, x = (F.col("lat") + 90) / cell - 0.5, F.col("lon") / cell - 0.5
    p = points.select(point, F.floor(y).alias("j0"), F.floor(x).alias("i0"), (y - F.floor(y)).alias("fy"), (x - F.floor(x)).alias("fx"))
    low = F.col("fx") + F.col("fy") <= 1
    corner = lambda dj, di, w0, w1: F.struct(
        F.when(low, F.col("j0") + dj).otherwise(F.col("j0") + 1 - dj).alias("j"), F.pmod(F.when(low, F.col("i0") + di).otherwise(F.col("i0") + 1 - di), F.lit(n_i)).alias("i"), F.when(low, w0).otherwise(w1).alias("w")
    )
    fx, fy = F.col("fx"), F.col("fy")
    three = F.array(corner(0, 0, 1 - fx - fy, fx + fy - 1), corner(1, 0, fy, 1 - fy), corner(0, 1, fx, 1 - fx))
    asked = p.select(point, F.explode(three).alias("c")).select(point, "c.*")
    found = asked.join(grid.select("j", "i", F.col(value).alias("_g")), ["j", "i"])
    return found.groupBy(point).agg(F.sum(F.col("w") * F.col("_g")).alias("value"), F.count("_g").alias("_n")).filter("_n = 3").drop("_n")
