"""Spatial joins: nearest cells with weights, interpolation on regular grids, smoothing onto a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.scalars import geo2cart
from tidemill.sources.tables import materialize


def _bucketed(df: DataFrame, size: float, spread: bool) -> DataFrame:
    """Add x, y, z in km and the bucket of ``size`` km; with ``spread`` a copy for each of the 27 buckets around."""
    x, y, z = geo2cart(F.col("lon"), F.col("lat"))
    df = df.withColumns({"x": x, "y": y, "z": z})
    idx = [F.floor(F.col(c) / size) for c in "xyz"]
    if spread:
        off = [F.lit(v) for v in (-1, 0, 1)]
        for c, i in zip(("bx", "by", "bz"), idx):
            df = df.withColumn(c, F.explode(F.array(*[i + o for o in off])))
    else:
        df = df.withColumns(dict(zip(("bx", "by", "bz"), idx)))
    return df


def near_cells(points: DataFrame, cells: DataFrame, reach_km: float, point: str = "obs_id", cell: str = "cell_id") -> DataFrame:
    """point, cell, d (chord in km) of all pairs at most ``reach_km`` apart.

    Points keep to one bucket as wide as the reach; the cells, which are the smaller side, are copied to the buckets
    around theirs. An equi-join on the bucket replaces the distance condition, which Spark could only run as a nested loop.
    """
    p = _bucketed(points.select(point, "lat", "lon"), reach_km, False).select(point, "bx", "by", "bz", "x", "y", "z")
    c = _bucketed(cells.select(cell, "lat", "lon"), reach_km, True).select(cell, "bx", "by", "bz", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2)
    return p.join(c, ["bx", "by", "bz"]).select(point, cell, d.alias("d")).filter(F.col("d") <= reach_km)


def nearest_distance(points: DataFrame, cells: DataFrame, reach_km: float, point: str = "obs_id", cell: str = "cell_id") -> DataFrame:
    """point, d (chord in km) to the nearest cell, however far; points have no row only if there are no cells.

    Points without a cell in reach are asked again with twice the reach, which on a sphere ends after a few rounds.
    """
    rest, found = materialize(points.select(point, "lat", "lon"), "points"), None
    while True:
        near = materialize(near_cells(rest, cells, reach_km, point, cell).groupBy(point).agg(F.min("d").alias("d")), "near")
        found = near if found is None else found.unionByName(near)
        rest = materialize(rest.join(near, point, "left_anti"), "rest")
        if reach_km > 12800 or rest.isEmpty():  # no two points of the earth lie farther apart
            return found
        reach_km *= 2


def knn_weights(points: DataFrame, cells: DataFrame, k: int, reach_km: float, point: str = "obs_id", cell: str = "cell_id") -> DataFrame:
    """The observation operator H as rows point, cell, d, w: Gaussian weights of the k nearest cells, summing to 1.

    Equal distances are ordered by cell. Points without a cell in reach have no rows.
    """
    ranked = near_cells(points, cells, reach_km, point, cell).withColumn("k", F.row_number().over(W.partitionBy(point).orderBy("d", cell)))
    w = F.exp(-F.col("d") ** 2 / (2 * (0.5 * reach_km) ** 2))
    kept = ranked.filter(F.col("k") <= k).withColumn("w", w)
    return kept.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy(point))).drop("k")


def matvec(matrix: DataFrame, vector: DataFrame, row: str, col: str, value: str, to: str) -> DataFrame:
    """Sparse matrix (row, col, w) times vector (col, value): an equi-join and a sum that combines before the shuffle."""
    return matrix.join(vector.select(col, value), col).groupBy(row).agg(F.sum(F.col("w") * F.col(value)).alias(to))


def interpolate(points: DataFrame, grid: DataFrame, cell: float, value: str, at_time: str | None = None, step_s: float = 86400.0, point: str = "obs_id", to: str = "value") -> DataFrame:
    """Bilinear (with ``at_time`` trilinear) interpolation of a gridded map to points; null where a corner is missing.

    ``grid``: j, i (, k: step of the time axis, values at the middle of the step), value; longitudes are periodic. Each
    point asks for its corners, which is one equi-join on the corner and one partial aggregate per point.
    """
    n_i = round(360 / cell)
    y, x = (F.col("lat") + 90) / cell - 0.5, F.col("lon") / cell - 0.5
    df = points.withColumn("_y", y).withColumn("_x", x)
    corners: list[tuple[Column, Column, Column | None, Column]] = []
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")
    for dj, wy in ((0, 1 - fy), (1, fy)):
        for di, wx in ((0, 1 - fx), (1, fx)):
            j, i = F.floor("_y") + dj, F.pmod(F.floor("_x") + di, F.lit(n_i))
            if at_time is None:
                corners.append((j, i, None, wy * wx))
            else:
                s = F.col(at_time) / step_s - 0.5
                ft = s - F.floor(s)
                corners += [(j, i, F.floor(s), wy * wx * (1 - ft)), (j, i, F.floor(s) + 1, wy * wx * ft)]
    keys = ["j", "i"] + (["k"] if at_time else [])
    parts = [F.struct(j.alias("j"), i.alias("i"), *([k.alias("k")] if at_time else []), w.alias("w")) for j, i, k, w in corners]
    asked = df.select(point, F.explode(F.array(*parts)).alias("c")).select(point, "c.*")
    found = asked.join(grid.select(*keys, F.col(value).alias("_g")), keys)
    n = len(corners)
    return found.groupBy(point).agg(F.sum(F.col("w") * F.col("_g")).alias(to), F.count("_g").alias("_n")).filter(F.col("_n") == n).drop("_n")


def idw(sources: DataFrame, targets: DataFrame, k: int, radius_km: float, value: str, source: str, target: str) -> DataFrame:
    """Inverse squared distance weighting of the k nearest sources within the radius; targets without any are left out.

    The k nearest are kept by row_number() <= k, which Spark applies within each task before the shuffle.
    """
    near = near_cells(sources.select(source, "lat", "lon"), targets, radius_km, source, target)
    near = near.withColumn("rk", F.row_number().over(W.partitionBy(target).orderBy("d", source))).filter(F.col("rk") <= k)
    w = 1 / F.greatest(F.col("d"), F.lit(1e-3)) ** 2
    return near.join(sources.select(source, value), source).groupBy(target).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value), F.count("*").alias("n"))
