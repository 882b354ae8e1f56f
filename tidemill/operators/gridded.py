"""Gridded maps: scores against a reference map, the operator of gridded observations, boundary fields on the grid, spectra."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.spatial import near_cells


def scores_in_time(pairs: DataFrame, reference: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, time, n, score = 1 - rmse / rms of the reference. ``pairs``: keys, time, ref, exp of the cells where both are given;
    ``reference``: time, ref of all its cells, whose mean square counts cells that the experiment lacks too."""
    d = F.col("exp") - F.col("ref")
    e = pairs.groupBy(*keys, time).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"))
    r = reference.groupBy(time).agg(F.sqrt(F.avg(F.col("ref") * F.col("ref"))).alias("rms"))
    return e.join(r, time).select(*keys, time, "n", "rmse", (1 - F.col("rmse") / F.col("rms")).alias("score"))


def on_lattice(values: DataFrame, nodes: DataFrame, lattice: DataFrame, k: int, reach_km: float, time: str) -> DataFrame:
    """time, cell, v: a field given at scattered nodes (time, node_id, v) on every cell of a lattice (cell, lat, lon).

    A cell takes the weighted mean (inverse squares of the distance) of the ``k`` nearest nodes that are given at that time,
    so missing nodes are filled from their neighbours. Cells without any given node in reach are left out.
    """
    near = near_cells(nodes.select("node_id", "lat", "lon"), lattice, reach_km, "node_id", "cell")
    r = near.join(values, "node_id").filter("v is not null")
    r = r.withColumn("_k", F.row_number().over(W.partitionBy(time, "cell").orderBy("d", "node_id"))).filter(F.col("_k") <= k)
    w = 1 / F.greatest(F.col("d"), F.lit(1e-3)) ** 2
    return r.groupBy(time, "cell").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


def guarded(value: Column, err: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Value and error of a gridded observation as an inversion takes them: 0 with an error of 1e15 where the value is missing,
    outside the range of what was observed or absurd, or the error vanishes."""
    bad = ~F.coalesce(value.between(low, high) & (value <= 1e7) & (err >= 1e-7), F.lit(False))
    return F.when(bad, 0.0).otherwise(value), F.when(bad, 1e15).otherwise(err)


def gradient_vorticity(grid: DataFrame, u: str, v: str, spacing: tuple[Column, Column], n_i: int) -> DataFrame:
    """j, i, rv: dv/dx - du/dy by centred differences, one-sided where a neighbour is missing, null where both are."""
    at = F.struct(u, v)
    sent = lambda dj, di, slot: F.struct((F.col("j") - dj).alias("j"), F.pmod(F.col("i") - di, F.lit(n_i)).alias("i"), F.lit(slot).alias("slot"), at.alias("s"))
    rows = grid.select(F.explode(F.array(sent(0, 0, 0), sent(1, 0, 1), sent(-1, 0, 2), sent(0, 1, 3), sent(0, -1, 4))).alias("c")).select("c.*")
    pick = lambda slot, f: F.max(F.when(F.col("slot") == slot, F.col(f"s.{f}")))
    g = rows.groupBy("j", "i").agg(F.count_if(F.col("slot") == 0).alias("_own"), pick(0, u).alias("u"), pick(0, v).alias("v"), pick(1, u).alias("un"), pick(2, u).alias("us"), pick(3, v).alias("ve"), pick(4, v).alias("vw")).filter("_own > 0")

    def slope(ahead: str, here: str, behind: str) -> Column:
        a, h, b = F.col(ahead), F.col(here), F.col(behind)
        return F.coalesce((a - b) / 2, a - h, h - b)

    dx, dy = spacing
    return g.withColumn("rv", slope("ve", "v", "vw") / dx - slope("un", "u", "us") / dy)


def isotropic_spectra(field: DataFrame, keys: list[str], value: str, n: int, cell: float) -> DataFrame:
    """keys, tj, ti, ring, psd: spectrum of each tile of n x n cells of a map (keys, j, i, value), averaged over rings of wavenumber.

    The tile's mean is taken out, missing cells are 0, and a Hann window is applied. The transform is two sums, along i and
    then along j, each an equi-explode over the n wavenumbers and a partial aggregate.
    """
    t = field.select(*keys, F.floor(F.col("j") / n).alias("tj"), F.floor(F.col("i") / n).alias("ti"), (F.col("j") % n).alias("y"), (F.col("i") % n).alias("x"), F.col(value).alias("h"))
    tile = [*keys, "tj", "ti"]
    t = t.withColumn("h", F.col("h") - F.avg("h").over(W.partitionBy(*tile)))  # at most n * n cells
    hann = lambda c: 0.5 - 0.5 * F.cos(2 * math.pi * (F.col(c) + 1) / (n + 1))
    t = t.withColumn("h", F.col("h") * hann("x") * hann("y"))
    waves = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = t.withColumn("kx", waves).withColumn("p", 2 * math.pi * F.col("kx") * F.col("x") / n)
    a = a.groupBy(*tile, "y", "kx").agg(F.sum(F.col("h") * F.cos("p")).alias("re"), F.sum(-F.col("h") * F.sin("p")).alias("im"))
    b = a.withColumn("ky", waves).withColumn("p", 2 * math.pi * F.col("ky") * F.col("y") / n)
    c, s = F.cos("p"), F.sin("p")
    b = b.groupBy(*tile, "kx", "ky").agg(F.sum(F.col("re") * c + F.col("im") * s).alias("re"), F.sum(F.col("im") * c - F.col("re") * s).alias("im"))
    norm = sum((0.5 - 0.5 * math.cos(2 * math.pi * (x + 1) / (n + 1))) ** 2 for x in range(n)) ** 2
    signed = lambda c: F.when(F.col(c) > n // 2, F.col(c) - n).otherwise(F.col(c))
    # +1e-9 keeps distances that are halves of a ring on one side in every engine
    ring = F.floor(F.sqrt(signed("kx") ** 2 + signed("ky") ** 2) + 0.5 + 1e-9).alias("ring")
    p = b.select(*tile, ring, ((F.col("re") ** 2 + F.col("im") ** 2) * cell**2 / norm).alias("p"))
    return p.filter((F.col("ring") >= 1) & (F.col("ring") <= n // 2)).groupBy(*tile, "ring").agg(F.avg("p").alias("psd"))
