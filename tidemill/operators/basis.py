"""Reduced bases: wavelet dictionaries, their sparse factors, synthesis and analysis.

A wavelet is (iff, pj, pi, itheta, phase, it): a scale, a centre on a lattice anchored at multiples of its spacing, a
direction, cosine or sine, and a centre in time. It factors into gx over cells and gt over days, so that synthesis and
analysis sum over time before they touch space.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import cos2_window, gaspari_cohn

KM_PER_DEG = 110.0


def scales(longest_km: float, shortest_km: float, ratio: float) -> list[float]:
    """Geometric ladder of wavelengths."""
    out = [longest_km]
    while out[-1] / ratio >= shortest_km * (1 - 1e-9):
        out.append(out[-1] / ratio)
    return out


def _columns(west: Column, east: Column, cell_deg: float) -> Column:
    """The map's columns between two longitudes, across the zero meridian if need be; each once, all where the span is the globe."""
    n = round(360 / cell_deg)
    a, b = F.floor(west / cell_deg), F.floor(east / cell_deg)
    return F.when(b - a + 1 >= n, F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).otherwise(F.transform(F.sequence(a, F.least(b, a + n)), lambda i: F.pmod(i, F.lit(n).cast("long"))))


def _east(d: Column) -> Column:
    """A difference of longitudes within -180..180."""
    return F.pmod(d + 180, F.lit(360.0)) - 180


def centres(cells: DataFrame, cell_deg: float, ladder: list[float]) -> DataFrame:
    """iff, pj, pi, lat0, lon0, half: the lattice points within half a wavelength of a cell that holds data.

    The lattice is made from the cells (explode of the few points near each, then distinct), so empty sea has none.
    """
    per = F.array(*[F.struct(F.lit(n).alias("iff"), F.lit(lam).alias("lam")) for n, lam in enumerate(ladder)])
    c = cells.select("lat", "lon", F.explode(per).alias("s")).select("lat", "lon", "s.*")
    c = c.withColumn("step", F.col("lam") / KM_PER_DEG / 2)
    for axis, at in (("pj", "lat"), ("pi", "lon")):
        c = c.withColumn(axis, F.floor(F.col(at) / F.col("step") + 0.5))
    c = c.select("iff", "lam", "step", "pj", "pi").distinct()
    return c.select("iff", "pj", "pi", (F.col("pj") * F.col("step")).alias("lat0"), (F.col("pi") * F.col("step")).alias("lon0"), F.col("lam").alias("half")).filter("abs(lat0) <= 85")


def gx(wave: DataFrame, cells: DataFrame, cell_deg: float, n_theta: int) -> DataFrame:
    """iff, pj, pi, itheta, phase, j, i, w: a centre's window of squared cosines times its plane wave, on the cells within ``half`` km.

    A box join written as an equi-join: each centre enumerates the cells of its box, whose number the scale bounds.
    """
    a = wave.withColumn("dlat", F.col("half") / KM_PER_DEG).withColumn("dlon", F.col("half") / (KM_PER_DEG * F.cos(F.radians("lat0"))))
    a = a.withColumn("j", F.explode(F.sequence(F.floor((F.col("lat0") - F.col("dlat") + 90) / cell_deg), F.floor((F.col("lat0") + F.col("dlat") + 90) / cell_deg))))
    a = a.withColumn("i", F.explode(_columns(F.col("lon0") - F.col("dlon"), F.col("lon0") + F.col("dlon"), cell_deg)))
    b = a.join(cells.select("j", "i", "lat", "lon"), ["j", "i"])
    x, y = _east(F.col("lon") - F.col("lon0")) * KM_PER_DEG * F.cos(F.radians("lat0")), (F.col("lat") - F.col("lat0")) * KM_PER_DEG
    b = b.withColumn("x", x).withColumn("y", y).filter((F.abs("x") <= F.col("half")) & (F.abs("y") <= F.col("half")))
    kinds = F.array(*[F.struct(F.lit(t).alias("itheta"), F.lit(p).alias("phase")) for t in range(n_theta) for p in (0, 1)])
    b = b.withColumn("d", F.explode(kinds)).select("*", "d.itheta", "d.phase")
    theta = F.col("itheta") * math.pi / n_theta
    arg = 2 * math.pi / F.col("half") * (F.cos(theta) * F.col("x") + F.sin(theta) * F.col("y"))
    window = cos2_window(F.col("x") / F.col("half")) * cos2_window(F.col("y") / F.col("half"))
    return b.select("iff", "pj", "pi", "itheta", "phase", "j", "i", (math.sqrt(2) * window * F.when(F.col("phase") == 0, F.cos(arg)).otherwise(F.sin(arg))).alias("w"))


def gt(days: DataFrame, decay: float) -> DataFrame:
    """it, day, wt: each day meets the time centres (every ``decay`` days) within ``decay`` days of it."""
    n = F.floor(F.col("day") / decay)
    d = days.select("day", F.explode(F.sequence(n, n + 1)).alias("it"))
    return d.select("it", "day", cos2_window((F.col("day") - F.col("it") * decay) / decay).alias("wt"))


WAVE = ["iff", "pj", "pi", "itheta", "phase"]


def analysis(gx_: DataFrame, gt_: DataFrame, field: DataFrame, value: str, wave: list[str] = WAVE) -> DataFrame:
    """Transpose of synthesis: x of each wavelet (of the key ``wave``) from a field (day, j, i, value). Time is summed first."""
    s = field.join(gt_, "day").groupBy("it", "j", "i").agg(F.sum(F.col("wt") * F.col(value)).alias("_s"))
    return s.join(gx_, ["j", "i"]).groupBy(*wave, "it").agg(F.sum(F.col("w") * F.col("_s")).alias("x"))


def synthesis(gx_: DataFrame, gt_: DataFrame, control: DataFrame) -> DataFrame:
    """day, j, i, value from x of each wavelet: sum over time centres, then over the wavelets of a cell."""
    s = control.join(gt_, "it").groupBy(*WAVE, "day").agg(F.sum(F.col("wt") * F.col("x")).alias("_s"))
    return s.join(gx_, WAVE).groupBy("day", "j", "i").agg(F.sum(F.col("w") * F.col("_s")).alias("value"))


def spectral_laws(wave: DataFrame, longest_km: float, q_max: float, q_slope: float, t_max: float, t_slope: float, t_min: float) -> DataFrame:
    """q and tdec of each wavelet's scale: a power of the wavelength below ``longest_km``, constant above, clamped."""
    rel = F.least(F.col("half") / longest_km, F.lit(1.0))
    return wave.withColumn("q", q_max * F.pow(rel, F.lit(q_slope))).withColumn("tdec", F.greatest(t_max * F.pow(rel, F.lit(t_slope)), F.lit(t_min)))


def bumps(cells: DataFrame, step: float, support: float, cell_deg: float, shape: Callable[[Column], Column] | None = None) -> DataFrame:
    """pj, pi, j, i, w of the basis without directions: compact functions of ``support`` degrees on a lattice of ``step``, the
    product of ``shape`` (a correlation function unless given) along both axes.

    Each centre enumerates the cells of its box, so the join is on the cell. ``step`` divides 360.
    """
    shape = shape or (lambda d: gaspari_cohn(d, support))
    c = cells.select(F.floor(F.col("lat") / step + 0.5).alias("pj"), F.pmod(F.floor(F.col("lon") / step + 0.5), F.lit(round(360 / step)).cast("long")).alias("pi")).distinct()
    at = F.col("pj") * step + 90
    c = c.withColumn("j", F.explode(F.sequence(F.floor((at - support) / cell_deg), F.floor((at + support) / cell_deg))))
    c = c.withColumn("i", F.explode(_columns(F.col("pi") * step - support, F.col("pi") * step + support, cell_deg)))
    b = c.join(cells.select("j", "i", "lat", "lon"), ["j", "i"])
    y, x = F.col("lat") - F.col("pj") * step, _east(F.col("lon") - F.col("pi") * step)
    return b.filter((F.abs(x) < support) & (F.abs(y) < support)).select("pj", "pi", "j", "i", (shape(x) * shape(y)).alias("w"))


def gt_ladder(days: DataFrame, decays: list[float]) -> DataFrame:
    """ift, it, day, wt: the time factor for each decay of a ladder, for bases that are ladders in space and in time."""
    d = days.select("day", F.explode(F.array(*[F.struct(F.lit(n).alias("ift"), F.lit(float(x)).alias("decay")) for n, x in enumerate(decays)])).alias("s")).select("day", "s.*")
    n = F.floor(F.col("day") / F.col("decay"))
    d = d.withColumn("it", F.explode(F.sequence(n, n + 1)))
    return d.select("ift", "it", "day", cos2_window((F.col("day") - F.col("it") * F.col("decay")) / F.col("decay")).alias("wt"))


def local_spread(cells: DataFrame, spread: str, step: float, cell_deg: float) -> DataFrame:
    """pj, pi, std, q: mean of an auxiliary map over each centre's box of ``step`` degrees, for bases whose variance varies in space.

    A centre without a value gets the vanishing variance 1e-10, so that it takes no part.
    """
    near = bumps(cells, step, step, cell_deg).join(cells.select("j", "i", spread), ["j", "i"])
    out = near.groupBy("pj", "pi").agg(F.avg(spread).alias("std"))
    return out.withColumn("q", F.coalesce(F.col("std") ** 2, F.lit(1e-10)))


def boundary_amplitudes(rim: DataFrame, times: str, step: float, sigma: float, decay: float) -> DataFrame:
    """p, it, w: Gaussian weights, in space along a rim of boundary nodes and in time, of the centres near each node and time."""
    p = F.explode(F.sequence(F.floor(F.col("lon") / step) - 1, F.floor(F.col("lon") / step) + 2))
    it = F.explode(F.sequence(F.floor(F.col(times) / decay), F.floor(F.col(times) / decay) + 1))
    r = rim.withColumn("p", p).withColumn("it", it)
    space, time = (F.col("lon") - F.col("p") * step) / sigma, (F.col(times) - F.col("it") * decay) / decay
    return r.withColumn("w", F.exp(-(space**2) / 2) * F.exp(-(time**2) / 2))
