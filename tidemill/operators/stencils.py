"""Finite-difference stencils on a gridded map, and the schemes built of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import GRAVITY, M_PER_DEG, coriolis


def neighbours(grid: DataFrame, value: str, offsets: dict[str, tuple[int, int]], n_i: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add to each cell (keys, j, i) the values of the cells at the given (dj, di); longitudes are periodic; null where none.

    Each cell sends its value to the cells that need it and one partial aggregate collects them: one shuffle for a
    stencil of any size, instead of one self-join or window sort for each offset.
    """
    names = list(offsets)
    sent = F.array(
        F.struct(F.col("j"), F.col("i"), F.lit(-1).alias("slot"), F.col(value).alias("_s")),
        *[F.struct((F.col("j") - dj).alias("j"), F.pmod(F.col("i") - di, F.lit(n_i)).alias("i"), F.lit(s).alias("slot"), F.col(value).alias("_s")) for s, (dj, di) in enumerate(offsets.values())],
    )
    rows = grid.select(*keys, F.explode(sent).alias("c")).select(*keys, "c.*")
    at = lambda s: F.max(F.when(F.col("slot") == s, F.col("_s")))
    out = rows.groupBy(*keys, "j", "i").agg(at(-1).alias(value), F.count_if(F.col("slot") == -1).alias("_own"), *[at(s).alias(n) for s, n in enumerate(names)])
    return out.filter("_own > 0").drop("_own")


CROSS = {"n": (1, 0), "s": (-1, 0), "e": (0, 1), "w": (0, -1)}


def spacing(lat: Column, cell: float) -> tuple[Column, Column]:
    """dx, dy of a cell in metres."""
    return cell * M_PER_DEG * F.cos(F.radians(lat)), F.lit(cell * M_PER_DEG)


def laplacian(h: Column, lat: Column, cell: float) -> Column:
    dx, dy = spacing(lat, cell)
    return (F.col("e") - 2 * h + F.col("w")) / dx**2 + (F.col("n") - 2 * h + F.col("s")) / dy**2


def geostrophic(h: Column, lat: Column, cell: float) -> tuple[Column, Column]:
    dx, dy = spacing(lat, cell)
    gf = GRAVITY / coriolis(lat)
    return -gf * (F.col("n") - F.col("s")) / (2 * dy), gf * (F.col("e") - F.col("w")) / (2 * dx)


def potential_vorticity(h: Column, lat: Column, cell: float, c: float) -> Column:
    f = coriolis(lat)
    return GRAVITY / f * laplacian(h, lat, cell) - GRAVITY * f / c**2 * h


def upwind3(q: Column, wind: float, dx: Column) -> Column:
    """Third-order upwind tendency of a wind along i."""
    if wind >= 0:
        return -wind * (2 * F.col("e") + 3 * q - 6 * F.col("w") + F.col("ww")) / (6 * dx)
    return -wind * (-F.col("ee") + 6 * F.col("e") - 3 * q - 2 * F.col("w")) / (6 * dx)


def weno5(a: Column, b: Column, c: Column, d: Column, e: Column, eps: float = 1e-8) -> Column:
    """Fifth-order WENO value at the face between c and d, the wind blowing from a to e (smoothness after Jiang and Shu)."""
    parts = [(2 * a - 7 * b + 11 * c) / 6, (-b + 5 * c + 2 * d) / 6, (2 * c + 5 * d - e) / 6]
    rough = [
        13 / 12 * (a - 2 * b + c) ** 2 + (a - 4 * b + 3 * c) ** 2 / 4,
        13 / 12 * (b - 2 * c + d) ** 2 + (b - d) ** 2 / 4,
        13 / 12 * (c - 2 * d + e) ** 2 + (3 * c - 4 * d + e) ** 2 / 4,
    ]
    w = [g / (eps + r) ** 2 for g, r in zip((0.1, 0.6, 0.3), rough)]
    return (w[0] * parts[0] + w[1] * parts[1] + w[2] * parts[2]) / (w[0] + w[1] + w[2])


def upwind_flux(u: Column, left: Column, right: Column) -> Column:
    """Flux of the face value from the side the wind comes from."""
    return F.greatest(u, F.lit(0.0)) * left + F.least(u, F.lit(0.0)) * right


def asselin(before: Column, now: Column, after: Column, nu: float = 0.1) -> Column:
    return now + nu * (before - 2 * now + after)


# The tidal constants that sea-surface models commonly take (period in hours).
TIDES_H = {"M2": 12.4206012, "S2": 12.0, "K1": 23.93447213, "O1": 25.81933871}


def plane_wave_number(lat: Column, tide: str, depth: float) -> Column:
    """Wave number of a plane inertia-gravity wave; null poleward of its critical latitude."""
    omega = 2 * math.pi / (TIDES_H[tide] * 3600)
    k2 = (omega**2 - coriolis(lat) ** 2) / (GRAVITY * depth)
    return F.when(k2 >= 0, F.sqrt(k2))
