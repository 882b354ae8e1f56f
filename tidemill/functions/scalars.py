"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS-84 semi-axis in km and squared eccentricity; the sidereal day in seconds; gravity.
WGS84_A, WGS84_E2 = 6378.137, 6.69437999014e-3
SIDEREAL_S = 86164.0
GRAVITY = 9.81
M_PER_DEG = 111000.0

# the same formulas in SQL, for oracles
SQL = {
    "coriolis": "4 * pi() / 86164.0 * sin(radians(lat))",
    "ecef_x": "6378.137 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) * cos(radians(lat)) * cos(radians(lon))",
    "ecef_y": "6378.137 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) * cos(radians(lat)) * sin(radians(lon))",
    "ecef_z": "6378.137 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) * (1 - 6.69437999014e-3) * sin(radians(lat))",
    "gaspari_cohn": (
        "(CASE WHEN {c} <= 0 OR 2 * abs({r}) / {c} > 2 THEN 0.0 "
        "WHEN 2 * abs({r}) / {c} <= 1 THEN 1 - 5.0 / 3 * pow(2 * abs({r}) / {c}, 2) + 5.0 / 8 * pow(2 * abs({r}) / {c}, 3) + 0.5 * pow(2 * abs({r}) / {c}, 4) - 0.25 * pow(2 * abs({r}) / {c}, 5) "
        "ELSE 4 - 5 * (2 * abs({r}) / {c}) + 5.0 / 3 * pow(2 * abs({r}) / {c}, 2) + 5.0 / 8 * pow(2 * abs({r}) / {c}, 3) - 0.5 * pow(2 * abs({r}) / {c}, 4) + 1.0 / 12 * pow(2 * abs({r}) / {c}, 5) - 2.0 / (3 * (2 * abs({r}) / {c})) END)"
    ),
    "smoothstep": "1 - pow({x}, 3) * (10 - 15 * {x} + 6 * pow({x}, 2))",
}


def coriolis(lat: Column) -> Column:
    return F.lit(4 * math.pi / SIDEREAL_S) * F.sin(F.radians(lat))


def geo2cart(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in km of a point at height 0."""
    radius = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(F.radians(lat)), 2))
    flat = radius * F.cos(F.radians(lat))
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), radius * (1 - WGS84_E2) * F.sin(F.radians(lat))


def gaspari_cohn(r: Column, c: float) -> Column:
    """Compact fifth-order correlation function of support c; 0 beyond, and everywhere where c <= 0."""
    if c <= 0:
        return F.lit(0.0)
    x = 2 * F.abs(r) / c
    near = 1 - 5 / 3 * x**2 + 5 / 8 * x**3 + x**4 / 2 - x**5 / 4
    far = 4 - 5 * x + 5 / 3 * x**2 + 5 / 8 * x**3 - x**4 / 2 + x**5 / 12 - 2 / (3 * x)
    return F.when(x <= 1, near).when(x <= 2, far).otherwise(0.0)


def hat(r: Column, c: float) -> Column:
    return (c - F.abs(r)) / c


def cos2_window(x: Column) -> Column:
    return F.pow(F.cos(math.pi / 2 * x), 2)


def cos2_flux(x: Column) -> Column:
    """Derivative of cos2_window."""
    return -math.pi * F.sin(math.pi / 2 * x) * F.cos(math.pi / 2 * x)


def hann(x: Column) -> Column:
    """Hann weight of a relative position 0..1."""
    return (1 - F.cos(2 * math.pi * x)) * 0.5


def smoothstep_taper(distance: Column, scale: float) -> Column:
    """1 at distance 0, 0 from ``scale`` on; null where the distance is null (greatest and least would skip it)."""
    x = F.when(distance.isNotNull(), F.least(F.greatest(distance / scale, F.lit(0.0)), F.lit(1.0)))
    return 1 - x**3 * (10 - 15 * x + 6 * x**2)


def wind_stress(u: Column, v: Column, density: float = 1.225) -> tuple[Column, Column]:
    """Bulk formula with a drag coefficient by wind speed (Large and Pond)."""
    speed = F.sqrt(u * u + v * v)
    drag = F.when(speed < 5, 1.1e-3).when(speed < 25, (0.49 + 0.065 * speed) * 1e-3).otherwise(2e-3)
    return density * drag * speed * u, density * drag * speed * v


def soft_clamp(x: Column, low: float, sharp: float) -> Column:
    """Smooth maximum of x and low."""
    return low + F.log1p(F.exp(-F.abs(sharp * (x - low)))) / sharp + F.greatest(x - low, F.lit(0.0))


def soft_abs(x: Column, eps: float) -> Column:
    return F.sqrt(x * x + eps * eps)


def attenuation(depth: Column, shallow: float, deep: float) -> Column:
    return F.least(F.greatest((depth - shallow) / (deep - shallow), F.lit(0.0)), F.lit(1.0))
