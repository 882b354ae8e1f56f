"""Problem 1: irregular readings onto a regular grid of periods, per source.

Compact-kernel weighted local linear regression. Each reading is indexed by its period and sent to the few grid
times whose kernel reaches it; all that a fit needs are weighted sums, so readings are pre-aggregated on the map
side and a source that holds a third of all rows costs one row per period in the shuffle.

The effective support of a grid time is (sum w)^2 / sum w^2, the number of readings of equal weight that would
determine the fit as well. Below ``min_support`` the grid time is marked: ``missing`` by the support of the period's
own readings, ``insufficient`` by that of all readings whose kernel reaches it and whose value can enter a fit.

Defined results: readings without known time or given value are not usable and support nothing; a source without
a usable reading has no series; a reading without position supports the value only; one whose value is
beyond ``largest`` (infinite, fill values) supports its period, but enters no fit; readings at equal times count each; a fit
that rests on times within a hundredth of the bandwidth of their mean has no slope and is the weighted mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import materialize

PERIOD_S = 10800
BANDWIDTH_S = 16200.0  # the kernel is 0 from here on
HUGE = 1e15


def seconds(t: Column) -> Column:
    """Seconds since 1970 as a double, of a timestamp without zone read as UTC."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def _fit(y: str) -> Column:
    """Local linear estimate at the grid time from the sums w0, w1, w2 and y0, y1; the mean where the times lie within minutes."""
    det = F.col(f"{y}_w0") * F.col(f"{y}_w2") - F.col(f"{y}_w1") * F.col(f"{y}_w1")
    linear = (F.col(f"{y}_w2") * F.col(f"{y}_0") - F.col(f"{y}_w1") * F.col(f"{y}_1")) / F.when(det > 1e-4 * F.col(f"{y}_w0") * F.col(f"{y}_w0"), det)
    return F.coalesce(linear, F.col(f"{y}_0") / F.when(F.col(f"{y}_w0") > 0, F.col(f"{y}_w0")))


def regular_series(readings: DataFrame, period_s: int = PERIOD_S, bandwidth_s: float = BANDWIDTH_S, min_support: float = 1.0, largest: float = HUGE) -> DataFrame:
    """``readings``: sensor, name_time (known), name_var (given), lat, lon (degrees east; both may be null).

    One row per sensor and period from its first to its last usable reading: sensor, period_no, n_readings (usable,
    in the period), support and own_support (effective numbers of readings, of all in reach and of the period's own),
    missing and insufficient (see above), value, lat, lon (fitted at the middle of the period; null where missing, and
    value also where insufficient), and filled (the fit from the neighbours where the period itself is missing; null
    where insufficient). The kernel must be wider than half a period, so that each reading weighs in its own period.
    """
    assert bandwidth_s > period_s / 2
    t = seconds(F.col("name_time"))
    own = F.floor(t / period_s)
    # in the plane of the sphere's axes a track crosses the zero meridian and the poles smoothly
    lat, lon = F.radians("lat"), F.radians("lon")
    base = readings.filter("sensor is not null").select(
        "sensor", "name_var", t.alias("t"), own.alias("own"), (F.cos(lat) * F.cos(lon)).alias("px"), (F.cos(lat) * F.sin(lon)).alias("py"), F.sin(lat).alias("pz")
    )
    reach = int(-(-(bandwidth_s - period_s / 2) // period_s))
    near = base.withColumn("period_no", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    near = near.withColumn("u", (F.col("t") - (F.col("period_no") + 0.5) * period_s) / bandwidth_s).filter(F.abs("u") < 1)
    near = near.withColumn("w", F.pow(1 - F.pow(F.abs("u"), 3), 3))  # tricube
    w, u = F.col("w"), F.col("u")
    wv = F.when(F.abs("name_var") <= largest, w)
    wp = F.when(F.col("px").isNotNull() & ~F.isnan("px"), w)
    wo = F.when(F.col("own") == F.col("period_no"), w)
    sums = [F.sum(wt * F.pow(u, F.lit(float(k)))).alias(f"{p}_w{k}") for p, wt in (("v", wv), ("p", wp)) for k in range(3)]
    for name, y, wt in (("v", "name_var", wv), ("px", "px", wp), ("py", "py", wp), ("pz", "pz", wp)):
        sums += [F.sum(wt * F.col(y)).alias(f"{name}_0"), F.sum(wt * u * F.col(y)).alias(f"{name}_1")]
    sums += [F.sum(wv * wv).alias("ww"), F.sum(wo).alias("own_w"), F.sum(wo * wo).alias("own_ww"), F.count(wo).alias("n_readings")]
    moments = near.groupBy("sensor", "period_no").agg(*sums)
    for axis in ("px", "py", "pz"):
        moments = moments.withColumns({f"{axis}_w{k}": F.col(f"p_w{k}") for k in range(3)})
    moments = materialize(moments, "moments")  # a row per source and period, read twice
    effective = lambda one, two: F.coalesce(F.col(one) * F.col(one) / F.when(F.col(two) > 0, F.col(two)), F.lit(0.0))
    short = lambda c: c < min_support * (1 - 1e-9)
    span = moments.filter("own_w > 0").groupBy("sensor").agg(F.min("period_no").alias("a"), F.max("period_no").alias("b"))
    grid = span.select("sensor", F.explode(F.sequence("a", "b")).alias("period_no"))
    out = grid.join(moments, ["sensor", "period_no"], "left").withColumns({"support": effective("v_w0", "ww"), "own_support": effective("own_w", "own_ww")})
    out = out.withColumns({"missing": short(F.col("own_support")), "insufficient": short(F.col("support"))})
    x, y, z = _fit("px"), _fit("py"), _fit("pz")
    here = lambda c: F.when(~F.col("missing"), c)
    return out.select(
        "sensor",
        "period_no",
        F.coalesce("n_readings", F.lit(0)).alias("n_readings"),
        "support",
        "own_support",
        "missing",
        "insufficient",
        here(F.when(~F.col("insufficient"), _fit("v"))).alias("value"),
        here(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))).alias("lat"),
        here(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))).alias("lon"),
        F.when(F.col("missing") & ~F.col("insufficient"), _fit("v")).alias("filled"),
    )
