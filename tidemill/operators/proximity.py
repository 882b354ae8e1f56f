"""Problem 2: points near other points, or within a region.

Points are hashed to cells of latitude, longitude and time that are as wide as the radius. One side of a pair stays in
its own cell and the other is copied into the cells around that its search box touches; a copy goes only to cells of a
number not above its own, so that each pair of cells meets once. Candidates are then verified by exact great-circle
distance. Before that, points are pruned by wide cells: a point goes on only if its wide cell is touched by the search box
of another source's point, which is necessary for a pair, so that lone points are never copied.
The join key holds the other source, so points of one dense source never meet each other.

Defined results: points without latitude in -90..90, longitude, time, id or source are in no pair; a distance or a
difference in time equal to the limit counts; points at the same place pair like any others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.regrid import seconds
from tidemill.sources.tables import materialize

EARTH_KM = 6371.0
WIDE = 8  # width of the pruning cells in radii


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on a sphere of radius EARTH_KM; stable for near points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def _cells_in_band(band: Column, size: float) -> Column:
    """Cells along a band of latitude: as many as keep each at least ``size`` degrees of a great circle wide."""
    edge = F.greatest(F.abs(band * size - 90), F.abs((band + 1) * size - 90))
    return F.greatest(F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * 360 / size), F.lit(1))


class Cells:
    """Cells of latitude, longitude and time, ``spread`` search radii wide, and their numbers."""

    def __init__(self, radius_km: float, within_s: float, spread: float) -> None:
        self.reach, self.within = math.degrees(radius_km / EARTH_KM) * 1.001, within_s
        self.size, self.step = max(spread * math.degrees(radius_km / EARTH_KM), 0.002), max(spread * within_s, 1.0)
        self.bands, self.per_band = int(180 / self.size) + 2, int(360 / self.size) + 2

    def number(self, t: Column, band: Column, x: Column) -> Column:
        return (t * self.bands + band) * self.per_band + x

    def own(self, df: DataFrame) -> DataFrame:
        """Add ``cell``: the cell that holds t, lat and lon."""
        band = F.floor((F.col("lat") + 90) / self.size)
        return df.withColumn("cell", self.number(F.floor(F.col("t") / self.step), band, F.floor(F.col("lon") / 360 * _cells_in_band(band, self.size))))

    def touched(self, df: DataFrame) -> DataFrame:
        """A copy of each row for every cell that its search box touches; adds ``cell``."""
        steps = F.sequence(F.floor((F.col("t") - self.within) / self.step), F.floor((F.col("t") + self.within) / self.step))
        low, high = F.greatest(F.col("lat") + 90 - self.reach, F.lit(0.0)), F.least(F.col("lat") + 90 + self.reach, F.lit(180.0))
        df = df.withColumn("_t", F.explode(steps)).withColumn("_band", F.explode(F.sequence(F.floor(low / self.size), F.floor(high / self.size))))
        cells = _cells_in_band(F.col("_band"), self.size)
        ratio = F.lit(math.sin(math.radians(self.reach))) / F.cos(F.radians("lat"))
        around = F.when(ratio < 1, F.degrees(F.asin(ratio)))  # null: the circle holds a pole
        first, last = F.floor((F.col("lon") - around) / 360 * cells), F.floor((F.col("lon") + around) / 360 * cells)
        whole = around.isNull() | (last - first + 1 >= cells)
        ring = F.when(whole, F.sequence(F.lit(0).cast("long"), cells - 1)).otherwise(F.sequence(first, last))
        return df.withColumn("_x", F.explode(ring)).withColumn("cell", self.number(F.col("_t"), F.col("_band"), F.pmod("_x", cells))).drop("_t", "_band", "_x")


def candidate_pairs(points: DataFrame, radius_km: float = 5.0, within_s: float = 1800.0) -> DataFrame:
    """id, t, lat, lon of both points (_a, _b) of each pair of different sources that meets in a cell; each pair once."""
    p = points.filter("id is not null and source is not null and lat between -90 and 90 and lon is not null and not isnan(lon)").select(
        F.col("id").cast("long").alias("id"), "source", seconds(F.col("time")).alias("t"), "lat", F.pmod("lon", F.lit(360.0)).alias("lon")
    )
    p = materialize(p.filter("t is not null"), "points")  # read twice below
    wide = Cells(radius_km, within_s, WIDE)
    # the search boxes of a source count once in each wide cell, whatever their number
    near = wide.touched(p).select("cell", F.col("source").alias("other")).distinct()
    own = wide.own(p)
    met = own.join(near, (own["cell"] == near["cell"]) & (own["source"] != near["other"]), "left_semi").drop("cell")
    met = materialize(met, "met")
    fine = Cells(radius_km, within_s, 1)
    a = fine.own(met).select("cell", F.col("source").alias("source_a"), F.col("id").alias("id_a"), F.col("t").alias("t_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = fine.touched(fine.own(met).withColumnRenamed("cell", "home")).filter("cell <= home")
    # which sources have a point in the cell; copies go on only to those of other sources
    present = a.select("cell", "source_a").distinct()
    b = b.join(present, "cell").filter("source <> source_a").select("cell", "source_a", "home", F.col("id").alias("id_b"), F.col("t").alias("t_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return a.join(b, ["cell", "source_a"]).filter((F.col("cell") < F.col("home")) | (F.col("id_a") < F.col("id_b"))).drop("cell", "home", "source_a")


def near_pairs(points: DataFrame, radius_km: float = 5.0, within_s: float = 1800.0) -> DataFrame:
    """``points``: id, source, time, lat, lon in degrees. Returns id_a < id_b, km, s of all pairs of points of
    different sources at most ``radius_km`` and ``within_s`` apart. Each pair comes once."""
    pairs = candidate_pairs(points, radius_km, within_s).withColumn("s", F.abs(F.col("t_a") - F.col("t_b"))).filter(F.col("s") <= within_s)
    km = great_circle_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), km.alias("km"), "s").filter(F.col("km") <= radius_km)


def containing_regions(points: DataFrame, regions: DataFrame, size: float = 2.0) -> DataFrame:
    """``points``: id, lat, lon. ``regions``: region, ring (array of struct lon, lat; lon continuous, within
    -360..720). Returns id, region of each point inside a region; borders on the west and south count as inside.

    Each region is cut into the cells of ``size`` degrees that its box touches; a cell carries only the edges that cross
    its band of latitude, which are all that ray casting along the band can meet. Points are joined on their cell and
    tested inside the JVM. Each point meets each region in one cell. Rings of fewer than three points hold nothing.
    """
    box = lambda f, k: f(F.transform("ring", lambda v: v[k]))
    r = regions.filter("region is not null and size(ring) >= 3").select("region", "ring", *[box(f, k).alias(f"{n}_{k}") for k in ("lon", "lat") for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    edges = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    r = r.withColumn("by", F.explode(F.sequence(F.floor((F.col("lo_lat") + 90) / size), F.floor((F.col("hi_lat") + 90) / size))))
    south = F.col("by") * size - 90
    in_band = lambda e: (F.greatest(e["a"]["lat"], e["b"]["lat"]) >= south) & (F.least(e["a"]["lat"], e["b"]["lat"]) <= south + size) & (e["a"]["lat"] != e["b"]["lat"])
    r = r.withColumn("edges", F.filter(edges, in_band)).withColumn("bx", F.explode(F.sequence(F.floor(F.col("lo_lon") / size), F.floor(F.col("hi_lon") / size))))
    turns = math.ceil(360 / size)
    r = r.groupBy("region", "by", F.pmod("bx", F.lit(turns)).alias("bx")).agg(F.collect_set(F.floor(F.col("bx") / turns) * 360).alias("shifts"), F.any_value("edges").alias("edges"))
    p = points.filter("id is not null and lat between -90 and 90 and lon is not null and not isnan(lon)").select("id", "lat", F.pmod("lon", F.lit(360.0)).alias("lon"))
    p = p.withColumn("by", F.floor((F.col("lat") + 90) / size)).withColumn("bx", F.floor(F.col("lon") / size))
    crosses = lambda x: F.filter(
        "edges",
        lambda e: ((e["a"]["lat"] <= F.col("lat")) != (e["b"]["lat"] <= F.col("lat")))
        & (x >= e["a"]["lon"] + (F.col("lat") - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) * (e["b"]["lon"] - e["a"]["lon"])),
    )
    inside = F.exists("shifts", lambda s: F.size(crosses(F.col("lon") + s)) % 2 == 1)
    return p.join(r, ["by", "bx"]).filter(inside).select("id", "region")
