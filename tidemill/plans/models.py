"""Single steps of the models as relations, and further bases."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import scalars
from tidemill.operators import basis, stencils
from tidemill.plans.base import B_SQL, CELL, G_SQL, NI, R_SQL, Registry, field, nodes, q6, r6, readings
from tidemill.plans.dynamics import _DX, _DY, _F, _FD, _daily
from tidemill.plans.extras import _CLS, _by_class

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"""{G_SQL}, st AS (SELECT g.j, g.i, g.lat, g.h, n.h AS n, s.h AS s, e.h AS e, w.h AS w FROM g JOIN g n ON n.j = g.j + 1 AND n.i = g.i JOIN g s ON s.j = g.j - 1 AND s.i = g.i JOIN g e ON e.j = g.j AND e.i = (g.i + 1) % {NI} JOIN g w ON w.j = g.j AND w.i = (g.i - 1 + {NI}) % {NI}),
uv AS (SELECT *, greatest(least(-9.81 / ({_F}) * (n - s) / (2 * {_DY}), 1), -1) AS u, greatest(least(9.81 / ({_F}) * (e - w) / (2 * {_DX}), 1), -1) AS v FROM st)
SELECT j, i, {q6(f'h - 86400 * (CASE WHEN u > 0 THEN u * (h - w) ELSE u * (e - h) END / {_DX} + CASE WHEN v > 0 THEN v * (h - s) ELSE v * (n - h) END / {_DY})')} AS tracer FROM uv""")
def tracer_advection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tracer equal to the map, carried for a day by the map's own geostrophic flow (at most 1 m/s), first-order upwind."""
    s = stencils.neighbours(field(readings(spark, sf_dir)), "h", stencils.CROSS, NI).filter("n is not null and s is not null and e is not null and w is not null")
    s = s.withColumn("lat", (F.col("j") + 0.5) * CELL - 90)
    u, v = (F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)) for c in stencils.geostrophic(F.col("h"), F.col("lat"), CELL))
    dx, dy = stencils.spacing(F.col("lat"), CELL)
    s = s.withColumn("u", u).withColumn("v", v)
    h = F.col("h")
    fx = F.when(F.col("u") > 0, F.col("u") * (h - F.col("w"))).otherwise(F.col("u") * (F.col("e") - h)) / dx
    fy = F.when(F.col("v") > 0, F.col("v") * (h - F.col("s"))).otherwise(F.col("v") * (F.col("n") - h)) / dy
    return s.select("j", "i", r6(h - 86400 * (fx + fy)).alias("tracer"))


@query(f"""{R_SQL}, {_CLS}, l AS (SELECT j, i, CASE WHEN obs_class = 'OBS_SSH_NADIR' THEN 1 ELSE 2 END AS layer, h FROM gc), e AS (SELECT *, sum(h) OVER (PARTITION BY j, i ORDER BY layer DESC) AS eta FROM l),
p AS (SELECT *, sum(CASE layer WHEN 1 THEN 9.81 ELSE 0.02 END * eta) OVER (PARTITION BY j, i ORDER BY layer) AS p FROM e)
SELECT a.j, a.i, a.layer, {q6('a.eta')} AS eta, {q6('a.p')} AS p, {q6('-(b.p - c.p) / (2 * 30.0 * 111000.0 * cos(radians((a.j + 0.5) * 30 - 90)))', '1e12')} AS du FROM p a LEFT JOIN p b ON b.layer = a.layer AND b.j = a.j AND b.i = (a.i + 1) % 12 LEFT JOIN p c ON c.layer = a.layer AND c.j = a.j AND c.i = (a.i + 11) % 12""")
def multilayer_tendency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers: interfaces cumulated from below, pressure from above by reduced gravity, and the pressure's pull along i."""
    layer = F.when(F.col("obs_class") == "OBS_SSH_NADIR", 1).otherwise(2)
    g = _by_class(readings(spark, sf_dir)).select("j", "i", layer.alias("layer"), "h")
    up, down = W.partitionBy("j", "i").orderBy(F.desc("layer")), W.partitionBy("j", "i").orderBy("layer")
    g = g.withColumn("eta", F.sum("h").over(up)).withColumn("p", F.sum(F.when(F.col("layer") == 1, 9.81).otherwise(0.02) * F.col("eta")).over(down))
    near = stencils.neighbours(g, "p", {"e": (0, 1), "w": (0, -1)}, 12, keys=("layer",))
    dx = stencils.spacing((F.col("j") + 0.5) * 30 - 90, 30.0)[0]
    return near.join(g.select("layer", "j", "i", "eta"), ["layer", "j", "i"]).select("j", "i", "layer", r6("eta").alias("eta"), r6("p").alias("p"), r6(-(F.col("e") - F.col("w")) / (2 * dx), 1e12).alias("du"))


_ANGLES = 4
_T = [(t, a) for t in ("M2", "S2") for a in range(_ANGLES)]


def _wave_sql(t: str, a: int) -> str:
    om, th = 2 * math.pi / (stencils.TIDES_H[t] * 3600), a * math.pi / _ANGLES
    k = f"sqrt(greatest(pow({om!r}, 2) - pow({_F}, 2), 0) / (9.81 * 0.9))"
    return f"0.01 * cos({k} * ({math.cos(th)!r} * lon + {math.sin(th)!r} * lat) * 111000.0 - {om!r} * ts) * (1 + {math.cos(th)!r})"


@query(f"""WITH {B_SQL}, x AS (SELECT min(lat) AS s, max(lat) AS n FROM b) SELECT bc_id, CASE WHEN lat = s THEN 'S' ELSE 'N' END AS side, {q6('sqrt(9.81 / 0.9) * (' + ' + '.join(_wave_sql(t, a) for t, a in _T) + ')', '1e5')} AS w1 FROM b, x WHERE lat = s OR lat = n""")
def tide_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming characteristic at the southern and northern nodes of a sum of plane tides over constituents and angles."""
    b = nodes(spark, sf_dir)
    b = b.join(F.broadcast(b.agg(F.min("lat").alias("south"), F.max("lat").alias("north"))))  # one row
    b = b.filter("lat = south or lat = north")
    total = F.lit(0.0)
    for t, a in _T:
        om, th = 2 * math.pi / (stencils.TIDES_H[t] * 3600), a * math.pi / _ANGLES
        k = F.sqrt(F.greatest(om**2 - scalars.coriolis(F.col("lat")) ** 2, F.lit(0.0)) / (scalars.GRAVITY * 0.9))
        phase = k * (math.cos(th) * F.col("lon") + math.sin(th) * F.col("lat")) * scalars.M_PER_DEG - om * F.col("ts")
        total = total + 0.01 * F.cos(phase) * (1 + math.cos(th))
    w1 = math.sqrt(scalars.GRAVITY / 0.9) * total
    return b.select("bc_id", F.when(F.col("lat") == F.col("south"), "S").otherwise("N").alias("side"), r6(w1, 1e5).alias("w1"))


@query(f"""{R_SQL}, {_FD} SELECT ift, it, {q6('sum(wt)')} AS total, count(*) AS n FROM (SELECT ift, it, pow(cos(pi() / 2 * (day - it * decay) / decay), 2) AS wt
FROM (SELECT ift, decay, day, unnest([CAST(floor(day / decay) AS BIGINT), CAST(floor(day / decay) AS BIGINT) + 1]) AS it FROM (SELECT DISTINCT day FROM fd), (VALUES (0, 3.0), (1, 6.0), (2, 12.0)) l(ift, decay))) GROUP BY ift, it""")
def basis_wavelet3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time factor of a basis that is a ladder in time as well."""
    g = basis.gt_ladder(_daily(readings(spark, sf_dir)).select("day").distinct(), [3.0, 6.0, 12.0])
    return g.groupBy("ift", "it").agg(r6(F.sum("wt")).alias("total"), F.count("*").alias("n"))


@query(f"""{R_SQL}, {_FD}, c AS (SELECT j, i, (j + 0.5) * {CELL} - 90 AS lat, (i + 0.5) * {CELL} AS lon, CASE WHEN count(*) > 1 THEN stddev_pop(y) END AS sd FROM fd GROUP BY j, i),
ce AS (SELECT DISTINCT CAST(floor(lat / 20 + 0.5) AS BIGINT) AS pj, CAST(floor(lon / 20 + 0.5) AS BIGINT) % 18 AS pi FROM c) SELECT pj, pi, {q6('avg(sd)')} AS std, {q6('coalesce(pow(avg(sd), 2), 1e-10)', '1e10')} AS q FROM ce JOIN c ON abs(lat - pj * 20) < 20 AND abs((lon - pi * 20 + 540) % 360 - 180) < 20 GROUP BY pj, pi""")
def basis_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of each centre from a map of the daily deviation around it."""
    d = _daily(readings(spark, sf_dir)).groupBy("j", "i").agg(F.when(F.count("*") > 1, F.stddev_pop("y")).alias("sd"))
    d = d.withColumn("lat", (F.col("j") + 0.5) * CELL - 90).withColumn("lon", (F.col("i") + 0.5) * CELL)
    s = basis.local_spread(d, "sd", 20.0, CELL)
    return s.select("pj", "pi", r6("std").alias("std"), r6("q", 1e10).alias("q"))


@query(f"""WITH {B_SQL}, x AS (SELECT min(lat) AS s FROM b), k AS (SELECT lon, ts / 86400 AS d FROM b, x WHERE lat = s), e AS (SELECT lon, d, CAST(floor(lon / 2) AS BIGINT) + dp AS p, CAST(floor(d / 5) AS BIGINT) + dt AS it FROM k, (VALUES (-1), (0), (1), (2)) a(dp), (VALUES (0), (1)) c(dt))
SELECT p, it, count(*) AS n, {q6('sum(exp(-pow((lon - p * 2) / 1.5, 2) / 2) * exp(-pow((d - it * 5) / 5, 2) / 2))', '1e4')} AS mass FROM e GROUP BY p, it""")
def basis_hbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass of each amplitude of the boundary basis along the southern rim."""
    b = nodes(spark, sf_dir)
    rim = b.join(F.broadcast(b.agg(F.min("lat").alias("south")))).filter("lat = south").select("lon", (F.col("ts") / 86400).alias("d"))
    return basis.boundary_amplitudes(rim, "d", 2.0, 1.5, 5.0).groupBy("p", "it").agg(F.count("*").alias("n"), r6(F.sum("w"), 1e4).alias("mass"))
