"""Spatial and temporal joins, the observation operator, blending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import scalars
from tidemill.operators import blend, spatial, windows
from tidemill.plans.base import B_SQL, CELL, G_SQL, NI, R_SQL, Registry, field, nodes, q6, r6, readings, shared
from tidemill.sources.tables import materialize, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

K, REACH = 4, 150.0


def _ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, lat, lon, x of the sea-level nodes with values; x is the node's mean."""
    b = nodes(spark, sf_dir).filter("var_name = 'ssh'")
    return b.groupBy(F.col("node_id").alias("cell_id")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.avg("v").alias("x")).filter("x is not null")


def _h(r: DataFrame, ocean: DataFrame) -> DataFrame:
    """The observation operator between all readings and the sea-level nodes; cells of the reach prune both sides."""
    return spatial.knn_weights(r, ocean, K, REACH)


def _observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(readings, sea-level nodes, observation operator), each a table that is used more than once."""
    r, ocean = shared(spark, sf_dir), materialize(_ocean(spark, sf_dir), "ocean")
    return r, ocean, materialize(_h(r, ocean), "h")


def _xyz(p: str = "") -> str:
    return ", ".join(f"{scalars.SQL[f'ecef_{a}']} AS {p}{a}" for a in "xyz")


# brute force: every point against every node
H_SQL = f"""{R_SQL}, {B_SQL},
oc AS (SELECT node_id AS cell_id, min(lat) AS lat, min(lon) AS lon, avg(v) AS x FROM b WHERE var_name = 'ssh' GROUP BY node_id HAVING avg(v) IS NOT NULL),
pt AS (SELECT *, {_xyz("p")} FROM r),
oq AS (SELECT cell_id, x AS val, {_xyz("c")} FROM oc),
pr AS (SELECT obs_id, ts, v, err, sigma, cell_id, val, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy) + (pz - cz) * (pz - cz)) AS d FROM pt, oq),
hk AS (SELECT *, exp(-d * d / (2 * 75.0 * 75.0)) AS g FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY d, cell_id) AS rk FROM pr WHERE d <= {REACH}) WHERE rk <= {K}),
h AS (SELECT *, g / sum(g) OVER (PARTITION BY obs_id) AS w FROM hk)"""


@query(f"{H_SQL} SELECT obs_id, cell_id, {q6('d', '1e4')} AS d, {q6('w')} AS w FROM h")
def knn_gauss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _h(readings(spark, sf_dir), _ocean(spark, sf_dir)).select("obs_id", "cell_id", r6("d", 1e4).alias("d"), r6("w").alias("w"))


@query(f"{H_SQL} SELECT obs_id, {q6('sum(w * val)')} AS hx FROM h GROUP BY obs_id")
def h_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    ocean = _ocean(spark, sf_dir)
    hx = spatial.matvec(_h(readings(spark, sf_dir), ocean), ocean, "obs_id", "cell_id", "x", "hx")
    return hx.select("obs_id", r6("hx").alias("hx"))


@query(f"{H_SQL} SELECT cell_id, {q6('sum(w * v)')} AS adj FROM h WHERE v IS NOT NULL GROUP BY cell_id")
def h_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _, h = _observed(spark, sf_dir)
    return spatial.matvec(h, r.filter("v is not null"), "cell_id", "obs_id", "v", "adj").select("cell_id", r6("adj").alias("adj"))


def _misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, ocean, h = _observed(spark, sf_dir)
    hx = spatial.matvec(h, ocean, "obs_id", "cell_id", "x", "hx")
    y = r.select("obs_id", "ts", "v", F.coalesce("err", "sigma", F.lit(1.0)).alias("e"))
    return y.join(hx, "obs_id").withColumn("m", F.coalesce((F.col("hx") - F.col("v")) / F.greatest("e", F.lit(1e-3)), F.lit(0.0)))


_M = f"{H_SQL}, mf AS (SELECT obs_id, any_value(ts) AS ts, coalesce((sum(w * val) - any_value(v)) / greatest(any_value(coalesce(err, sigma, 1.0)), 1e-3), 0.0) AS m FROM h GROUP BY obs_id)"


@query(f"{_M} SELECT obs_id, {q6('m', '1e4')} AS m FROM mf")
def misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _misfit(spark, sf_dir).select("obs_id", r6("m", 1e4).alias("m"))


@query(f"{_M} SELECT CAST(floor(ts / 21600) AS BIGINT) AS step, count(*) AS n, {q6('0.5 * sum(m * m)', '1e2')} AS cost FROM mf GROUP BY step")
def obs_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _misfit(spark, sf_dir)
    return m.groupBy(F.floor(F.col("ts") / 21600).alias("step")).agg(F.count("*").alias("n"), r6(0.5 * F.sum(F.col("m") ** 2), 1e2).alias("cost"))


@query(f"{R_SQL} SELECT obs_id, CAST(ceil(ts / 900 - 0.5) AS BIGINT) AS step, {q6('ts - ceil(ts / 900 - 0.5) * 900', '1e3')} AS lag_s FROM r WHERE abs(ts - ceil(ts / 900 - 0.5) * 900) <= 300")
def asof_nearest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.nearest_step(readings(spark, sf_dir), 900.0, 0.0, 300.0).select("obs_id", "step", r6("lag_s", 1e3).alias("lag_s"))


STEP_S = 900.0


@query(f"{R_SQL} SELECT obs_id, CAST(ceil(ts / 900 - 0.5) AS BIGINT) AS step, {q6('ts - ceil(ts / 900 - 0.5) * 900', '1e3')} AS lag_s FROM r WHERE abs(ts - ceil(ts / 900 - 0.5) * 900) <= 450")
def asof_half_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest step within dt / 2, the reference's tolerance, so that every reading has one; asof_nearest_step keeps 300 s."""
    return windows.nearest_step(readings(spark, sf_dir), STEP_S, 0.0, STEP_S / 2).select("obs_id", "step", r6("lag_s", 1e3).alias("lag_s"))


_NEAR = f"{H_SQL}, t1 AS (SELECT obs_id, ts, cell_id AS node_id FROM h), bs AS (SELECT * FROM b WHERE var_name = 'ssh' AND v IS NOT NULL)"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _, h = _observed(spark, sf_dir)
    return h.select("obs_id", F.col("cell_id").alias("node_id")).join(r.select("obs_id", "ts"), "obs_id")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).filter("var_name = 'ssh' and v is not null")


@query(f"""{_NEAR} SELECT obs_id, node_id, near_t, {q6('near_v')} AS near_v FROM (SELECT obs_id, t1.node_id, bs.ts AS near_t, bs.v AS near_v, row_number() OVER (PARTITION BY obs_id, t1.node_id ORDER BY abs(bs.ts - t1.ts), bs.ts) AS rk
FROM t1 JOIN bs ON bs.node_id = t1.node_id AND abs(bs.ts - t1.ts) <= 10800) WHERE rk = 1""")
def bc_nearest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = windows.nearest_rows(_targets(spark, sf_dir), _samples(spark, sf_dir), ["node_id"], "ts", "ts", "v", 10800.0)
    return near.select("obs_id", "node_id", "near_t", r6("near_v").alias("near_v"))


@query(f"""{_NEAR} SELECT obs_id, node_id, near_t, {q6('near_v')} AS near_v FROM (SELECT obs_id, t1.node_id, bs.ts AS near_t, bs.v AS near_v, row_number() OVER (PARTITION BY obs_id, t1.node_id ORDER BY abs(bs.ts - t1.ts), bs.ts, bs.v) AS rk
FROM t1 JOIN bs ON bs.node_id = t1.node_id) WHERE rk = 1""")
def bc_nearest_any_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest boundary value however far in time, as the reference takes it; bc_nearest_time keeps 10,800 s."""
    near = windows.nearest_sample(_targets(spark, sf_dir), _samples(spark, sf_dir), ["node_id"], "ts", "ts", "v", 21600.0)
    return near.select("obs_id", "node_id", "near_t", r6("near_v").alias("near_v"))


def _lerp_sql(shift: int) -> str:
    return f"""{_NEAR}, t2 AS (SELECT DISTINCT node_id, ts - {shift} AS ts FROM t1),
lo AS (SELECT t2.node_id, t2.ts, max(bs.ts) AS t0 FROM t2 JOIN bs ON bs.node_id = t2.node_id AND bs.ts <= t2.ts GROUP BY ALL),
hi AS (SELECT t2.node_id, t2.ts, min(bs.ts) AS t1 FROM t2 JOIN bs ON bs.node_id = t2.node_id AND bs.ts >= t2.ts GROUP BY ALL),
lv AS (SELECT t2.*, t0, t1, b0.v AS v0, b1.v AS v1 FROM t2 LEFT JOIN lo USING (node_id, ts) LEFT JOIN hi USING (node_id, ts)
       LEFT JOIN bs b0 ON b0.node_id = t2.node_id AND b0.ts = t0 LEFT JOIN bs b1 ON b1.node_id = t2.node_id AND b1.ts = t1)
SELECT node_id, ts, {q6('coalesce(CASE WHEN t1 > t0 THEN v0 + (ts - t0) / (t1 - t0) * (v1 - v0) END, v0, v1)')} AS v FROM lv"""


@query(_lerp_sql(0))
def time_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(spark, sf_dir).select("node_id", "ts").distinct()
    return windows.lerp_in_time(t, _samples(spark, sf_dir), ["node_id"], "v").withColumn("v", r6("v"))


@query(_lerp_sql(4320000))
def bc_clamp_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets moved 50 days back lie before the first boundary field (at small scales) and take the nearest end."""
    t = _targets(spark, sf_dir).select("node_id", (F.col("ts") - 4320000).alias("ts")).distinct()
    return windows.lerp_in_time(t, _samples(spark, sf_dir), ["node_id"], "v").withColumn("v", r6("v"))


_BL = f"""{G_SQL}, c AS (SELECT obs_id, v, (lat + 90) / {CELL} - 0.5 AS y, lon / {CELL} - 0.5 AS x FROM r),
a AS (SELECT obs_id, v, floor(y) + dj AS j, (CAST(floor(x) AS BIGINT) + di + {NI}) % {NI} AS i, abs(1 - dj - (y - floor(y))) * abs(1 - di - (x - floor(x))) AS w FROM c, (VALUES (0), (1)) p(dj), (VALUES (0), (1)) q(di)),
bl AS (SELECT obs_id, any_value(a.v) AS v, sum(w * h) AS m FROM a JOIN g ON g.j = a.j AND g.i = a.i GROUP BY obs_id HAVING count(*) = 4)"""


@query(f"{_BL} SELECT obs_id, {q6('m')} AS value FROM bl")
def bilinear_to_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shared(spark, sf_dir)
    return spatial.interpolate(r, field(r), CELL, "h").withColumn("value", r6("value"))


@query(f"{_BL} SELECT obs_id, {q6('v + m')} AS plus, {q6('v - m')} AS minus FROM bl")
def mdt_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map added to, and taken from, the readings."""
    r = shared(spark, sf_dir)
    m = spatial.interpolate(r, field(r), CELL, "h", to="m")
    return r.join(m, "obs_id").select("obs_id", r6(F.col("v") + F.col("m")).alias("plus"), r6(F.col("v") - F.col("m")).alias("minus"))


WIDE = 30.0
_GW = f"gw AS (SELECT CAST(floor(ts / 86400) AS BIGINT) AS k, CAST(least(floor((lat + 90) / {WIDE}), 5) AS BIGINT) AS j, CAST(floor(lon / {WIDE}) AS BIGINT) AS i, avg(v) AS h FROM r WHERE abs(v) < 5 GROUP BY ALL)"


def _wide(r: DataFrame) -> DataFrame:
    j = F.least(F.floor((F.col("lat") + 90) / WIDE), F.lit(5))
    return r.filter(F.abs("v") < 5).groupBy(F.floor(F.col("ts") / 86400).alias("k"), j.alias("j"), F.floor(F.col("lon") / WIDE).alias("i")).agg(F.avg("v").alias("h"))


@query(f"""{R_SQL}, {_GW}, c AS (SELECT obs_id, (lat + 90) / {WIDE} - 0.5 AS y, lon / {WIDE} - 0.5 AS x, ts / 86400 - 0.5 AS s FROM r),
a AS (SELECT obs_id, floor(y) + dj AS j, (CAST(floor(x) AS BIGINT) + di + 12) % 12 AS i, floor(s) + dk AS k, abs(1 - dj - (y - floor(y))) * abs(1 - di - (x - floor(x))) * abs(1 - dk - (s - floor(s))) AS w
      FROM c, (VALUES (0), (1)) p(dj), (VALUES (0), (1)) q(di), (VALUES (0), (1)) u(dk))
SELECT obs_id, {q6('sum(w * h)')} AS value FROM a JOIN gw ON gw.j = a.j AND gw.i = a.i AND gw.k = a.k GROUP BY obs_id HAVING count(*) = 8""")
def trilinear_to_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shared(spark, sf_dir)
    return spatial.interpolate(r, _wide(r), WIDE, "h", at_time="ts").withColumn("value", r6("value"))


K_NEAR, RADIUS = 11, 600.0
# every reading lies in a target's cell, so each is within reach of one; brute force over all targets and readings
CELLS_SQL = f"""{G_SQL}, mq AS (SELECT j * {NI} + i AS cell_id, {_xyz('c')} FROM g), rq AS (SELECT obs_id, v, {_xyz('p')} FROM r WHERE abs(v) < 5),
dd AS (SELECT cell_id, obs_id, v, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy) + (pz - cz) * (pz - cz)) AS d FROM mq, rq WHERE abs(px - cx) <= {RADIUS} AND abs(py - cy) <= {RADIUS} AND abs(pz - cz) <= {RADIUS}),
k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, obs_id) AS rk FROM dd WHERE d <= {RADIUS})"""


def targets(r: DataFrame) -> DataFrame:
    """cell_id, lat, lon of the map's cells that hold readings."""
    return field(r).select((F.col("j") * NI + F.col("i")).alias("cell_id"), "lat", "lon")


@query(f"{CELLS_SQL} SELECT cell_id, {q6('sum(v / (greatest(d, 1e-3) * greatest(d, 1e-3))) / sum(1 / (greatest(d, 1e-3) * greatest(d, 1e-3)))')} AS v, count(*) AS n FROM k WHERE rk <= {K_NEAR} GROUP BY cell_id")
def idw_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shared(spark, sf_dir).filter(F.abs("v") < 5)
    return spatial.idw(r, targets(r), K_NEAR, RADIUS, "v", "obs_id", "cell_id").withColumn("v", r6("v"))


@query(f"""WITH {B_SQL}, a AS (SELECT node_id, min(lat) AS lat, min(lon) AS lon, count(v) AS n FROM b GROUP BY node_id),
q AS (SELECT node_id, n, {_xyz("p")} FROM a), e AS (SELECT o.node_id, min(sqrt((o.px - l.px) * (o.px - l.px) + (o.py - l.py) * (o.py - l.py) + (o.pz - l.pz) * (o.pz - l.pz))) AS d FROM q o, q l WHERE o.n > 0 AND l.n = 0 GROUP BY o.node_id),
f AS (SELECT q.node_id, CASE WHEN d IS NOT NULL THEN greatest(d - 40, 0) END AS d FROM q LEFT JOIN e USING (node_id) WHERE n > 0)
SELECT node_id, {q6('d', '1e3')} AS km, {q6("coalesce(" + scalars.SQL['smoothstep'].format(x='least(d / 300.0, 1)') + ", 0.0)")} AS taper FROM f""")
def boundary_distance_taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each sea node to the nearest land node less half a cell, however far, and the sponge's weight."""
    b = materialize(nodes(spark, sf_dir).groupBy("node_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.count("v").alias("n")), "nodes")
    sea, land = b.filter("n > 0"), b.filter("n = 0").withColumnRenamed("node_id", "cell_id")
    near = spatial.nearest_distance(sea, land, 500.0, "node_id", "cell_id").withColumn("d", F.greatest(F.col("d") - 40, F.lit(0.0)))
    out = sea.select("node_id").join(near, "node_id", "left")
    return out.select("node_id", r6("d", 1e3).alias("km"), r6(F.coalesce(scalars.smoothstep_taper(F.col("d"), 300.0), F.lit(0.0))).alias("taper"))


@query(f"""WITH {B_SQL}, a AS (SELECT node_id, min(lat) AS lat, min(lon) AS lon FROM b GROUP BY node_id), e AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM a),
x AS (SELECT node_id, least((lat - s) / 5, 1) AS a1, least((n - lat) / 5, 1) AS a2, least((lon - w) / 5, 1) AS a3, least((e - lon) / 5, 1) AS a4 FROM a, e)
SELECT node_id, {q6(f"1 - (1 - ({scalars.SQL['smoothstep'].format(x='a1')})) * (1 - ({scalars.SQL['smoothstep'].format(x='a2')})) * (1 - ({scalars.SQL['smoothstep'].format(x='a3')})) * (1 - ({scalars.SQL['smoothstep'].format(x='a4')}))")} AS w FROM x""")
def sponge_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of the sponge along the four sides of the domain of the boundary nodes: 1 - product of (1 - w)."""
    a = nodes(spark, sf_dir).groupBy("node_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    e = a.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    a = a.join(F.broadcast(e))  # one row
    sides = [F.col("lat") - F.col("s"), F.col("n") - F.col("lat"), F.col("lon") - F.col("w"), F.col("e") - F.col("lon")]
    keep = F.lit(1.0)
    for d in sides:
        keep = keep * (1 - scalars.smoothstep_taper(d, 5.0))
    return a.select("node_id", r6(1 - keep).alias("w"))


@query(f"""{R_SQL}, g AS (SELECT date_trunc('day', t) AS day, obs_class, CAST(floor((lat + 90) / {WIDE}) AS BIGINT) AS j, CAST(floor(lon / {WIDE}) AS BIGINT) AS i, avg(v) AS h FROM r WHERE abs(v) < 5 GROUP BY ALL)
SELECT CAST(n.day AS TIMESTAMP) AS day, n.j, n.i, {q6('n.h - s.h')} AS diff FROM g n JOIN g s ON n.day = s.day AND n.j = s.j AND n.i = s.i WHERE n.obs_class = 'OBS_SSH_NADIR' AND s.obs_class = 'OBS_SSH_SWATH'""")
def map_map_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps on one grid, joined on time and cell."""
    r = readings(spark, sf_dir).filter(F.abs("v") < 5)
    g = r.groupBy(F.date_trunc("day", "t").cast("timestamp_ntz").alias("day"), "obs_class", F.floor((F.col("lat") + 90) / WIDE).alias("j"), F.floor(F.col("lon") / WIDE).alias("i")).agg(F.avg("v").alias("h"))
    n, s = (g.filter(F.col("obs_class") == c).drop("obs_class").withColumnRenamed("h", a) for c, a in (("OBS_SSH_NADIR", "hn"), ("OBS_SSH_SWATH", "hs")))
    return n.join(s, ["day", "j", "i"]).select("day", "j", "i", r6(F.col("hn") - F.col("hs")).alias("diff"))


@query("SELECT sensor, file_id, saved_at FROM (SELECT obs_name AS sensor, file_id, saved_at, row_number() OVER (PARTITION BY obs_name ORDER BY saved_at DESC, file_id DESC) AS rk FROM dict_obs WHERE saved_at IS NOT NULL AND obs_name IS NOT NULL) WHERE rk = 1")
def latest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last file of each sensor: a partial aggregate of (time, id), no sort."""
    d = table(spark, sf_dir, "dict_obs").filter("saved_at is not null and obs_name is not null")
    m = d.groupBy(F.col("obs_name").alias("sensor")).agg(F.max(F.struct("saved_at", "file_id")).alias("m"))
    return m.select("sensor", "m.file_id", "m.saved_at")


@query(f"""WITH k AS (SELECT node_id, name_time AS t, var, recv_time, bc_id FROM bc WHERE name_time IS NOT NULL AND NOT isnan(var))
SELECT node_id, t, {q6('var', '1e4')} AS var FROM (SELECT *, row_number() OVER (PARTITION BY node_id, t ORDER BY recv_time DESC NULLS LAST, bc_id DESC) AS rk FROM k) WHERE rk = 1 AND abs(var) < 1e6""")
def last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of deliveries where the last received value of a node and step holds."""
    b = table(spark, sf_dir, "bc").filter("name_time is not null and var is not null and not isnan(var)")
    last = b.groupBy("node_id", F.col("name_time").alias("t")).agg(F.max_by("var", F.struct("recv_time", "bc_id")).alias("var"))
    return last.filter(F.abs("var") < 1e6).select("node_id", "t", r6("var", 1e4).alias("var"))


@query(f"""{G_SQL}, k AS (SELECT g.*, unnest([floor(lon / 30), floor(lon / 30) - 1]) AS w FROM g),
m AS (SELECT CAST((CAST(w AS BIGINT) + 12) % 12 AS BIGINT) AS w, j, i, h, 0.5 * (1 - cos(2 * pi() * ((lon - w * 30) / 60))) AS wt FROM k), a AS (SELECT w, avg(h) AS mean FROM m GROUP BY w)
SELECT j, i, {q6('sum(wt * (h - mean)) / sum(wt)')} AS v, count(*) AS n_windows FROM m JOIN a USING (w) GROUP BY j, i""")
def space_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-windows of 60 degrees that overlap by half, each with its own mean taken out, blended by Hann weights."""
    parts = blend.overlapping(field(readings(spark, sf_dir)), "lon", 60.0, 30.0).withColumn("sub_window", F.pmod("sub_window", F.lit(12)))
    mean = parts.groupBy("sub_window").agg(F.avg("h").alias("mean"))
    each = parts.join(mean, "sub_window").withColumn("v", F.col("h") - F.col("mean"))
    return blend.weighted(each, ["j", "i"], "v").withColumn("v", r6("v"))


@query(f"""{R_SQL}, k AS (SELECT v, ts / 86400 AS d, CAST(floor((lat + 90) / {WIDE}) AS BIGINT) AS j, CAST(floor(lon / {WIDE}) AS BIGINT) AS i FROM r WHERE abs(v) < 5),
e AS (SELECT *, unnest([floor(d / 3), floor(d / 3) - 1]) AS w FROM k), a AS (SELECT CAST(w AS BIGINT) AS w, j, i, avg(v) AS m FROM e GROUP BY ALL),
dy AS (SELECT DISTINCT CAST(floor(d) AS BIGINT) AS day, j, i FROM k), p AS (SELECT day, j, i, unnest([CAST(floor((day + 0.5) / 3) AS BIGINT), CAST(floor((day + 0.5) / 3) AS BIGINT) - 1]) AS w FROM dy)
SELECT day, j, i, {q6('sum(0.5 * (1 - cos(2 * pi() * (day + 0.5 - w * 3) / 6)) * m) / sum(0.5 * (1 - cos(2 * pi() * (day + 0.5 - w * 3) / 6)))')} AS v, count(*) AS n_windows FROM p JOIN a USING (w, j, i) GROUP BY day, j, i""")
def time_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time windows of six days that overlap by three: each has its own mean map; days blend their active windows."""
    r = readings(spark, sf_dir).filter(F.abs("v") < 5).withColumn("d", F.col("ts") / 86400)
    r = r.withColumn("j", F.floor((F.col("lat") + 90) / WIDE)).withColumn("i", F.floor(F.col("lon") / WIDE))
    maps = blend.overlapping(r, "d", 6.0, 3.0).groupBy("sub_window", "j", "i").agg(F.avg("v").alias("m"))
    days = r.select(F.floor("d").alias("day"), "j", "i").distinct().withColumn("mid", F.col("day") + 0.5)
    each = blend.overlapping(days, "mid", 6.0, 3.0).join(maps, ["sub_window", "j", "i"])
    return blend.weighted(each, ["day", "j", "i"], "m", "v").withColumn("v", r6("v"))


@query(f"""{R_SQL}, x AS (SELECT floor(min(ts) / 86400) AS d0, floor(max(ts) / 86400) AS d1 FROM r),
w AS (SELECT unnest(generate_series(CAST(floor(d0 / 3) - 1 AS BIGINT), CAST(floor(d1 / 3) AS BIGINT))) AS tw FROM x), y AS (SELECT unnest(generate_series(-3, 2)) AS yw), z AS (SELECT unnest(generate_series(0, 11)) AS xw)
SELECT tw, yw, xw, CAST(tw * 3 AS DOUBLE) AS day0, CAST(tw * 3 + 6 AS DOUBLE) AS day1, CAST(yw * 30 AS DOUBLE) AS lat0, CAST(yw * 30 + 60 AS DOUBLE) AS lat1, CAST(xw * 30 AS DOUBLE) AS lon0, CAST(xw * 30 + 60 AS DOUBLE) AS lon1 FROM w, y, z""")
def sub_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decomposition of the readings' time and the globe into overlapping sub-windows."""
    return blend.sub_windows(readings(spark, sf_dir), days=6.0, degrees=60.0)
