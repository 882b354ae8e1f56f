"""Sources and sinks, filling and masking, further regridding, schedules and coupled kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import scalars
from tidemill.operators import basis, blend, fill, spatial, stencils, windows
from tidemill.plans.base import B_SQL, CELL, G_SQL, NI, NJ, R_SQL, Registry, field, nodes, q6, r6, readings, shared
from tidemill.plans.dynamics import _FD, _daily
from tidemill.plans.joins import _GW, CELLS_SQL, H_SQL, K_NEAR, RADIUS, WIDE, _observed, _wide, targets
from tidemill.sources import ingest, sinks
from tidemill.sources.tables import materialize, new_folder, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _ntz_day(c: str = "t") -> F.Column:
    return F.date_trunc("day", c).cast("timestamp_ntz")


@query(f"{R_SQL} SELECT CAST(date_trunc('day', t) AS TIMESTAMP) AS day, obs_class, count(*) AS n, {q6('sum(v)', '1e3')} AS total FROM r GROUP BY ALL")
def sink_windows_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings written as a folder per day and class, and read back."""
    path = new_folder(spark, "windows")
    sinks.write_windows(readings(spark, sf_dir).withColumn("day", F.to_date("t")), path, ["day", "obs_class"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("day").cast("timestamp_ntz").alias("day"), "obs_class").agg(F.count("*").alias("n"), r6(F.sum("v"), 1e3).alias("total"))


@query(f"{R_SQL} SELECT sensor, count(*) AS n FROM r GROUP BY sensor")
def cached_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest asked for twice: the second time it is read from the cache, which is named by the parameters."""
    key, folder = {"sf_dir": sf_dir, "table": "obs"}, new_folder(spark, "ingest")
    make = lambda: readings(spark, sf_dir).withColumn("day", F.to_date("t"))
    ingest.cached(spark, folder, key, make, ["day"])
    return ingest.cached(spark, folder, key, make, ["day"]).groupBy("sensor").agg(F.count("*").alias("n"))


@query(f"{R_SQL} SELECT obs_id, sensor, {q6('(ts - epoch_us(TIMESTAMP ' + chr(39) + '1993-01-01 00:00:00' + chr(39) + ') / 1e6) / 86400')} AS day, {q6('lon')} AS lon, {q6('lat')} AS lat, {q6('v')} AS v FROM r WHERE lon BETWEEN 100 AND 260 AND lat BETWEEN -60 AND 60 AND t BETWEEN TIMESTAMP '1993-01-02' AND TIMESTAMP '1993-01-09' AND v IS NOT NULL")
def get_obs_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.get_obs(readings(spark, sf_dir), (100.0, 260.0, -60.0, 60.0), "1993-01-02", "1993-01-09", "1993-01-01 00:00:00")
    return g.withColumns({c: r6(c) for c in ("day", "lon", "lat", "v")})


@query("""SELECT kind, count(*) AS n, count(xac) AS n_xac, count(node) AS n_node FROM (SELECT 'obs' AS kind, CASE WHEN NOT isnan(name_xac) THEN name_xac END AS xac, NULL::INT AS node FROM obs UNION ALL SELECT 'bc', NULL, node_id FROM bc) GROUP BY kind""")
def degraded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of differing columns under common roles; what one lacks is null."""
    o = ingest.scan(spark, [f"{sf_dir}/obs.parquet"], {"value": "name_var", "xac": "name_xac"}, hook=lambda d: d.withColumn("name_xac", F.when(~F.isnan("name_xac"), F.col("name_xac")))).withColumn("kind", F.lit("obs"))
    b = ingest.scan(spark, [f"{sf_dir}/bc.parquet"], {"value": "var", "node": "node_id"}).withColumn("kind", F.lit("bc"))
    return ingest.union_scans([o, b]).groupBy("kind").agg(F.count("*").alias("n"), F.count("xac").alias("n_xac"), F.count("node").alias("n_node"))


_CLS = "gc AS (SELECT obs_class, CAST(floor((lat + 90) / 30) AS BIGINT) AS j, CAST(floor(lon / 30) AS BIGINT) AS i, avg(v) AS h, count(v) AS n FROM r WHERE abs(v) < 5 GROUP BY ALL)"


def _by_class(r: DataFrame) -> DataFrame:
    return r.filter(F.abs("v") < 5).groupBy("obs_class", F.floor((F.col("lat") + 90) / WIDE).alias("j"), F.floor(F.col("lon") / WIDE).alias("i")).agg(F.avg("v").alias("h"), F.count("v").alias("n"))


@query(f"{R_SQL}, {_CLS} SELECT coalesce(a.j, b.j) AS j, coalesce(a.i, b.i) AS i, {q6('coalesce(b.h, a.h)')} AS h, a.n AS n_nadir FROM (SELECT * FROM gc WHERE obs_class = 'OBS_SSH_NADIR') a FULL JOIN (SELECT * FROM gc WHERE obs_class = 'OBS_SSH_SWATH') b ON a.j = b.j AND a.i = b.i")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The swath sensors' map put over the nadir sensors' in one state; other variables stay."""
    g = _by_class(readings(spark, sf_dir))
    old = g.filter("obs_class = 'OBS_SSH_NADIR'").select("j", "i", "h", F.col("n").alias("n_nadir"))
    new = g.filter("obs_class = 'OBS_SSH_SWATH'").select("j", "i", "h")
    return sinks.upsert_variables(old, new, ["j", "i"]).select("j", "i", r6("h").alias("h"), "n_nadir")


@query(f"""WITH {B_SQL}, s AS (SELECT * FROM b WHERE node_id IN (SELECT node_id FROM b GROUP BY node_id HAVING count(v) > 0)),
k AS (SELECT s.*, avg(v) OVER (PARTITION BY node_id) AS m, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS t0, first_value(v IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER n AS t1
FROM s WINDOW p AS (PARTITION BY node_id ORDER BY ts, bc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY node_id ORDER BY ts, bc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT bc_id, {q6('coalesce(v, 0)')} AS zero, {q6('coalesce(v, m)')} AS mean, {q6('CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN ts - t0 <= t1 - ts THEN v0 ELSE v1 END')} AS nearest FROM k""")
def nan_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing boundary values filled with 0, with the node's mean, and with the nearest valid value in time."""
    b = nodes(spark, sf_dir)
    b = b.join(b.groupBy("node_id").agg(F.avg("v").alias("m")).filter("m is not null"), "node_id")
    return fill.nearest_in_time(b, "node_id", "ts", "bc_id", "v").select("bc_id", r6(F.coalesce("v", F.lit(0.0))).alias("zero"), r6(F.coalesce("v", "m")).alias("mean"), r6("nearest").alias("nearest"))


@query(f"""{R_SQL}, {_GW}, e AS (SELECT j, i, approx AS lo, hi FROM (SELECT j, i, min(h) AS approx, max(h) AS hi FROM gw GROUP BY j, i)), k AS (SELECT obs_id, v, CAST(least(floor((lat + 90) / 30), 5) AS BIGINT) AS j, CAST(floor(lon / 30) AS BIGINT) AS i FROM r)
SELECT obs_id, {q6('CASE WHEN v BETWEEN lo AND hi THEN v END')} AS guarded, {q6('CASE WHEN v IS NOT NULL THEN least(greatest(v, lo), hi) END')} AS clamped FROM k JOIN e USING (j, i)""")
def range_guard_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings outside the range of their cell's daily means: nulled, and clamped."""
    r = shared(spark, sf_dir)
    e = _wide(r).groupBy("j", "i").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    r = r.withColumn("j", F.least(F.floor((F.col("lat") + 90) / WIDE), F.lit(5))).withColumn("i", F.floor(F.col("lon") / WIDE)).join(e, ["j", "i"])
    return r.select("obs_id", r6(F.when(F.col("v").between(F.col("lo"), F.col("hi")), F.col("v"))).alias("guarded"), r6(F.when(F.col("v").isNotNull(), F.least(F.greatest("v", "lo"), F.col("hi")))).alias("clamped"))


@query(f"{R_SQL}, e AS (SELECT sensor, min(abs(xac)) AS lo, max(abs(xac)) AS hi FROM r WHERE xac IS NOT NULL GROUP BY sensor) SELECT obs_id, {q6('CASE WHEN abs(xac) > lo + 5 AND abs(xac) < hi - 5 THEN v END')} AS v FROM r JOIN e USING (sensor) WHERE xac IS NOT NULL")
def swath_edge_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swath values within 5 km of the gap at nadir or of the outer edge are nulled."""
    r = readings(spark, sf_dir).filter("xac is not null")
    e = r.groupBy("sensor").agg(F.min(F.abs("xac")).alias("lo"), F.max(F.abs("xac")).alias("hi"))
    r = r.join(e, "sensor")
    return r.select("obs_id", r6(F.when((F.abs("xac") > F.col("lo") + 5) & (F.abs("xac") < F.col("hi") - 5), F.col("v"))).alias("v"))


@query(f"""{G_SQL}, x AS (SELECT avg({CELL} * {CELL} * cos(radians(lat))) AS a FROM g), y AS (SELECT avg(2.0 * 2.0 * cos(radians(lat))) AS a FROM r)
SELECT obs_id, {q6('coalesce(err, sigma, 1.0) * greatest(1.0, x.a / y.a)')} AS err FROM r, x, y""")
def l4_error_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors grown by the ratio of the map's cells to cells of two degrees, where that is above 1."""
    r = shared(spark, sf_dir)
    area = lambda d, s: d.agg(F.avg(s * s * F.cos(F.radians("lat"))).alias("a"))
    ratio = area(field(r), CELL).withColumnRenamed("a", "x").join(F.broadcast(area(r, 2.0)))  # one row each
    return r.join(F.broadcast(ratio)).select("obs_id", r6(F.coalesce("err", "sigma", F.lit(1.0)) * F.greatest(F.lit(1.0), F.col("x") / F.col("a"))).alias("err"))


@query(f"{R_SQL}, {_GW} SELECT CAST(floor(k / 5) AS BIGINT) AS win, j, i, {q6('avg(h) + 0.05')} AS h, count(*) AS n FROM gw GROUP BY ALL")
def l4_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the daily maps in windows of five days, with an offset added."""
    return _wide(readings(spark, sf_dir)).groupBy(F.floor(F.col("k") / 5).alias("win"), "j", "i").agg(r6(F.avg("h") + 0.05).alias("h"), F.count("*").alias("n"))


@query(f"{CELLS_SQL} SELECT cell_id, {q6('v')} AS v FROM k WHERE rk = 1")
def nearest_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest reading of each cell."""
    r = shared(spark, sf_dir).filter(F.abs("v") < 5)
    return spatial.idw(r, targets(r), 1, RADIUS, "v", "obs_id", "cell_id").select("cell_id", r6("v").alias("v"))


@query(f"{CELLS_SQL} SELECT cell_id, {q6('sum(v * exp(-0.5 * pow(d / 200, 2))) / sum(exp(-0.5 * pow(d / 200, 2)))')} AS v FROM k WHERE rk <= {K_NEAR} GROUP BY cell_id")
def parzen_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian window of 200 km over the eleven nearest readings of each cell."""
    r = shared(spark, sf_dir).filter(F.abs("v") < 5)
    near = fill.nearest_values(r, targets(r), K_NEAR, RADIUS, "v", "obs_id", "cell_id")
    w = F.exp(-0.5 * (F.col("d") / 200) ** 2)
    return near.groupBy("cell_id").agg(r6(F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


@query()
def rbf_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiquadric radial basis functions through the eleven nearest readings of each cell."""
    r = shared(spark, sf_dir).filter(F.abs("v") < 5)
    return fill.multiquadric(r, targets(r), K_NEAR, RADIUS, "v", "obs_id", "cell_id")


@query(f"""{G_SQL}, c AS (SELECT obs_id, (lat + 90) / {CELL} - 0.5 AS y, lon / {CELL} - 0.5 AS x FROM r), d AS (SELECT obs_id, CAST(floor(y) AS BIGINT) AS j, CAST(floor(x) AS BIGINT) AS i, y - floor(y) AS fy, x - floor(x) AS fx FROM c),
a AS (SELECT obs_id, CASE WHEN fx + fy <= 1 THEN j + dj ELSE j + 1 - dj END AS j, ((CASE WHEN fx + fy <= 1 THEN i + di ELSE i + 1 - di END) + {NI}) % {NI} AS i,
  CASE WHEN fx + fy <= 1 THEN CASE WHEN dj = 1 THEN fy WHEN di = 1 THEN fx ELSE 1 - fx - fy END ELSE CASE WHEN dj = 1 THEN 1 - fy WHEN di = 1 THEN 1 - fx ELSE fx + fy - 1 END END AS w FROM d, (VALUES (0, 0), (1, 0), (0, 1)) p(dj, di))
SELECT obs_id, {q6('sum(w * h)')} AS value FROM a JOIN g ON g.j = a.j AND g.i = a.i GROUP BY obs_id HAVING count(*) = 3""")
def triangle_to_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation on the lattice's triangles: each cell of four nodes is split along its diagonal."""
    r = shared(spark, sf_dir)
    return fill.on_triangles(r, field(r), CELL, "h").withColumn("value", r6("value"))


@query(f"""{R_SQL}, {B_SQL}, s AS (SELECT CAST(floor(ts / 21600 + 0.5) AS BIGINT) AS snap, avg(v) AS wind FROM b WHERE var_name = 'ssh' AND v IS NOT NULL GROUP BY snap), e AS (SELECT min(snap) AS a, max(snap) AS z FROM s)
SELECT obs_id, s.snap, {q6('wind')} AS wind FROM r, e, s WHERE s.snap = least(greatest(CAST(floor(r.ts / 21600 + 0.5) AS BIGINT), e.a), e.z)""")
def wind_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six-hourly snapshot of each reading's time, clipped to those there are; means of the boundary field stand for a wind."""
    snap = F.floor(F.col("ts") / 21600 + 0.5)
    s = nodes(spark, sf_dir).filter("var_name = 'ssh' and v is not null").groupBy(snap.alias("snap")).agg(F.avg("v").alias("wind"))
    e = s.agg(F.min("snap").alias("a"), F.max("snap").alias("z"))
    r = readings(spark, sf_dir).join(F.broadcast(e))  # one row
    return r.withColumn("snap", F.least(F.greatest(snap, F.col("a")), F.col("z"))).join(s, "snap").select("obs_id", "snap", r6("wind").alias("wind"))


@query("""SELECT l_orderkey, floor(sum(pow(l_discount, 3) * l_quantity) / sum(l_quantity) * 1e9 + 0.37) / 1e9 AS coupling FROM lineitem GROUP BY l_orderkey""")
def vertical_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-weighted mean of a mode's cube; an order's lines are its layers."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").cast("double").alias("d"), F.col("l_quantity").cast("double").alias("q"))
    c = li.groupBy("l_orderkey").agg((F.sum(F.pow("d", F.lit(3.0)) * F.col("q")) / F.sum("q")).alias("c"))
    return c.select("l_orderkey", (F.floor(F.col("c") * 1e9 + 0.37) / 1e9).alias("coupling"))


@query(f"{R_SQL} SELECT obs_id, {q6('0.1 + ln(1 + exp(-abs(20 * (v - 0.1)))) / 20 + greatest(v - 0.1, 0)')} AS soft, {q6('sqrt(v * v + 1e-4)')} AS mag, {q6('least(greatest((abs(v) - 0.1) / 0.4, 0), 1)')} AS att, {q6('greatest(v, 0) * err + least(v, 0) * sigma')} AS flux FROM r WHERE v IS NOT NULL")
def smooth_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft clamp, soft magnitude, attenuation and upwind flux of each value."""
    r = readings(spark, sf_dir).filter("v is not null")
    v = F.col("v")
    return r.select("obs_id", r6(scalars.soft_clamp(v, 0.1, 20.0)).alias("soft"), r6(scalars.soft_abs(v, 1e-2)).alias("mag"), r6(scalars.attenuation(F.abs(v), 0.1, 0.5)).alias("att"), r6(stencils.upwind_flux(v, F.col("err"), F.col("sigma"))).alias("flux"))


@query(f"{R_SQL}, {_FD} SELECT it, {q6('sum(wt * y)', '1e4')} AS x, count(*) AS n FROM fd JOIN gt USING (day) GROUP BY it")
def basis_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis by the offset basis, one number for each time centre: the transpose of broadcasting it is a sum."""
    d = materialize(_daily(readings(spark, sf_dir)), "daily")
    gt_ = basis.gt(d.select("day").distinct(), 5.0)
    return d.join(gt_, "day").groupBy("it").agg(r6(F.sum(F.col("wt") * F.col("y")), 1e4).alias("x"), F.count("*").alias("n"))


_GC = scalars.SQL["gaspari_cohn"]


@query(f"""{G_SQL}, ce AS (SELECT DISTINCT CAST(floor(lat / 20 + 0.5) AS BIGINT) AS pj, CAST(floor(lon / 20 + 0.5) AS BIGINT) % 18 AS pi FROM g), p AS (SELECT * FROM (SELECT pj, pi, lat - pj * 20 AS y, (lon - pi * 20 + 540) % 360 - 180 AS x FROM ce, g) WHERE abs(y) < 40 AND abs(x) < 40)
SELECT pj, pi, count(*) AS n, {q6(f'sum({_GC.format(r="x", c="40.0")} * {_GC.format(r="y", c="40.0")})', '1e4')} AS mass FROM p GROUP BY pj, pi""")
def basis_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass of each bump of the basis without directions: compact correlation functions on a lattice of 20 degrees."""
    g = field(readings(spark, sf_dir))
    c = basis.bumps(g, 20.0, 40.0, CELL)
    return c.groupBy("pj", "pi").agg(F.count("*").alias("n"), r6(F.sum("w"), 1e4).alias("mass"))


def _kept_steps(r: DataFrame, tolerance: float) -> DataFrame:
    seen = windows.nearest_step(r, 900.0, 0.0, tolerance).select("step")
    x = r.agg(F.floor(F.min("ts") / 900).alias("a"), F.floor(F.max("ts") / 900).alias("z"))
    daily = x.select(F.explode(F.sequence((F.ceil(F.col("a") / 96) * 96).cast("long"), F.col("z"), F.lit(96).cast("long"))).alias("step"))
    return seen.union(daily).distinct()


@query(f"{R_SQL}, x AS (SELECT floor(min(ts) / 900) AS a, floor(max(ts) / 900) AS z FROM r) SELECT CAST(step AS BIGINT) AS step FROM (SELECT ceil(ts / 900 - 0.5) AS step FROM r WHERE abs(ts - ceil(ts / 900 - 0.5) * 900) <= 300 UNION SELECT unnest(generate_series(CAST(ceil(a / 96) * 96 AS BIGINT), CAST(z AS BIGINT), 96)) FROM x)")
def checkpoint_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model steps at which the state is kept: those with readings, and one a day."""
    return _kept_steps(readings(spark, sf_dir), 300.0)


@query(f"{R_SQL}, x AS (SELECT floor(min(ts) / 900) AS a, floor(max(ts) / 900) AS z FROM r) SELECT CAST(step AS BIGINT) AS step FROM (SELECT ceil(ts / 900 - 0.5) AS step FROM r WHERE abs(ts - ceil(ts / 900 - 0.5) * 900) <= 450 UNION SELECT unnest(generate_series(CAST(ceil(a / 96) * 96 AS BIGINT), CAST(z AS BIGINT), 96)) FROM x)")
def checkpoint_half_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model steps at which the state is kept: those with readings within dt / 2, which are all, and one a day."""
    return _kept_steps(readings(spark, sf_dir), 450.0)


@query(f"""{H_SQL}, a AS (SELECT 'point' AS op_id, obs_id AS row_id, coalesce(sum(w * val) - any_value(v), 0) AS m FROM h GROUP BY obs_id),
t AS (SELECT 'map' AS op_id, cell_id AS row_id, sum(w * v) / sum(w) - any_value(val) AS m FROM h WHERE v IS NOT NULL GROUP BY cell_id) SELECT op_id, row_id, {q6('m')} AS m FROM (SELECT * FROM a UNION ALL SELECT * FROM t)""")
def multi_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misfits of two operators in one vector with op_id: at the readings, and at the nodes."""
    r, ocean, h = _observed(spark, sf_dir)
    pts = r.select("obs_id", "v")
    hx = spatial.matvec(h, ocean, "obs_id", "cell_id", "x", "hx")
    a = pts.join(hx, "obs_id").select(F.lit("point").alias("op_id"), F.col("obs_id").alias("row_id"), F.coalesce(F.col("hx") - F.col("v"), F.lit(0.0)).alias("m"))
    at = h.join(pts.filter("v is not null"), "obs_id").groupBy("cell_id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("y"))
    b = at.join(ocean, "cell_id").select(F.lit("map").alias("op_id"), F.col("cell_id").cast("long").alias("row_id"), (F.col("y") - F.col("x")).alias("m"))
    return a.unionByName(b).withColumn("m", r6("m"))


@query(f"""{R_SQL}, {_CLS}, d AS (SELECT a.j, a.i, a.h - b.h AS d FROM gc a JOIN gc b ON a.j = b.j AND a.i = b.i WHERE a.obs_class = 'OBS_SSH_NADIR' AND b.obs_class = 'OBS_SSH_SWATH')
SELECT d.j, d.i, {q6('(e.d - w.d) / 2')} AS gx, {q6('(n.d - s.d) / 2')} AS gy FROM d LEFT JOIN d e ON e.j = d.j AND e.i = (d.i + 1) % 12 LEFT JOIN d w ON w.j = d.j AND w.i = (d.i + 11) % 12 LEFT JOIN d n ON n.i = d.i AND n.j = d.j + 1 LEFT JOIN d s ON s.i = d.i AND s.j = d.j - 1""")
def gradient_misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the difference of two maps."""
    g = _by_class(readings(spark, sf_dir))
    n, s = (g.filter(F.col("obs_class") == c).select("j", "i", F.col("h").alias(a)) for c, a in (("OBS_SSH_NADIR", "hn"), ("OBS_SSH_SWATH", "hs")))
    d = n.join(s, ["j", "i"]).withColumn("d", F.col("hn") - F.col("hs"))
    d = stencils.neighbours(d, "d", stencils.CROSS, 12)
    return d.select("j", "i", r6((F.col("e") - F.col("w")) / 2).alias("gx"), r6((F.col("n") - F.col("s")) / 2).alias("gy"))


@query(f"""{R_SQL}, {_FD}, k AS (SELECT CAST(floor(day / 5) AS BIGINT) AS tw, CAST(floor(j / 6) AS BIGINT) AS yw, CAST(floor(i / 6) AS BIGINT) AS xw, count(DISTINCT j * 72 + i) / 36.0 AS part FROM fd GROUP BY ALL) SELECT tw, yw, xw, {q6('part')} AS part FROM k WHERE part >= 0.1""")
def covered_sub_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-windows of which at least a tenth of the cells holds readings; the others are skipped."""
    d = _daily(readings(spark, sf_dir))
    c = d.select(F.floor(F.col("day") / 5).alias("tw"), F.floor(F.col("j") / 6).alias("yw"), F.floor(F.col("i") / 6).alias("xw"), "j", "i").distinct()
    return c.groupBy("tw", "yw", "xw").agg((F.count("*") / 36.0).alias("part")).filter("part >= 0.1").withColumn("part", r6("part"))


@query(f"""{R_SQL}, {_GW} SELECT a.k, a.j, a.i, {q6('sum(0.3 * pow(0.7, a.k - b.k) * b.h)')} AS state FROM gw a JOIN gw b ON b.j = a.j AND b.i = a.i AND b.k <= a.k GROUP BY ALL""")
def warm_start_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each cell handed from day to day: 0.7 of the last state for each day since, and 0.3 of the day's map."""
    return blend.handed_on(_wide(readings(spark, sf_dir)), ["j", "i"], "k", "h", 0.7, 0.3).select("k", "j", "i", r6("state").alias("state"))
