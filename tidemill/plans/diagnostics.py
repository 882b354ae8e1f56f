"""Statistics, scores, segments and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators import segments, stats
from tidemill.operators.proximity import great_circle_km
from tidemill.plans.base import CELL, NJ, R_SQL, Registry, q6, r6, readings
from tidemill.sources.tables import materialize, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"""{R_SQL} SELECT sensor, CAST(floor(ts / 86400) AS BIGINT) AS bin, {q6('avg(v)')} AS mean, {q6('min(v)')} AS min, {q6('max(v)')} AS max, count(v) AS count, {q6('var_pop(v)', '1e4')} AS variance, {q6('sqrt(avg(v * v))')} AS rms, {q6('median(v)')} AS median FROM r GROUP BY ALL""")
def resample_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.resample(readings(spark, sf_dir), ["sensor"], "v")
    return s.withColumns({c: r6(c) for c in ("mean", "min", "max", "rms", "median")} | {"variance": r6("variance", 1e4)})


@query(f"""{R_SQL}, k AS (SELECT sensor, CAST(floor(ts / 3600) AS BIGINT) AS bin, count(v) AS count FROM r GROUP BY ALL), c AS (SELECT sensor, unnest(generate_series(min(bin), max(bin))) AS bin FROM k GROUP BY sensor)
SELECT sensor, bin, coalesce(count, 0) AS count FROM c LEFT JOIN k USING (sensor, bin)""")
def calendar_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = readings(spark, sf_dir).groupBy("sensor", F.floor(F.col("ts") / 3600).alias("bin")).agg(F.count("v").alias("count"))
    return stats.with_empty_bins(s, ["sensor"]).withColumn("count", F.coalesce("count", F.lit(0)))


@query(f"""{R_SQL}, k AS (SELECT CAST(floor((lat + 90) / 10 + 0.5) AS BIGINT) AS j, CAST(floor(lon / 10 + 0.5) AS BIGINT) AS i, v FROM r WHERE abs(v) < 5),
m AS (SELECT j, i, avg(v) AS mu, var_pop(v) AS va FROM k GROUP BY j, i)
SELECT j, i, {q6('min(v)')} AS min, {q6('max(v)')} AS max, {q6('sum(v)', '1e4')} AS sum, count(*) AS count, {q6('avg(v)')} AS mean, {q6('any_value(va)')} AS variance,
       {q6('CASE WHEN count(*) > 2 AND any_value(va) > 1e-9 THEN avg(pow(v - mu, 3)) / pow(any_value(va), 1.5) END', '1e4')} AS skewness, {q6('CASE WHEN count(*) > 2 AND any_value(va) > 1e-9 THEN avg(pow(v - mu, 4)) / pow(any_value(va), 2) - 3 END', '1e4')} AS kurtosis FROM k JOIN m USING (j, i) GROUP BY j, i""")
def bin2d_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.bin2d(readings(spark, sf_dir).filter(F.abs("v") < 5), "v", 10.0)
    shaped = (F.col("count") > 2) & (F.col("variance") > 1e-9)  # fewer or equal values have no shape
    s = s.withColumns({c: F.when(shaped, F.col(c)) for c in ("skewness", "kurtosis")})
    return s.withColumns({c: r6(c) for c in ("min", "max", "mean", "variance")} | {c: r6(c, 1e4) for c in ("sum", "skewness", "kurtosis")})


def runs(r: DataFrame) -> DataFrame:
    """run, obs_id, sensor, ts, lat, lon, ref, exp: the map of the nadir sensors ('experiment') and its zonal mean ('baseline')
    at the readings of the swath sensors, which are withheld from it."""
    r = materialize(r.filter(F.abs("v") < 5).select("obs_id", "sensor", "obs_class", "ts", "lat", "lon", "v"), "readings")  # used four times
    j, i = F.least(F.floor((F.col("lat") + 90) / CELL), F.lit(NJ - 1)), F.floor(F.col("lon") / CELL)
    r = r.withColumn("j", j).withColumn("i", i)
    made, ref = r.filter("obs_class = 'OBS_SSH_NADIR'"), r.filter("obs_class = 'OBS_SSH_SWATH'").withColumnRenamed("v", "ref")
    exp = made.groupBy("j", "i").agg(F.avg("v").alias("exp"))
    bas = made.groupBy("j").agg(F.avg("v").alias("exp"))
    cols = ["obs_id", "sensor", "ts", "lat", "lon", "j", "i", "ref", "exp"]
    return ref.join(exp, ["j", "i"]).select(F.lit("experiment").alias("run"), *cols).unionByName(ref.join(bas, "j").select(F.lit("baseline").alias("run"), *cols))


E_SQL = f"""{R_SQL}, k AS (SELECT *, CAST(least(floor((lat + 90) / {CELL}), {NJ - 1}) AS BIGINT) AS j, CAST(floor(lon / {CELL}) AS BIGINT) AS i FROM r WHERE abs(v) < 5),
n AS (SELECT * FROM k WHERE obs_class = 'OBS_SSH_NADIR'), w AS (SELECT * FROM k WHERE obs_class = 'OBS_SSH_SWATH'),
me AS (SELECT j, i, avg(v) AS exp FROM n GROUP BY j, i), mb AS (SELECT j, avg(v) AS exp FROM n GROUP BY j),
e AS (SELECT 'experiment' AS run, obs_id, sensor, ts, lat, lon, j, i, v AS ref, exp FROM w JOIN me USING (j, i) UNION ALL SELECT 'baseline', obs_id, sensor, ts, lat, lon, j, i, v, exp FROM w JOIN mb USING (j))"""
_D = f"{E_SQL}, d AS (SELECT run, CAST(floor(ts / 86400) AS BIGINT) AS day, count(*) AS n, sqrt(avg((exp - ref) * (exp - ref))) AS rmse, sqrt(avg(ref * ref)) AS rms FROM e GROUP BY ALL HAVING count(*) >= 10)"


@query(f"{_D} SELECT run, day, n, {q6('rmse')} AS rmse, {q6('rms')} AS rms, {q6('1 - rmse / rms')} AS score FROM d")
def rmse_t_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.daily_scores(runs(readings(spark, sf_dir)), "ref", "exp")
    return d.withColumns({c: r6(c) for c in ("rmse", "rms", "score")})


@query(f"{E_SQL} SELECT run, j, i, count(*) AS n, {q6('sqrt(avg((exp - ref) * (exp - ref)))')} AS rmse FROM e GROUP BY ALL")
def rmse_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs(readings(spark, sf_dir))
    return e.groupBy("run", "j", "i").agg(F.count("*").alias("n"), r6(stats.rmse(F.col("exp") - F.col("ref"))).alias("rmse"))


@query(f"{_D} SELECT run, {q6('avg(1 - rmse / rms)')} AS mu, {q6('stddev_pop(1 - rmse / rms)')} AS sigma, {q6('avg(rmse)')} AS rmse, count(*) AS n_days FROM d GROUP BY run")
def leaderboard_ose(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stats.leaderboard(stats.daily_scores(runs(readings(spark, sf_dir)), "ref", "exp"))
    return b.withColumns({c: r6(c) for c in ("mu", "sigma", "rmse")})


@query(f"{E_SQL}, s AS (SELECT run, sqrt(avg((exp - ref) * (exp - ref))) AS x FROM e GROUP BY run) SELECT {q6('100 * (a.x - b.x) / b.x')} AS osse_pct, {q6('100 * (a.x * a.x - b.x * b.x) / (b.x * b.x)')} AS ose_pct FROM s a, s b WHERE a.run = 'experiment' AND b.run = 'baseline'")
def improvement_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs(readings(spark, sf_dir))
    d = F.col("exp") - F.col("ref")
    at = lambda run: F.sqrt(F.avg(F.when(F.col("run") == run, d * d)))
    s = e.agg(at("experiment").alias("x"), at("baseline").alias("b")).filter("x is not null and b is not null")
    return s.select(r6(100 * (F.col("x") - F.col("b")) / F.col("b")).alias("osse_pct"), r6(100 * (F.col("x") ** 2 - F.col("b") ** 2) / F.col("b") ** 2).alias("ose_pct"))


@query(f"{E_SQL} SELECT run, sensor, count(*) AS n, {q6('1 - sqrt(avg((exp - ref) * (exp - ref))) / sqrt(avg(ref * ref))')} AS score FROM e GROUP BY ROLLUP (run, sensor)")
def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global score by run and sensor, by run, and of all."""
    d = F.col("exp") - F.col("ref")
    return runs(readings(spark, sf_dir)).rollup("run", "sensor").agg(F.count("*").alias("n"), r6(1 - stats.rmse(d) / F.sqrt(F.avg(F.col("ref") ** 2))).alias("score"))


@query(f"""{R_SQL}, k AS (SELECT sensor, lon, lat, v FROM r WHERE abs(v) < 5), m AS (SELECT sensor, var_pop(lon) AS xx, var_pop(lat) AS yy, covar_pop(lon, lat) AS xy, covar_pop(lon, v) AS xz, covar_pop(lat, v) AS yz, count(*) AS n FROM k GROUP BY sensor)
SELECT sensor, {q6('(xz * yy - yz * xy) / (xx * yy - xy * xy)', '1e9')} AS a, {q6('(yz * xx - xz * xy) / (xx * yy - xy * xy)', '1e9')} AS b, n FROM m WHERE xx * yy - xy * xy > 1e-9 * xx * yy""")
def detrend_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.plane_fit(readings(spark, sf_dir).filter(F.abs("v") < 5), ["sensor"], "lon", "lat", "v")
    return f.filter("a is not null").select("sensor", r6("a", 1e9).alias("a"), r6("b", 1e9).alias("b"), "n")


@query(f"{R_SQL} SELECT sensor, {q6('sum(v * err)', '1e4')} AS dot, {q6('max(abs(v))')} AS max_abs, {q6('avg(abs(v))')} AS mean_abs, count(*) AS n FROM r WHERE v IS NOT NULL AND err IS NOT NULL GROUP BY sensor")
def l2_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).filter("v is not null and err is not null")
    return r.groupBy("sensor").agg(r6(F.sum(F.col("v") * F.col("err")), 1e4).alias("dot"), r6(F.max(F.abs("v"))).alias("max_abs"), r6(F.avg(F.abs("v"))).alias("mean_abs"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, floor(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) * 100 + 0.37) / 100 AS eta, floor(sum(l_discount * l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) * 1e4 + 0.37) / 1e4 AS p FROM lineitem""")
def layer_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface height as the cumulated thickness from below, pressure as the cumulated weight from above; lines of an order are its layers."""
    up, down = W.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber")), W.partitionBy("l_orderkey").orderBy("l_linenumber")
    eta, p = F.sum("l_quantity").over(up).cast("double"), F.sum(F.col("l_discount") * F.col("l_quantity")).over(down).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.floor(eta * 100 + 0.37) / 100).alias("eta"), (F.floor(p * 1e4 + 0.37) / 1e4).alias("p"))


@query(f"{R_SQL} SELECT obs_class, {q6('min(lat)')} AS lat_min, {q6('max(lat)')} AS lat_max, {q6('min(lon)')} AS lon_min, {q6('max(lon)')} AS lon_max, {q6('avg(lat)', '1e4')} AS lat_mean, count(*) AS n FROM r GROUP BY obs_class")
def scalar_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return r.groupBy("obs_class").agg(r6(F.min("lat")).alias("lat_min"), r6(F.max("lat")).alias("lat_max"), r6(F.min("lon")).alias("lon_min"), r6(F.max("lon")).alias("lon_max"), r6(F.avg("lat"), 1e4).alias("lat_mean"), F.count("*").alias("n"))


GAP_S, NPT, STRIDE = 30.0, 16, 4
_S = f"""{R_SQL}, k AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY sensor ORDER BY ts, obs_id) > {GAP_S} THEN 1 ELSE 0 END AS nw FROM r WHERE abs(v) < 5),
sg AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY sensor ORDER BY ts, obs_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM k),
sp AS (SELECT *, row_number() OVER (PARTITION BY sensor, seg ORDER BY ts, obs_id) - 1 AS pos FROM sg)"""


def _segments(r: DataFrame) -> DataFrame:
    r = r.filter(F.abs("v") < 5).select("obs_id", "sensor", "ts", "lat", "lon", "v")
    return segments.sessions(r, "sensor", "ts", "obs_id", GAP_S)


@query(f"{_S} SELECT sensor, seg, count(*) AS n, {q6('min(ts)', '1e3')} AS start, {q6('max(ts)', '1e3')} AS stop FROM sp GROUP BY sensor, seg")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(readings(spark, sf_dir)).groupBy("sensor", "seg").agg(F.count("*").alias("n"), r6(F.min("ts"), 1e3).alias("start"), r6(F.max("ts"), 1e3).alias("stop"))


@query(f"{_S} SELECT sensor, seg, count(*) AS n FROM sp GROUP BY sensor, seg HAVING count(*) >= {NPT}")
def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(readings(spark, sf_dir)).groupBy("sensor", "seg").agg(F.count("*").alias("n")).filter(F.col("n") >= NPT)


_STEP = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"


@query(f"""{_S}, st AS (SELECT b.sensor, b.seg, b.obs_id, b.pos, {_STEP} AS d FROM sp a JOIN sp b ON a.sensor = b.sensor AND a.seg = b.seg AND b.pos = a.pos + 1)
SELECT sensor, seg, obs_id, {q6('d', '1e4')} AS step_km, {q6('sum(d) OVER (PARTITION BY sensor, seg ORDER BY pos)', '1e3')} AS run_km FROM st""")
def running_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the point before, and along the segment so far."""
    s = segments.distances(_segments(readings(spark, sf_dir)), "sensor", great_circle_km)
    return s.filter("pos > 0").select("sensor", "seg", "obs_id", r6("d", 1e4).alias("step_km"), r6("run", 1e3).alias("run_km"))


@query(f"""{_S} SELECT sensor, {q6('median(d)', '1e3')} AS spacing_km, count(*) AS n FROM (SELECT b.sensor, {_STEP} AS d FROM sp a JOIN sp b ON a.sensor = b.sensor AND a.seg = b.seg AND b.pos = a.pos + 1) GROUP BY sensor""")
def median_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median of the distances between consecutive points."""
    d = segments.distances(_segments(readings(spark, sf_dir)), "sensor", great_circle_km).filter("d is not null")
    d = materialize(d.select("sensor", "d"), "spacing")
    n = d.groupBy("sensor").agg(F.count("*").alias("n"))
    return stats.exact_median(d, ["sensor"], "d", 0.1).join(n, "sensor").select("sensor", r6("median", 1e3).alias("spacing_km"), "n")


_SUB = f"""{_S}, sl AS (SELECT sensor, seg FROM sp GROUP BY sensor, seg HAVING count(*) >= {NPT}),
su AS (SELECT sensor, seg, sub, count(*) AS n FROM (SELECT sensor, seg, pos, unnest(generate_series(CAST(greatest(ceil((pos - {NPT} + 1) / {STRIDE}.0), 0) AS BIGINT), CAST(floor(pos / {STRIDE}.0) AS BIGINT))) AS sub FROM sp JOIN sl USING (sensor, seg)) GROUP BY ALL HAVING count(*) = {NPT}),
sb AS (SELECT su.sensor, su.seg, sub, pos - sub * {STRIDE} AS x, lat, lon, v FROM su JOIN sp ON sp.sensor = su.sensor AND sp.seg = su.seg AND pos BETWEEN sub * {STRIDE} AND sub * {STRIDE} + {NPT - 1})"""


def _subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(readings(spark, sf_dir))
    long = s.groupBy("sensor", "seg").agg(F.count("*").alias("n")).filter(F.col("n") >= NPT).drop("n")
    return segments.sub_segments(s.join(long, ["sensor", "seg"]), ["sensor", "seg"], NPT, STRIDE, ["lat", "lon", "v"])


def _mid(a: str) -> F.Column:
    s = F.array_sort(a)
    return (s[NPT // 2 - 1] + s[NPT // 2]) / 2


@query(f"{_SUB} SELECT sensor, seg, sub, {q6('median(lat)')} AS lat, {q6('CASE WHEN min(lon) < 50 AND max(lon) > 320 THEN median((lon + 180) % 360) - 180 ELSE median(lon) END')} AS lon FROM sb GROUP BY sensor, seg, sub")
def sub_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping sub-segments of 16 points every 4 points, with their middle; longitudes that straddle the zero meridian are unwrapped."""
    s = _subs(spark, sf_dir)
    split = (F.array_min("lon") < 50) & (F.array_max("lon") > 320)
    s = s.withColumn("turned", F.transform("lon", lambda x: F.pmod(x + 180, F.lit(360.0))))
    return s.select("sensor", "seg", "sub", r6(_mid("lat")).alias("lat"), r6(F.when(split, _mid("turned") - 180).otherwise(_mid("lon"))).alias("lon"))


DX = 6.0
_PSD = f"""{_SUB}, md AS (SELECT sensor, seg, sub, avg(v) AS m FROM sb GROUP BY sensor, seg, sub), ks AS (SELECT unnest(generate_series(0, {NPT // 2})) AS k),
dft AS (SELECT sensor, seg, sub, k, sum((v - m) * 0.5 * (1 - cos(2 * pi() * x / {NPT})) * cos(2 * pi() * k * x / {NPT})) AS re, sum((v - m) * 0.5 * (1 - cos(2 * pi() * x / {NPT})) * sin(2 * pi() * k * x / {NPT})) AS im FROM sb JOIN md USING (sensor, seg, sub), ks GROUP BY ALL),
ps AS (SELECT sensor, seg, sub, k, (re * re + im * im) * {DX} / {NPT * 3 / 8} * CASE WHEN k = 0 OR k = {NPT // 2} THEN 1 ELSE 2 END AS p FROM dft)"""


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = segments.welch(_subs(spark, sf_dir), {"sensor": "string", "seg": "long", "sub": "long"}, ["v"], DX)
    return p.select("sensor", "seg", "sub", F.posexplode("v").alias("k", "p"))


@query(f"{_PSD} SELECT sensor, k, {q6('avg(p)')} AS psd, count(*) AS n FROM ps GROUP BY sensor, k")
def welch_psd_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean power spectral density by sensor and wavenumber."""
    return _spectra(spark, sf_dir).groupBy("sensor", F.col("k").cast("long").alias("k")).agg(r6(F.avg("p")).alias("psd"), F.count("*").alias("n"))


@query(f"""{_PSD}, pc AS (SELECT CASE WHEN sensor IN (SELECT sensor FROM sensor WHERE obs_class = 'OBS_SSH_SWATH') THEN 'noise' ELSE 'signal' END AS kind, k, p FROM ps),
pm AS (SELECT k / ({NPT} * {DX}) AS f, 1 - avg(p) FILTER (kind = 'noise') / (avg(p) FILTER (kind = 'noise') + avg(p) FILTER (kind = 'signal')) AS score FROM pc GROUP BY k),
cr AS (SELECT score, 1 / f AS wl, lag(score) OVER (ORDER BY f) AS s0, lag(1 / f) OVER (ORDER BY f) AS w0 FROM pm WHERE f > 0)
SELECT {q6('w0 + (0.5 - s0) / (score - s0) * (wl - w0)', '1e4')} AS wavelength FROM cr WHERE s0 IS NOT NULL AND (s0 - 0.5) * (score - 0.5) <= 0 AND s0 <> score""")
def resolved_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the swath sensors' spectrum has half of the sum of both classes' spectra."""
    swath = table(spark, sf_dir, "sensor").filter("obs_class = 'OBS_SSH_SWATH'").select("sensor", F.lit(True).alias("swath"))
    s = _spectra(spark, sf_dir).join(swath, "sensor", "left")
    m = s.groupBy((F.col("k") / (NPT * DX)).alias("f")).agg(F.avg(F.when(F.col("swath"), F.col("p"))).alias("noise"), F.avg(F.when(F.col("swath").isNull(), F.col("p"))).alias("alone"))
    m = m.withColumn("signal", F.col("noise") + F.col("alone"))
    return segments.resolved_scale(m, "f", "noise", "signal").select(r6("wavelength", 1e4).alias("wavelength"))


@query(f"{R_SQL} SELECT obs_id, CAST((SELECT max(d) FROM (SELECT unnest(generate_series(1, 3600)) AS d) WHERE 3600 % d = 0 AND d <= 0.5 * 10000 / (1 + 100 * abs(v))) AS INTEGER) AS dt FROM r WHERE abs(v) < 5")
def cfl_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest time step on a 10 km grid for a speed that grows with the anomaly."""
    r = readings(spark, sf_dir).filter(F.abs("v") < 5)
    return r.select("obs_id", stats.cfl_step(1 + 100 * F.abs("v"), F.lit(10000.0), 0.5).cast("int").alias("dt"))
