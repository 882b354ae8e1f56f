"""Scans, projections, filters and row transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import scalars
from tidemill.operators import rowops, windows
from tidemill.plans.base import B_SQL, LON_SQL, R_SQL, Registry, nodes, q6, r6, readings
from tidemill.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"{R_SQL} SELECT obs_id, sensor, t AS time, {q6('lon')} AS lon, {q6('lat')} AS lat, {q6('v')} AS var FROM r")
def scan_project_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowops.rename_roles(readings(spark, sf_dir).withColumns({c: r6(c) for c in ("lon", "lat", "v")}), {"t": "time", "lon": "lon", "lat": "lat", "v": "var"}, keep=["obs_id", "sensor"])


@query(f"{R_SQL} SELECT obs_id, {q6('v - err')} AS combined FROM r")
def combine_signed_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("obs_id", r6(rowops.signed_sum({"v": 1, "err": -1})).alias("combined"))


@query(f"{R_SQL} SELECT obs_id, sensor, v IS NULL AS nulled, {q6('v')} AS v FROM r")
def null_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("obs_id", "sensor", F.isnull("v").alias("nulled"), r6("v").alias("v"))


@query(f"""{R_SQL}, x AS (SELECT min(lon) AS lo, max(lon) AS hi FROM r)
SELECT obs_id, {q6('CASE WHEN lo >= 0 OR hi > 180 THEN lon + 180 - 360 * floor((lon + 180) / 360) - 180 ELSE lon END')} AS lon FROM r, x""")
def lon_wrap_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowops.wrap_longitude(readings(spark, sf_dir).select("obs_id", "lon"), "lon", "-180..180").withColumn("lon", r6("lon"))


@query(f"""WITH {B_SQL}, m AS (SELECT bc_id, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon FROM b), x AS (SELECT min(lon) AS lo FROM m)
SELECT bc_id, {q6('CASE WHEN lo < 0 THEN lon - 360 * floor(lon / 360) ELSE lon END')} AS lon FROM m, x""")
def lon_wrap_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = nodes(spark, sf_dir).select("bc_id", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")).alias("lon"))
    return rowops.wrap_longitude(signed, "lon", "0..360").withColumn("lon", r6("lon"))


@query(f"""WITH {LON_SQL}
SELECT 'obs' AS tab, count(*) AS n, CAST(sum(CASE WHEN bare_east THEN 0 ELSE 1 END) AS BIGINT) AS n_converted, sum(floor(lon_east)) AS sum_deg FROM lon WHERE lon_east IS NOT NULL""")
def unit_conversion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators import units

    lon = units.observation_longitudes(table(spark, sf_dir, "obs"), table(spark, sf_dir, "dict_obs")).filter("lon_east is not null")
    return lon.agg(F.count("*").alias("n"), F.sum(F.when(F.col("bare_east"), 0).otherwise(1)).alias("n_converted"), F.sum(F.floor("lon_east").cast("double")).alias("sum_deg")).select(F.lit("obs").alias("tab"), "*")


_BOX = "lon BETWEEN 195.0 AND 225.0 AND lat BETWEEN -50.0 AND -20.0 AND t BETWEEN TIMESTAMP '1993-01-02 00:00:00' AND TIMESTAMP '1993-01-15 00:00:00'"


@query(f"{R_SQL} SELECT obs_id, sensor, t FROM r WHERE {_BOX}")
def bbox_time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rowops.box(readings(spark, sf_dir), lon=(200, 220), lat=(-45, -25), pad=5, start="1993-01-02", end="1993-01-15")
    return r.select("obs_id", "sensor", "t")


@query(f"{R_SQL} SELECT sensor, count(*) AS n FROM r WHERE sensor IN (SELECT sensor FROM sensor WHERE obs_class = 'OBS_SSH_SWATH') GROUP BY sensor")
def sensor_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "sensor").filter("obs_class = 'OBS_SSH_SWATH'").select("sensor")
    return readings(spark, sf_dir).join(wanted, "sensor", "left_semi").groupBy("sensor").agg(F.count("*").alias("n"))


@query(f"WITH {B_SQL} SELECT node_id, count(*) AS n, count(v) AS n_given FROM b WHERE node_id NOT IN (SELECT node_id FROM b GROUP BY node_id HAVING count(v) = 0) GROUP BY node_id")
def land_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = nodes(spark, sf_dir)
    land = b.groupBy("node_id").agg(F.count("v").alias("n")).filter("n = 0")
    return b.join(land, "node_id", "left_anti").groupBy("node_id").agg(F.count("*").alias("n"), F.count("v").alias("n_given"))


@query(f"{R_SQL} SELECT make_timestamp(CAST(floor((ts + 10800) / 21600) * 21600000000 AS BIGINT)) AS window_ts, sensor, count(*) AS n, count(v) AS n_given FROM r GROUP BY ALL")
def obs_window_halfopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.assign_windows(readings(spark, sf_dir), 21600)
    return r.groupBy("window_ts", "sensor").agg(F.count("*").alias("n"), F.count("v").alias("n_given"))


@query(f"""{R_SQL}, k AS (SELECT obs_id, ts, unnest([ceil((ts - 10800) / 21600), ceil((ts - 10800) / 21600) + 1]) AS w FROM r)
SELECT CAST(w AS BIGINT) AS window_no, count(*) AS n FROM k WHERE ts BETWEEN w * 21600 - 10800 AND w * 21600 + 10800 GROUP BY w""")
def obs_window_closed_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assign_windows_closed(readings(spark, sf_dir), 21600).groupBy("window_no").agg(F.count("*").alias("n"))


@query(f"{R_SQL} SELECT obs_id, {q6('coalesce(err, sigma, 1.0)')} AS err FROM r")
def obs_error_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("obs_id", r6(F.coalesce("err", "sigma", F.lit(1.0))).alias("err"))


@query(f"{R_SQL} SELECT obs_id, {q6('CASE WHEN bad THEN 0.0 ELSE v END')} AS v, CASE WHEN bad THEN 1e15 ELSE e END AS err FROM (SELECT *, v IS NULL OR e < 1e-7 OR v > 1e7 AS bad FROM (SELECT obs_id, v, coalesce(err, sigma, 1.0) AS e FROM r))")
def weight_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).withColumn("e", F.coalesce("err", "sigma", F.lit(1.0)))
    bad = F.isnull("v") | (F.col("e") < 1e-7) | (F.col("v") > 1e7)
    return r.select("obs_id", r6(F.when(bad, 0.0).otherwise(F.col("v"))).alias("v"), F.when(bad, 1e15).otherwise(F.col("e")).alias("err"))


_BM = """, n AS (SELECT *, floor((row_number() OVER (PARTITION BY sensor, floor(ts / 10800) ORDER BY ts, obs_id) - 1) / 4) AS blk, CAST(floor(ts / 10800) AS BIGINT) AS w FROM r)"""


@query(f"{R_SQL}{_BM} SELECT sensor, w AS window_no, CAST(blk AS BIGINT) AS block_no, {q6('avg(v)')} AS v, {q6('avg(lat)')} AS lat FROM n GROUP BY sensor, w, blk HAVING count(*) = 4")
def block_mean_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).withColumn("window_no", F.floor(F.col("ts") / 10800))
    return rowops.block_mean(r, ["sensor", "window_no"], ["ts", "obs_id"], 4, ["v", "lat"]).withColumns({"v": r6("v"), "lat": r6("lat")})


@query(f"WITH {B_SQL}, k AS (SELECT *, dense_rank() OVER (PARTITION BY node_id ORDER BY ts) - 1 AS step FROM b) SELECT bc_id, node_id, step FROM k WHERE step % 4 = 0")
def stride_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowops.stride(nodes(spark, sf_dir), ["node_id"], "ts", 4).select("bc_id", "node_id", "step")


@query(f"""{R_SQL} SELECT CAST(date_trunc('day', t) AS TIMESTAMP) AS day, kind, count(*) AS n FROM (SELECT t, 'nadir' AS kind FROM r WHERE obs_class = 'OBS_SSH_NADIR' UNION ALL SELECT t, 'swath' FROM r WHERE obs_class = 'OBS_SSH_SWATH') GROUP BY ALL""")
def union_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    nadir = r.filter("obs_class = 'OBS_SSH_NADIR'").select("t", F.lit("nadir").alias("kind"))
    swath = r.filter("obs_class = 'OBS_SSH_SWATH'").select("t", F.lit("swath").alias("kind"))
    return nadir.unionByName(swath).groupBy(F.date_trunc("day", "t").cast("timestamp_ntz").alias("day"), "kind").agg(F.count("*").alias("n"))


@query("""SELECT window_ts, string_agg(obs_name || ':' || n, ',' ORDER BY obs_name) AS obs_names, CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(b) AS BIGINT) AS n_bytes
FROM (SELECT window_ts, obs_name, count(*) AS n, sum(n_bytes) AS b FROM dict_obs GROUP BY window_ts, obs_name) GROUP BY window_ts""")
def obs_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window, the list of its sensors: files are counted first, so that a window's list has one entry for each sensor."""
    per = table(spark, sf_dir, "dict_obs").groupBy("window_ts", "obs_name").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    names = F.sort_array(F.collect_list(F.struct("obs_name", F.concat("obs_name", F.lit(":"), "n").alias("s"))))
    return per.groupBy("window_ts").agg(F.array_join(names["s"], ",").alias("obs_names"), F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"))


@query(f"{R_SQL} SELECT obs_id, {q6(scalars.SQL['ecef_x'], '1e3')} AS x, {q6(scalars.SQL['ecef_y'], '1e3')} AS y, {q6(scalars.SQL['ecef_z'], '1e3')} AS z FROM r")
def ecef_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = scalars.geo2cart(F.col("lon"), F.col("lat"))
    return readings(spark, sf_dir).select("obs_id", r6(x, 1e3).alias("x"), r6(y, 1e3).alias("y"), r6(z, 1e3).alias("z"))


@query(f"{R_SQL} SELECT obs_id, {q6(scalars.SQL['coriolis'], '1e12')} AS f, {q6(scalars.SQL['gaspari_cohn'].format(r='lat', c='40.0'))} AS gc, {q6('(40.0 - abs(lat)) / 40.0')} AS hat, {q6('pow(cos(pi() / 2 * lat / 90), 2)')} AS cos2, {q6('0.5 * (1 - cos(2 * pi() * lon / 360))')} AS hann, {q6(scalars.SQL['smoothstep'].format(x='least(greatest(abs(lat) / 60.0, 0), 1)'))} AS taper FROM r")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coriolis parameter, Gaspari-Cohn, hat, squared cosine, Hann and taper of every reading's position."""
    lat, lon = F.col("lat"), F.col("lon")
    return readings(spark, sf_dir).select(
        "obs_id",
        r6(scalars.coriolis(lat), 1e12).alias("f"),
        r6(scalars.gaspari_cohn(lat, 40.0)).alias("gc"),
        r6(scalars.hat(lat, 40.0)).alias("hat"),
        r6(scalars.cos2_window(lat / 90)).alias("cos2"),
        r6(scalars.hann(lon / 360)).alias("hann"),
        r6(scalars.smoothstep_taper(F.abs(lat), 60.0)).alias("taper"),
    )


@query(f"""{R_SQL}, k AS (SELECT obs_id, v * 20 AS u, err * 100 AS w FROM r WHERE v IS NOT NULL AND err IS NOT NULL),
s AS (SELECT *, sqrt(u * u + w * w) AS sp FROM k), c AS (SELECT *, CASE WHEN sp < 5 THEN 1.1e-3 WHEN sp < 25 THEN (0.49 + 0.065 * sp) * 1e-3 ELSE 2e-3 END AS cd FROM s)
SELECT obs_id, {q6('1.225 * cd * sp * u')} AS taux, {q6('1.225 * cd * sp * w')} AS tauy FROM c""")
def wind_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk stress of a wind made from each reading: 20 times its value eastward, 100 times its error northward."""
    r = readings(spark, sf_dir).filter("v is not null and err is not null")
    tx, ty = scalars.wind_stress(F.col("v") * 20, F.col("err") * 100)
    return r.select("obs_id", r6(tx).alias("taux"), r6(ty).alias("tauy"))
