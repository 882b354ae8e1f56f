"""Queries of the numbered problems of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import compaction, proximity, regrid, spikes, units
from tidemill.operators.readings import distinct_readings, usable, with_known_time
from tidemill.plans.base import DIAG_SQL, LON_SQL, q6, r6
from tidemill.sources.tables import new_folder, table

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    r = units.observation_longitudes(t("obs"), t("dict_obs"), "sensor", "name_time", "name_lat", "name_var")
    r = with_known_time(usable(r), t("sensor"))
    lat = F.when(F.col("name_lat").between(-90, 90), F.col("name_lat"))
    return regrid.regular_series(r.select("sensor", "name_time", "name_var", lat.alias("lat"), F.col("lon_east").alias("lon")), largest=100.0)


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods whose own readings' effective support is too small, which is where there are none."""
    return _series(spark, sf_dir).filter("missing").select("sensor", "period_no")


@query
def p1_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series of every sensor: value and position where there are readings, marks where there are none or too few."""
    out = _series(spark, sf_dir)
    return out.withColumns({c: r6(c, 1e4) for c in ("support", "own_support", "value", "lat", "lon", "filled")})


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    r = with_known_time(units.observation_longitudes(t("obs"), t("dict_obs"), "sensor", "name_time", "name_lat"), t("sensor"))
    return r.select(F.col("obs_id").alias("id"), F.col("sensor").alias("source"), F.col("name_time").alias("time"), F.col("name_lat").alias("lat"), F.col("lon_east").alias("lon"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.near_pairs(_points(spark, sf_dir)).select(F.col("id_a").alias("obs_id_a"), F.col("id_b").alias("obs_id_b"))


@query
def p2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by sensor within each box that the manifest's paths name."""
    box = F.regexp_extract("obs_path", r"obs_(-?[0-9]+_-?[0-9]+_-?[0-9]+_-?[0-9]+)_", 1)
    boxes = table(spark, sf_dir, "dict_obs").select(box.alias("region")).filter("region <> ''").distinct()
    e = F.split("region", "_")
    corner = lambda x, y: F.struct(e[x].cast("double").alias("lon"), e[y].cast("double").alias("lat"))
    regions = boxes.withColumn("ring", F.array(corner(0, 2), corner(1, 2), corner(1, 3), corner(0, 3)))
    points = _points(spark, sf_dir)
    inside = proximity.containing_regions(points.withColumn("id", F.struct("id", "source")), regions)
    return inside.groupBy("region", F.col("id.source").alias("sensor")).agg(F.count("*").alias("n"))


def _implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    sensor = t("sensor")
    limit = sensor.groupBy("sensor").agg(F.min(F.when(~F.isnan("varmax"), F.abs("varmax"))).alias("high"))
    obs = with_known_time(distinct_readings(t("obs"), "obs_id", "sensor", "name_time", "name_var"), sensor, keep_unknown=True).join(limit, "sensor", "left")
    obs = obs.select(F.concat(F.lit("obs:"), "sensor").alias("source"), F.col("obs_id").alias("rec_id"), F.col("name_time").alias("time"), F.col("name_var").alias("value"), (-F.col("high")).alias("low"), "high")
    bc = distinct_readings(t("bc"), "bc_id", "node_id", "var_name", "name_time", "var")
    sst = F.col("var_name") == "sst"
    # sea water freezes near -2 and no sea is hotter than 45 degrees Celsius; sea level stays within 50 m
    bc = bc.select(F.concat(F.lit("bc:"), "node_id").alias("source"), F.col("bc_id").alias("rec_id"), F.col("name_time").alias("time"), F.col("var").alias("value"), F.when(sst, -5.0).otherwise(-50.0).alias("low"), F.when(sst, 45.0).otherwise(50.0).alias("high"))
    return spikes.implausible(obs.unionByName(bc))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _implausible(spark, sf_dir).select(F.split("source", ":")[0].alias("tab"), "rec_id")


@query
def p3_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged readings of each source by kind."""
    return _implausible(spark, sf_dir).groupBy("source").agg(*[F.count_if(c).alias(f"n_{c}") for c in ("spike", "stuck", "impossible")])


def _compact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The journal of a compaction of the whole table into a new store of the shared folder, and the store's path."""
    out = new_folder(spark, "compacted")
    return compaction.compact(spark, table(spark, sf_dir, "obs"), table(spark, sf_dir, "dict_obs"), out), out


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the compaction's journal drops, as they add no reading."""
    return _compact(spark, sf_dir)[0].filter("action = 'drop'").select("file_id")


@query
def p4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the journal says of each entry: taken or dropped, and the readings it adds."""
    return _compact(spark, sf_dir)[0].filter("level = 0").select("file_id", "action", "n_rows")


@query
def p4_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal's transactions: level, action, txn_id, output, inputs and rows."""
    journal = _compact(spark, sf_dir)[0]
    return journal.groupBy("level", "action", "txn_id").agg(F.max("output_id").alias("output_id"), F.count("*").alias("n_inputs"), F.sum("n_rows").alias("n_rows"))


@query
def p4_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of the whole table rewritten into few files, read back through the journal: rows and readings by sensor."""
    back = compaction.compacted(spark, _compact(spark, sf_dir)[1])
    return back.groupBy("sensor").agg(F.count("*").alias("n_rows"), F.countDistinct("obs_id").alias("n_readings"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    all_ = units.converted_records(t("obs"), t("dict_obs"), t("diag_ref"), t("diag_bas"))
    return all_.filter(~F.coalesce("bare_east", F.lit(False))).select("tab", "rec_id", F.floor("lon_east").cast("int").alias("lon_deg"))


@query
def p5_longitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a longitude in degrees east, to a hundred-thousandth."""
    t = lambda n: table(spark, sf_dir, n)
    all_ = units.converted_records(t("obs"), t("dict_obs"), t("diag_ref"), t("diag_bas"))
    return all_.select("tab", "rec_id", r6("lon_east", 1e5).alias("lon_east"))


@query
def p5_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary values in base units (kelvin, metres); the unit is the variable's own."""
    b = distinct_readings(table(spark, sf_dir, "bc"), "bc_id", "var_name", "var")
    sst = units.convert(b.filter("var_name = 'sst'"), "temperature", "var", default="degrees Celsius")
    ssh = units.convert(b.filter("var_name = 'ssh'"), "length", "var", default="m")
    return sst.unionByName(ssh).filter("base is not null").select("bc_id", "var_name", r6("base", 1e3).alias("base"))


@query
def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and converted records by table and 10-degree band."""
    t = lambda n: table(spark, sf_dir, n)
    all_ = units.converted_records(t("obs"), t("dict_obs"), t("diag_ref"), t("diag_bas"))
    band = (F.floor(F.col("lon_east") / 10) * 10).cast("int").alias("band")
    return all_.groupBy("tab", band).agg(F.count("*").alias("n"), F.count_if(~F.coalesce("bare_east", F.lit(False))).alias("n_converted"))


_OWN = "WITH own AS (SELECT obs_id, min(file_id) AS file_id FROM obs WHERE obs_id IS NOT NULL AND file_id IS NOT NULL GROUP BY obs_id)"

SQL["p4_found"] = f"{_OWN} SELECT DISTINCT d.file_id FROM dict_obs d WHERE d.file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own o WHERE o.file_id = d.file_id)"

SQL["p4_entries"] = f"""{_OWN}, k AS (SELECT file_id, count(*) AS n FROM own GROUP BY file_id), d AS (SELECT DISTINCT file_id FROM dict_obs WHERE file_id IS NOT NULL)
SELECT coalesce(d.file_id, k.file_id) AS file_id, CASE WHEN n > 0 THEN 'take' ELSE 'drop' END AS action, coalesce(n, 0) AS n_rows FROM d FULL JOIN k ON d.file_id = k.file_id"""

SQL["p4_compacted"] = "SELECT sensor, count(DISTINCT obs_id) AS n_rows, count(DISTINCT obs_id) AS n_readings FROM obs WHERE obs_id IS NOT NULL AND file_id IS NOT NULL GROUP BY sensor"

SQL["p1_found"] = """
WITH r AS (SELECT DISTINCT ON (obs_id) obs_id, o.sensor, name_time FROM obs o JOIN sensor s ON s.sensor = o.sensor
           WHERE obs_id IS NOT NULL AND name_var IS NOT NULL AND NOT isnan(name_var) AND name_time BETWEEN begin_time AND end_time),
p AS (SELECT DISTINCT sensor, CAST(floor(epoch_us(name_time) / 1e6 / 10800) AS BIGINT) AS period_no FROM r),
g AS (SELECT sensor, unnest(generate_series(min(period_no), max(period_no))) AS period_no FROM p GROUP BY sensor)
SELECT sensor, period_no FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.sensor = g.sensor AND p.period_no = g.period_no)
"""

_FIT = "coalesce(CASE WHEN {w}0 * {w}2 - {w}1 * {w}1 > 1e-4 * {w}0 * {w}0 THEN ({w}2 * {y}0 - {w}1 * {y}1) / ({w}0 * {w}2 - {w}1 * {w}1) END, CASE WHEN {w}0 > 0 THEN {y}0 / {w}0 END)"
_SUMS = ", ".join(
    [f"sum({w} * pow(u, {k})) AS {p}{k}" for p, w in (("vw", "wv"), ("pw", "wp")) for k in range(3)]
    + [f"sum({w} * {y}) AS {p}0, sum({w} * u * {y}) AS {p}1" for p, y, w in (("v", "name_var", "wv"), ("x", "px", "wp"), ("y", "py", "wp"), ("z", "pz", "wp"))]
)
_fit = lambda y: _FIT.format(w="vw" if y == "v" else "pw", y=y)

SQL["p1_series"] = f"""
WITH {LON_SQL},
r AS (SELECT o.sensor, epoch_us(o.name_time) / 1e6 AS t, name_var, CASE WHEN name_lat BETWEEN -90 AND 90 THEN radians(name_lat) END AS la, radians(lon_east) AS lo
      FROM (SELECT DISTINCT ON (obs_id) * FROM obs WHERE obs_id IS NOT NULL) o JOIN sensor s ON s.sensor = o.sensor JOIN lon ON lon.obs_id = o.obs_id
      WHERE name_var IS NOT NULL AND NOT isnan(name_var) AND o.name_time BETWEEN begin_time AND end_time),
k AS (SELECT *, cos(la) * cos(lo) AS px, cos(la) * sin(lo) AS py, CASE WHEN lo IS NOT NULL THEN sin(la) END AS pz, CAST(floor(t / 10800) AS BIGINT) AS own FROM r),
e AS (SELECT *, (t - (period_no + 0.5) * 10800) / 16200 AS u FROM (SELECT *, unnest([own - 1, own, own + 1]) AS period_no FROM k)),
w AS (SELECT *, pow(1 - pow(abs(u), 3), 3) AS w FROM e WHERE abs(u) < 1),
f AS (SELECT *, CASE WHEN abs(name_var) <= 100 THEN w END AS wv, CASE WHEN px IS NOT NULL THEN w END AS wp, CASE WHEN own = period_no THEN w END AS wo FROM w),
m AS (SELECT sensor, period_no, {_SUMS}, sum(wv * wv) AS ww, sum(wo) AS ow, sum(wo * wo) AS oww, count(wo) AS n FROM f GROUP BY sensor, period_no),
g AS (SELECT sensor, unnest(generate_series(min(period_no), max(period_no))) AS period_no FROM m WHERE ow > 0 GROUP BY sensor),
s AS (SELECT *, coalesce(CASE WHEN ww > 0 THEN vw0 * vw0 / ww END, 0.0) AS support, coalesce(CASE WHEN oww > 0 THEN ow * ow / oww END, 0.0) AS own_support FROM g LEFT JOIN m USING (sensor, period_no)),
b AS (SELECT *, own_support < 1 - 1e-9 AS missing, support < 1 - 1e-9 AS insufficient, {_fit("v")} AS fv, {_fit("x")} AS fx, {_fit("y")} AS fy, {_fit("z")} AS fz FROM s)
SELECT sensor, period_no, coalesce(n, 0) AS n_readings, {q6("support", "1e4")} AS support, {q6("own_support", "1e4")} AS own_support, missing, insufficient,
       {q6("CASE WHEN NOT missing AND NOT insufficient THEN fv END", "1e4")} AS value, {q6("CASE WHEN NOT missing THEN degrees(atan2(fz, sqrt(fx * fx + fy * fy))) END", "1e4")} AS lat,
       {q6("CASE WHEN NOT missing THEN degrees(atan2(fy, fx)) - 360 * floor(degrees(atan2(fy, fx)) / 360) END", "1e4")} AS lon, {q6("CASE WHEN missing AND NOT insufficient THEN fv END", "1e4")} AS filled FROM b
"""

SQL["p2_regions"] = f"""
WITH {LON_SQL}, x AS (SELECT DISTINCT regexp_extract(obs_path, 'obs_(-?[0-9]+_-?[0-9]+_-?[0-9]+_-?[0-9]+)_', 1) AS region FROM dict_obs),
b AS (SELECT region, CAST(c[1] AS DOUBLE) AS lon0, CAST(c[2] AS DOUBLE) AS lon1, CAST(c[3] AS DOUBLE) AS lat0, CAST(c[4] AS DOUBLE) AS lat1 FROM (SELECT region, string_split(region, '_') AS c FROM x WHERE region <> '')),
p AS (SELECT o.sensor, o.name_lat AS lat, lon_east AS lon FROM (SELECT DISTINCT ON (obs_id) * FROM obs WHERE obs_id IS NOT NULL) o JOIN sensor s ON s.sensor = o.sensor JOIN lon ON lon.obs_id = o.obs_id
      WHERE o.name_time BETWEEN begin_time AND end_time AND o.name_lat BETWEEN -90 AND 90 AND lon_east IS NOT NULL)
SELECT region, sensor, count(*) AS n FROM b, p WHERE lat >= lat0 AND lat < lat1 AND (lon >= lon0 AND lon < lon1 OR lon - 360 >= lon0 AND lon - 360 < lon1 OR lon + 360 >= lon0 AND lon + 360 < lon1) GROUP BY region, sensor
"""

SQL["p5_boundary"] = f"""SELECT bc_id, var_name, {q6("CASE var_name WHEN 'sst' THEN var + 273.15 ELSE var END", "1e3")} AS base FROM (SELECT DISTINCT ON (bc_id) * FROM bc WHERE bc_id IS NOT NULL)
WHERE NOT isnan(var) AND abs(var) <= CASE var_name WHEN 'sst' THEN 1000 WHEN 'ssh' THEN 1e9 END"""

SQL["p2_found"] = f"""
WITH {LON_SQL},
p AS (SELECT o.obs_id, o.sensor, epoch_us(o.name_time) / 1e6 AS t, o.name_lat AS lat, lon.lon_east AS lon
      FROM (SELECT DISTINCT ON (obs_id) * FROM obs WHERE obs_id IS NOT NULL) o JOIN sensor s ON s.sensor = o.sensor JOIN lon ON lon.obs_id = o.obs_id
      WHERE o.name_time BETWEEN s.begin_time AND s.end_time AND o.name_lat BETWEEN -90 AND 90 AND lon.lon_east IS NOT NULL),
a AS (SELECT *, floor(t / 1800) AS tb, floor(lat / 0.05) AS lb FROM p),
b AS (SELECT obs_id, sensor, t, lat, lon, floor(t / 1800) + dt AS tb, floor(lat / 0.05) + dl AS lb FROM p, (VALUES (-1), (0), (1)) x(dt), (VALUES (-1), (0), (1)) y(dl))
SELECT a.obs_id AS obs_id_a, b.obs_id AS obs_id_b FROM a JOIN b ON a.tb = b.tb AND a.lb = b.lb
WHERE a.obs_id < b.obs_id AND a.sensor <> b.sensor AND abs(a.t - b.t) <= 1800
  AND 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 5
"""

# 'bad' is the physical limit: varmax of the sensor; sea level within 50 m and water of -5 to 45 degrees
_P3 = """
WITH lim AS (SELECT sensor, min(begin_time) AS b, max(end_time) AS e, min(abs(varmax)) FILTER (NOT isnan(varmax)) AS high FROM sensor GROUP BY sensor),
r AS (SELECT 'obs' AS tab, 'obs:' || o.sensor AS source, obs_id AS rec_id, CASE WHEN name_time BETWEEN b AND e THEN name_time END AS t, name_var AS v, coalesce(abs(name_var) > high, false) OR abs(name_var) >= 1e15 AS bad
      FROM (SELECT DISTINCT ON (obs_id) * FROM obs WHERE obs_id IS NOT NULL) o LEFT JOIN lim ON lim.sensor = o.sensor WHERE o.sensor IS NOT NULL AND name_var IS NOT NULL AND NOT isnan(name_var)
      UNION ALL SELECT 'bc', 'bc:' || node_id, bc_id, name_time, var, CASE WHEN var_name = 'sst' THEN var NOT BETWEEN -5 AND 45 ELSE abs(var) > 50 END
      FROM (SELECT DISTINCT ON (bc_id) * FROM bc WHERE bc_id IS NOT NULL) WHERE node_id IS NOT NULL AND var IS NOT NULL AND NOT isnan(var)),
q AS (SELECT source, median(v) AS m, greatest((quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349, (quantile_cont(v, 0.9) - quantile_cont(v, 0.1)) / 5.126) AS s FROM r WHERE NOT bad GROUP BY source),
g AS (SELECT source, avg(v) AS m, stddev_pop(v) AS s FROM r JOIN q USING (source) WHERE NOT bad AND abs(v - q.m) <= 8 * q.s GROUP BY source),
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, rec_id) - row_number() OVER (PARTITION BY source, v ORDER BY t, rec_id) AS run FROM r WHERE t IS NOT NULL),
n AS (SELECT tab, rec_id, count(*) OVER (PARTITION BY source, v, run) AS n FROM w),
f AS (SELECT tab, r.source, rec_id, coalesce(abs(v - m) > 8 * s, false) AS spike, coalesce(n >= 6, false) AS stuck, bad FROM r LEFT JOIN g USING (source) LEFT JOIN n USING (tab, rec_id))"""
SQL["p3_found"] = f"{_P3} SELECT tab, rec_id FROM f WHERE spike OR stuck OR bad"
SQL["p3_by_source"] = f"{_P3} SELECT source, count(*) FILTER (spike) AS n_spike, count(*) FILTER (stuck) AS n_stuck, count(*) FILTER (bad) AS n_impossible FROM f WHERE spike OR stuck OR bad GROUP BY source"

_P5 = f"""WITH {LON_SQL}, {DIAG_SQL},
c AS (SELECT 'obs' AS tab, obs_id AS rec_id, lon_east, bare_east FROM lon UNION ALL SELECT 'diag_ref', ref_id, lon_east, bare_east FROM dr UNION ALL SELECT 'diag_bas', bas_id, lon_east, bare_east FROM db)"""

SQL["p5_found"] = f"{_P5} SELECT tab, rec_id, CAST(floor(lon_east) AS INTEGER) AS lon_deg FROM c WHERE lon_east IS NOT NULL AND NOT coalesce(bare_east, false)"
SQL["p5_profile"] = f"{_P5} SELECT tab, CAST(floor(lon_east / 10) * 10 AS INTEGER) AS band, count(*) AS n, count(*) FILTER (NOT coalesce(bare_east, false)) AS n_converted FROM c WHERE lon_east IS NOT NULL GROUP BY ALL"
SQL["p5_longitudes"] = f"{_P5} SELECT tab, rec_id, {q6('lon_east', '1e5')} AS lon_east FROM c WHERE lon_east IS NOT NULL"
