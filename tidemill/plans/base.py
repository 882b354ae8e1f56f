"""What the mapping queries share: the readings as the reference's roles, the SQL of the same, and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import units
from tidemill.operators.readings import distinct_readings, with_known_time
from tidemill.operators.regrid import seconds
from tidemill.sources.tables import materialize, nan_to_null, once, table


class Registry:
    """Collects a module's queries, and their SQL where SQL can express them."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def r6(c: Column | str, scale: float = 1e6) -> Column:
    """Six decimals, cut off the same way by every engine and away from ties."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * scale + 0.3719) / scale


def q6(expr: str, scale: str = "1e6") -> str:
    """r6 in SQL."""
    return f"(floor(({expr}) * {scale} + 0.3719) / {scale})"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, sensor, obs_class, t, ts, lat, lon, xac, v, err, sigma: one row per reading with known time and position.

    v is null where it is not given or beyond varmax of its sensor (100 if that is not known): the row stays.
    """
    t = lambda n: table(spark, sf_dir, n)
    small = once(spark, ("lookups", sf_dir), lambda: units.lookups(t("obs"), t("dict_obs")))
    r = units.observation_longitudes(t("obs"), t("dict_obs"), "sensor", "name_time", "name_lat", "name_xac", "name_var", "name_err", small=small)
    r = with_known_time(r, t("sensor")).filter("name_lat between -90 and 90 and lon_east is not null")
    s = t("sensor").select("sensor", "obs_class", nan_to_null(F.col("sigma_noise")).alias("sigma"), F.coalesce(nan_to_null(F.col("varmax")), F.lit(100.0)).alias("most"))
    v = nan_to_null(F.col("name_var"))
    return r.join(s, "sensor").select(
        "obs_id",
        "sensor",
        "obs_class",
        F.col("name_time").alias("t"),
        seconds(F.col("name_time")).alias("ts"),
        F.col("name_lat").alias("lat"),
        F.col("lon_east").alias("lon"),
        nan_to_null(F.col("name_xac")).alias("xac"),
        F.when(F.abs(v) <= F.col("most"), v).alias("v"),
        nan_to_null(F.col("name_err")).alias("err"),
        "sigma",
    )


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``readings`` as a table, for queries that use it more than once: obs is scanned and reduced once."""
    return materialize(readings(spark, sf_dir), "readings")


_TOKEN = r"(millionths of a degree|scale_factor=1e-0?6|microdegrees?|1e-6|10\^-6|udeg|minutes of arc|min of arc|arc[_ ]minutes?|arcmin|radians?|rad|degrees?_east|degrees?_west|degrees?|deg)"


def _unit(s: str) -> str:
    tok = f"regexp_extract(lower(trim(coalesce({s}, ''))), '{_TOKEN}', 1)"
    return f"(CASE WHEN {tok} LIKE 'rad%' THEN 3 WHEN {tok} LIKE 'arc%' OR {tok} LIKE 'min%' THEN 2 WHEN {tok} LIKE 'deg%' THEN 1 WHEN {tok} <> '' THEN 4 WHEN regexp_matches(trim(coalesce({s}, '')), '^''|[0-9]\\s*''$') THEN 2 ELSE 0 END)"


def _west(s: str) -> str:
    return rf"""regexp_matches(replace(lower(coalesce({s}, '')), 'negative west', ''), '(west|deg ?w\b|[0-9°''"m ]w\s*$)')"""


def _deg(n: str, u: str, w: str) -> tuple[str, str]:
    """SQL of the converted longitude and of whether the number already is one, from number, unit code and direction."""
    most = f"(CASE {u} WHEN 1 THEN 360.0 WHEN 2 THEN 21600.0 WHEN 3 THEN 6.2832 ELSE 360e6 END * 1.0001)"
    factor = f"(CASE {u} WHEN 1 THEN 1.0 WHEN 2 THEN 1 / 60.0 WHEN 3 THEN 57.29577951308232 ELSE 1e-6 END)"
    fits, east = f"({u} > 0 AND abs({n}) <= {most})", f"(CASE WHEN {w} AND {u} = 0 THEN -{n} ELSE {n} END)"
    d = f"(CASE WHEN {fits} THEN (CASE WHEN {w} THEN -{n} ELSE {n} END) * {factor} WHEN abs({n}) <= 360 THEN {east} WHEN abs({n}) <= 360e6 * 1.0001 THEN {east} * 1e-6 END)"
    return f"(CASE WHEN {d} - 360 * floor({d} / 360) >= 360 THEN 0.0 ELSE {d} - 360 * floor({d} / 360) END)", f"(({u} <= 1 OR NOT {fits}) AND NOT {w} AND {n} >= 0 AND {n} < 360)"


def _both(a: str, b: str) -> str:
    """Unit code of a field and a text read together."""
    return f"(CASE WHEN {a} <= 1 AND {b} > 0 THEN {b} ELSE {a} END)"


_N = r"[0-9]+(?:[.,][0-9]+)?"
_SEX = rf"""^([+-]?{_N})(?:\s*[°d:]\s*({_N})?|\s+({_N}))\s*[''m:]?\s*({_N})?\s*"?\s*([ew])?$"""
_num = lambda g: f"coalesce(TRY_CAST(nullif(replace(regexp_extract(low, '{_SEX}', {g}), ',', '.'), '') AS DOUBLE), 0)"
# diag_ref and diag_bas: ref_id or bas_id, lon_east, bare_east
DIAG_SQL = rf"""
rx AS (SELECT ref_id, lower(trim(name_ref_lon)) AS low, lon_note FROM diag_ref WHERE ref_id IS NOT NULL AND regexp_matches(name_ref_lon, '[0-9]')),
ry AS (SELECT *, regexp_matches(low, '{_SEX}') AND regexp_matches(low, '[°d:]|[0-9]\s+[0-9]') AS sex FROM rx),
rz AS (SELECT ref_id, CASE WHEN sex THEN (CASE WHEN low LIKE '-%' THEN -1 ELSE 1 END) * (abs({_num(1)}) + ({_num(2)} + {_num(3)}) / 60 + {_num(4)} / 3600)
         ELSE TRY_CAST(replace(regexp_extract(low, '([+-]?[0-9]+(?:[.,][0-9]+)?(?:e[+-]?[0-9]+)?)', 1), ',', '.') AS DOUBLE) END AS n,
       {_both(f"(CASE WHEN sex THEN 1 ELSE {_unit("regexp_replace(low, '[0-9]e-?[0-9]+', '0')")} END)", _unit("lon_note"))} AS u, {_west("low")} OR {_west("lon_note")} AS w, regexp_matches(low, '^[+-]?[0-9]+(\.[0-9]+)?$') AS bare FROM ry),
dr AS (SELECT ref_id, max({_deg("n", "u", "w")[0]}) AS lon_east, bool_and(bare AND {_deg("n", "u", "w")[1]}) AS bare_east FROM rz GROUP BY ref_id),
bx AS (SELECT bas_id, CASE WHEN NOT isnan(name_bas_lon) THEN name_bas_lon END AS n, {_both(_unit("lon_unit"), _unit("lon_note"))} AS u, {_west("lon_unit")} OR {_west("lon_note")} AS w FROM diag_bas WHERE bas_id IS NOT NULL),
db AS (SELECT bas_id, max({_deg("n", "u", "w")[0]}) AS lon_east, bool_and({_deg("n", "u", "w")[1]}) AS bare_east FROM bx GROUP BY bas_id)"""

# the readings in SQL, as a prefix of WITH
LON_SQL = rf"""
mu AS (SELECT file_id, max({_unit("c")}) AS tu, bool_or({_west("c")}) AS tw
       FROM (SELECT file_id, regexp_extract(lower(attributes), '\b(lon(gitude)?\b([^;|.]|\.[0-9])*)', 1) AS c FROM dict_obs) GROUP BY file_id),
ol AS (SELECT obs_id, any_value(CASE WHEN NOT isnan(name_lon) THEN name_lon END) AS n,
              max(CASE WHEN {_unit("lon_unit")} <= 1 AND coalesce(tu, 0) > 0 THEN tu ELSE {_unit("lon_unit")} END) AS u,
              bool_or({_west("lon_unit")} OR coalesce(tw, false)) AS w
       FROM obs LEFT JOIN mu USING (file_id) WHERE obs_id IS NOT NULL GROUP BY obs_id),
lon AS (SELECT obs_id, {_deg("n", "u", "w")[0]} AS lon_east, {_deg("n", "u", "w")[1]} AS bare_east FROM ol)"""

R_SQL = f"""
WITH {LON_SQL},
one AS (SELECT DISTINCT ON (obs_id) * FROM obs WHERE obs_id IS NOT NULL),
r AS (SELECT o.obs_id, o.sensor, s.obs_class, o.name_time AS t, epoch_us(o.name_time) / 1e6 AS ts, o.name_lat AS lat, lon.lon_east AS lon,
        CASE WHEN NOT isnan(o.name_xac) THEN o.name_xac END AS xac,
        CASE WHEN NOT isnan(o.name_var) AND abs(o.name_var) <= coalesce(CASE WHEN NOT isnan(s.varmax) THEN s.varmax END, 100.0) THEN o.name_var END AS v,
        CASE WHEN NOT isnan(o.name_err) THEN o.name_err END AS err, CASE WHEN NOT isnan(s.sigma_noise) THEN s.sigma_noise END AS sigma
      FROM one o JOIN sensor s ON s.sensor = o.sensor JOIN lon ON lon.obs_id = o.obs_id
      WHERE o.name_time BETWEEN s.begin_time AND s.end_time AND o.name_lat BETWEEN -90 AND 90 AND lon.lon_east IS NOT NULL)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bc_id, node_id, var_name, t, ts, lat, lon, v: one row per boundary value with time; v null where not given or bad."""
    b = distinct_readings(table(spark, sf_dir, "bc"), "bc_id", "node_id", "var_name", "name_time", "name_lon", "name_lat", "var")
    v = nan_to_null(F.col("var"))
    return b.filter("name_time is not null and name_lat is not null and name_lon is not null").select(
        "bc_id", "node_id", "var_name", F.col("name_time").alias("t"), seconds(F.col("name_time")).alias("ts"), F.col("name_lat").alias("lat"), F.col("name_lon").alias("lon"), F.when(F.abs(v) <= 50, v).alias("v")
    )


B_SQL = """
b AS (SELECT bc_id, node_id, var_name, name_time AS t, epoch_us(name_time) / 1e6 AS ts, name_lat AS lat, name_lon AS lon, CASE WHEN NOT isnan(var) AND abs(var) <= 50 THEN var END AS v
      FROM (SELECT DISTINCT ON (bc_id) * FROM bc WHERE bc_id IS NOT NULL) WHERE name_time IS NOT NULL AND name_lat IS NOT NULL AND name_lon IS NOT NULL)"""

CELL = 5.0  # degrees of the map made from the readings
NI, NJ = int(360 / CELL), int(180 / CELL)


def field(r: DataFrame, by_day: bool = False) -> DataFrame:
    """The map made from the readings: (day,) j, i, lat, lon of the cell's middle, h (mean of |v| < 5), n."""
    r = r.filter(F.abs("v") < 5)
    j, i = F.least(F.floor((F.col("lat") + 90) / CELL), F.lit(NJ - 1)), F.floor(F.col("lon") / CELL)
    keys = [*([F.date_trunc("day", "t").alias("day")] if by_day else []), j.alias("j"), i.alias("i")]
    g = r.groupBy(*keys).agg(F.avg("v").alias("h"), F.count("*").alias("n"))
    return g.withColumn("lat", (F.col("j") + 0.5) * CELL - 90).withColumn("lon", (F.col("i") + 0.5) * CELL)


_G = f"CAST(least(floor((lat + 90) / {CELL}), {NJ - 1}) AS BIGINT) AS j, CAST(floor(lon / {CELL}) AS BIGINT) AS i"
G_SQL = f"{R_SQL},\ng AS (SELECT *, (j + 0.5) * {CELL} - 90 AS lat, (i + 0.5) * {CELL} AS lon FROM (SELECT {_G}, avg(v) AS h, count(*) AS n FROM r WHERE abs(v) < 5 GROUP BY ALL))"
GD_SQL = f"{R_SQL},\ngd AS (SELECT *, (j + 0.5) * {CELL} - 90 AS lat, (i + 0.5) * {CELL} AS lon FROM (SELECT date_trunc('day', t) AS day, {_G}, avg(v) AS h, count(*) AS n FROM r WHERE abs(v) < 5 GROUP BY ALL))"
