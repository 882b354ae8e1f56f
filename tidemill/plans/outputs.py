"""Outputs and caches written and read back, auxiliary and initial fields, orders and sets, further bases and stencils."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import Factory, merge
from tidemill.operators import basis, blend, rowops, spatial, stats, stencils
from tidemill.operators.blocks import ranked
from tidemill.plans.base import B_SQL, CELL, G_SQL, NI, R_SQL, Registry, field, nodes, q6, r6, readings, shared
from tidemill.plans.diagnostics import _D, runs
from tidemill.plans.dynamics import _AN, _FD, _GX, DECAY, LADDER, _analysis, _daily, _gx, _joins, _sten
from tidemill.plans.dynamics import _LAD as _LAD_ROWS
from tidemill.plans.joins import _GW, _M, H_SQL, K, REACH, WIDE, _h, _misfit, _ocean, _wide
from tidemill.plans.models import _T
from tidemill.sources import ingest, sinks
from tidemill.sources.tables import materialize, new_folder, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"{_M} SELECT CAST(floor(ts / 21600) AS BIGINT) AS step, count(*) AS n, {q6('max(abs(m))', '1e4')} AS most FROM mf GROUP BY 1")
def misfit_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misfits written as a folder for each step of six hours, and read back."""
    path = new_folder(spark, "misfit")
    sinks.write_windows(_misfit(spark, sf_dir).withColumn("step", F.floor(F.col("ts") / 21600)).select("obs_id", "m", "step"), path, ["step"])
    return spark.read.parquet(path).groupBy(F.col("step").cast("long").alias("step")).agg(F.count("*").alias("n"), r6(F.max(F.abs("m")), 1e4).alias("most"))


@query(f"{_M} SELECT CAST(floor(ts / 86400) AS BIGINT) % 3 AS part, count(*) AS n, {q6('0.5 * sum(m * m)', '1e2')} AS cost FROM mf GROUP BY 1")
def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of costs to which each of three parts of the days is appended, read back whole."""
    path = new_folder(spark, "costs")
    m = materialize(_misfit(spark, sf_dir).select((F.floor(F.col("ts") / 86400) % 3).alias("part"), "m"), "misfit")
    for part in range(3):
        sinks.append_log(m.filter(F.col("part") == part).groupBy("part").agg(F.count("*").alias("n"), (0.5 * F.sum(F.col("m") ** 2)).alias("cost")), path)
    return spark.read.parquet(path).select("part", "n", r6("cost", 1e2).alias("cost"))


@query(f"{_D} SELECT run, count(*) AS n_days, {q6('min(rmse)')} AS least, {q6('max(rmse)')} AS most FROM d GROUP BY run")
def scores_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily scores written by run, as the diagnostics' output, and read back."""
    path = new_folder(spark, "scores")
    sinks.write_windows(stats.daily_scores(runs(readings(spark, sf_dir)), "ref", "exp"), path, ["run"])
    return spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n_days"), r6(F.min("rmse")).alias("least"), r6(F.max("rmse")).alias("most"))


@query(f"{H_SQL} SELECT cell_id, count(*) AS n, {q6('sum(w)', '1e4')} AS weight FROM h GROUP BY cell_id")
def operator_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation operator made once for its parameters; the second call reads it."""
    folder, key = new_folder(spark, "operators"), {"k": K, "reach": REACH, "sf_dir": sf_dir}
    make = lambda: _h(readings(spark, sf_dir), _ocean(spark, sf_dir)).withColumn("part", F.pmod("obs_id", F.lit(8)))
    ingest.cached(spark, folder, key, make, ["part"])
    return ingest.cached(spark, folder, key, make, ["part"]).groupBy("cell_id").agg(F.count("*").alias("n"), r6(F.sum("w"), 1e4).alias("weight"))


@query(f"{R_SQL}, {_GW} SELECT k, count(*) AS n, {q6('sum(h)', '1e4')} AS total FROM gw GROUP BY k")
def merged_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily maps of the northern and the southern half, written by day into one output and read back; two writers, one table."""
    path = new_folder(spark, "merged")
    g = materialize(_wide(readings(spark, sf_dir)), "maps")
    for half in ("j < 3", "j >= 3"):
        g.filter(half).repartition("k").write.mode("append").partitionBy("k").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"), r6(F.sum("h"), 1e4).alias("total"))


@query(f"""{G_SQL}, x AS (SELECT min(j) AS a, max(j) AS z FROM g), c AS (SELECT j, i FROM (SELECT unnest(generate_series(a, z)) AS j FROM x), (SELECT unnest(generate_series(0, {NI - 1})) AS i))
SELECT c.j, c.i, {q6('coalesce(h, 0.0)')} AS h FROM c LEFT JOIN g ON g.j = c.j AND g.i = c.i WHERE c.j % 2 = 0 AND c.i % 2 = 0""")
def initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map as an initial state: every second cell both ways, missing ones 0."""
    g = materialize(field(readings(spark, sf_dir)), "map")
    rows = g.agg(F.min("j").alias("a"), F.max("j").alias("z")).filter("a is not null").select(F.explode(F.sequence("a", "z")).alias("j"))
    cells = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NI - 1).cast("long")))).filter("j % 2 = 0 and i % 2 = 0")
    return cells.join(g.select("j", "i", "h"), ["j", "i"], "left").select("j", "i", r6(F.coalesce("h", F.lit(0.0))).alias("h"))


@query(f"""{R_SQL}, {_GW}, ax AS (SELECT j, i, avg(h) AS h FROM gw GROUP BY j, i), c AS (SELECT obs_id, (lat + 90) / {WIDE} - 0.5 AS y, lon / {WIDE} - 0.5 AS x, CAST(least(floor((lat + 90) / {WIDE}), 5) AS BIGINT) AS nj, CAST(floor(lon / {WIDE}) AS BIGINT) AS ni FROM r),
a AS (SELECT obs_id, floor(y) + dj AS j, (CAST(floor(x) AS BIGINT) + di + 12) % 12 AS i, abs(1 - dj - (y - floor(y))) * abs(1 - di - (x - floor(x))) AS w FROM c, (VALUES (0), (1)) p(dj), (VALUES (0), (1)) q(di)),
l AS (SELECT obs_id, sum(w * h) AS v FROM a JOIN ax ON ax.j = a.j AND ax.i = a.i GROUP BY obs_id HAVING count(*) = 4)
SELECT c.obs_id, {q6('coalesce(l.v, ax.h)')} AS aux FROM c LEFT JOIN l USING (obs_id) LEFT JOIN ax ON ax.j = nj AND ax.i = ni WHERE l.v IS NOT NULL OR ax.h IS NOT NULL""")
def aux_to_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An auxiliary field, the mean over time of the daily maps, at the readings: linear, held constant where a corner is missing."""
    r = shared(spark, sf_dir)
    aux = materialize(_wide(r).groupBy("j", "i").agg(F.avg("h").alias("h")), "aux")
    own = r.select("obs_id", F.least(F.floor((F.col("lat") + 90) / WIDE), F.lit(5)).alias("j"), F.floor(F.col("lon") / WIDE).alias("i")).join(aux, ["j", "i"], "left").select("obs_id", "h")
    out = own.join(spatial.interpolate(r, aux, WIDE, "h"), "obs_id", "left").select("obs_id", F.coalesce("value", "h").alias("aux"))
    return out.filter("aux is not null").withColumn("aux", r6("aux"))


_B31 = 1 << 31


@query(f"""{R_SQL}, a AS (SELECT obs_id, v, (CAST(obs_id AS BIGINT) % {_B31} * 1103515245 + 12345) % {_B31} AS x FROM r WHERE v IS NOT NULL), b AS (SELECT *, (x * x) // 65536 % {_B31} AS y FROM a),
c AS (SELECT *, (y * 69069 + 1) % {_B31} AS z FROM b), d AS (SELECT *, (z * z) // 65536 % {_B31} AS w FROM c)
SELECT obs_id, {q6(f'v + 0.05 * sqrt(-2 * ln((y + 1) / {_B31}.0::DOUBLE)) * cos(2 * pi() * w / {_B31}.0::DOUBLE)', '1e4')} AS v FROM d""")
def synthetic_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with normal noise of 0.05 that is the same in every run, as it is made from the reading's number."""
    return readings(spark, sf_dir).filter("v is not null").select("obs_id", r6(F.col("v") + 0.05 * rowops.normal_noise(F.col("obs_id")), 1e4).alias("v"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL")
def json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes told in JSON, parsed to a map and grouped by one of its values."""
    k = F.from_json("props", "map<string, string>")["k"].cast("long")
    e = table(spark, sf_dir, "events").withColumn("_k", k).filter("_k is not null")
    return e.groupBy("event_type", (F.col("_k") % 10).alias("k")).agg(F.count("*").alias("n"), F.sum("_k").alias("total"))


@query("SELECT 'neither read' AS kind, file_id FROM (SELECT file_id FROM dict_obs EXCEPT SELECT file_id FROM obs) UNION ALL SELECT 'read', file_id FROM (SELECT file_id FROM dict_obs INTERSECT SELECT file_id FROM obs)")
def manifest_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the manifest lists and the readings do not know, and those both know."""
    d, o = table(spark, sf_dir, "dict_obs").select("file_id"), table(spark, sf_dir, "obs").select("file_id")
    return d.subtract(o).select(F.lit("neither read").alias("kind"), "file_id").unionByName(d.intersect(o).select(F.lit("read").alias("kind"), "file_id"))


@query(f"WITH {B_SQL} SELECT row_number() OVER (ORDER BY lon, bc_id) - 1 AS position, bc_id, {q6('lon')} AS lon FROM b WHERE v IS NOT NULL")
def sort_by_longitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary values in order of longitude, with their place in it; columns of a tenth of a degree are counted, each is sorted by itself."""
    b = materialize(nodes(spark, sf_dir).filter("v is not null").select("bc_id", "lon", F.lit(1).alias("all")), "boundary")
    out = ranked(b, ["all"], F.floor(F.col("lon") * 10), ["lon", "bc_id"])
    return out.select(F.col("rank").alias("position"), "bc_id", r6("lon").alias("lon"))


@query(f"{R_SQL}, x AS (SELECT min(ts) AS a, max(ts) AS z FROM r) SELECT make_timestamp(CAST(unnest(generate_series(CAST(floor(a / 86400) AS BIGINT), CAST(floor(z / 86400) AS BIGINT), 3)) * 86400000000 AS BIGINT)) AS date FROM x")
def generate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start dates of windows of three days over the readings' time."""
    x = readings(spark, sf_dir).agg(F.floor(F.min("ts") / 86400).alias("a"), F.floor(F.max("ts") / 86400).alias("z")).filter("a is not null")
    return x.select(F.explode(F.sequence("a", "z", F.lit(3).cast("long"))).alias("day")).select(F.timestamp_seconds(F.col("day") * 86400).cast("timestamp_ntz").alias("date"))


_S6 = {"ww": (0, -2), "w": (0, -1), "e": (0, 1), "ee": (0, 2), "eee": (0, 3)}


@query(f"{_joins(_S6)} SELECT j, i, {q6('(h + e) / 2')} AS two, {q6('(-w + 7 * h + 7 * e - ee) / 12')} AS four, {q6('(ww - 8 * w + 37 * h + 37 * e - 8 * ee + eee) / 60')} AS six FROM st WHERE e IS NOT NULL")
def stencil_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred values at each cell's eastern face from two, four and six points; null where a point is missing."""
    h, w, e, ww, ee, eee = (F.col(c) for c in ("h", "w", "e", "ww", "ee", "eee"))
    s = _sten(readings(spark, sf_dir), _S6).filter("e is not null")
    return s.select("j", "i", r6((h + e) / 2).alias("two"), r6((-w + 7 * h + 7 * e - ee) / 12).alias("four"), r6((ww - 8 * w + 37 * h + 37 * e - 8 * ee + eee) / 60).alias("six"))


@query(f"""{R_SQL}, {_GW}, s AS (SELECT k, j + dj AS j, (i + di + 12) % 12 AS i, h, exp(-(dj * dj + di * di) / 2.0) AS w, dj = 0 AND di = 0 AS own FROM gw, (VALUES (-1), (0), (1)) a(dj), (VALUES (-1), (0), (1)) b(di) WHERE j + dj BETWEEN 0 AND 5)
SELECT k, j, i, bool_or(own) AS given, {q6('CASE WHEN bool_or(own) THEN max(h) FILTER (own) ELSE sum(w * h) / sum(w) END')} AS h FROM s GROUP BY k, j, i""")
def kernel_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily maps whose missing cells beside given ones are filled by a Gaussian kernel of 3 x 3 cells, before they are merged."""
    return blend.kernel_filled(_wide(readings(spark, sf_dir)), ["k"], "h", round(180 / WIDE), round(360 / WIDE)).withColumn("h", r6("h"))


@query(f"""{R_SQL}, {_FD}, c AS (SELECT DISTINCT j, i, (j + 0.5) * {CELL} - 90 AS lat, (i + 0.5) * {CELL} AS lon FROM fd), ce AS (SELECT DISTINCT CAST(floor(lat / 20 + 0.5) AS BIGINT) AS pj, CAST(floor(lon / 20 + 0.5) AS BIGINT) % 18 AS pi FROM c),
bu AS (SELECT pj, pi, j, i, greatest(1 - abs(x) / 20, 0) * greatest(1 - abs(y) / 20, 0) AS w FROM (SELECT pj, pi, j, i, lat - pj * 20 AS y, (lon - pi * 20 + 540) % 360 - 180 AS x FROM ce, c) WHERE abs(x) < 20 AND abs(y) < 20),
s AS (SELECT it, j, i, sum(wt * y) AS s FROM fd JOIN gt USING (day) GROUP BY ALL) SELECT pj, pi, it, {q6('sum(w * s)', '1e4')} AS x FROM s JOIN bu USING (j, i) GROUP BY ALL""")
def basis_gauss3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis by a basis without directions in space and time: hats on a lattice of 20 degrees times the time factor."""
    d = materialize(_daily(readings(spark, sf_dir)), "daily")
    cells = materialize(d.select("j", "i").distinct().withColumn("lat", (F.col("j") + 0.5) * CELL - 90).withColumn("lon", (F.col("i") + 0.5) * CELL), "cells")
    hat = lambda x: F.greatest(1 - F.abs(x) / 20, F.lit(0.0))
    x = basis.analysis(basis.bumps(cells, 20.0, 20.0, CELL, hat), basis.gt(d.select("day").distinct(), DECAY), d, "y", ["pj", "pi"])
    return x.select("pj", "pi", "it", r6("x", 1e4).alias("x"))


_LAD = "l(ift, decay) AS (VALUES (0, 5.0), (1, 15.0))"


@query(f"""{_GX}, {_FD}, {_LAD}, gl AS (SELECT ift, it, day, pow(cos(pi() / 2 * (day - it * decay) / decay), 2) AS wt FROM (SELECT ift, decay, day, unnest([CAST(floor(day / decay) AS BIGINT), CAST(floor(day / decay) AS BIGINT) + 1]) AS it FROM (SELECT DISTINCT day FROM fd), l)),
s AS (SELECT ift, it, j, i, sum(wt * y) AS s FROM fd JOIN gl USING (day) GROUP BY ALL) SELECT iff, pj, pi, itheta, phase, ift, it, {q6('sum(w * s)', '1e4')} AS x FROM s JOIN gx USING (j, i) GROUP BY ALL""")
def basis_wavelet3d_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis by the basis that is a ladder in space and in time."""
    r = shared(spark, sf_dir)
    d = materialize(_daily(r), "daily")
    gl = basis.gt_ladder(d.select("day").distinct(), [5.0, 15.0])
    s = d.join(gl, "day").groupBy("ift", "it", "j", "i").agg(F.sum(F.col("wt") * F.col("y")).alias("s"))
    x = s.join(_gx(r), ["j", "i"]).groupBy("iff", "pj", "pi", "itheta", "phase", "ift", "it").agg(F.sum(F.col("w") * F.col("s")).alias("x"))
    return x.withColumn("itheta", F.col("itheta").cast("long")).withColumn("x", r6("x", 1e4))


def _carrier(t: str, a: int) -> tuple[float, float, float]:
    om, th = 2 * math.pi / (stencils.TIDES_H[t] * 3600), a * math.pi / 4
    return om, math.cos(th), math.sin(th)


def _hbc_cst(t: str, a: int, f: str) -> str:
    om, c, s = _carrier(t, a)
    return f"sum(v * {f}({om!r} * ts - 1e-6 * ({c!r} * lon + {s!r} * lat) * 111000.0))"


@query(f"""WITH {B_SQL}, x AS (SELECT min(lat) AS s, max(lat) AS n FROM b), k AS (SELECT *, CASE WHEN lat = s THEN 'S' ELSE 'N' END AS side FROM b, x WHERE (lat = s OR lat = n) AND v IS NOT NULL)
SELECT side, tide, angle, comp, {q6('x', '1e2')} AS x FROM ({' UNION ALL '.join(f"SELECT side, '{t}' AS tide, {a} AS angle, '{f}' AS comp, {_hbc_cst(t, a, f)} AS x FROM k GROUP BY side" for t, a in _T for f in ('cos', 'sin'))})""")
def basis_hbc_cst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis by the boundary basis that is constant in space and time: one amplitude for each side, tide, angle and component."""
    b = nodes(spark, sf_dir)
    b = b.join(F.broadcast(b.agg(F.min("lat").alias("south"), F.max("lat").alias("north"))))  # one row
    b = b.filter("(lat = south or lat = north) and v is not null").withColumn("side", F.when(F.col("lat") == F.col("south"), "S").otherwise("N"))
    parts = []
    for t, a in _T:
        om, c, s = _carrier(t, a)
        phase = om * F.col("ts") - 1e-6 * (c * F.col("lon") + s * F.col("lat")) * 111000.0
        parts += [F.struct(F.lit(t).alias("tide"), F.lit(a).alias("angle"), F.lit(n).alias("comp"), F.sum(F.col("v") * f(phase)).alias("x")) for n, f in (("cos", F.cos), ("sin", F.sin))]
    return b.groupBy("side").agg(F.array(*parts).alias("p")).select("side", F.explode("p").alias("p")).select("side", "p.tide", "p.angle", "p.comp", r6("p.x", 1e2).alias("x"))


_STATISTICS = Factory()
_STATISTICS.register("count")(lambda g: g.agg(F.count("*").cast("double").alias("value")).withColumn("name", F.lit("count")))
_STATISTICS.register("mean")(lambda g: g.agg(F.avg("v").alias("value")).withColumn("name", F.lit("mean")))


@query(f"""{R_SQL}, k AS (SELECT CAST(floor((ts + 5400) / 10800) AS BIGINT) AS win, v FROM r WHERE abs(v) <= 50) SELECT win, 'count' AS name, count(*) * 1.0::DOUBLE AS value FROM k GROUP BY win UNION ALL SELECT win, 'mean', {q6('avg(v)')} FROM k GROUP BY win""")
def configured_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run told by a configuration: window and largest value from it, the statistics by name from the factory."""
    c = merge({"obs": {"window_s": 10800, "varmax": 50.0}})
    r = readings(spark, sf_dir).filter(F.abs("v") <= c.obs.varmax).withColumn("win", F.floor((F.col("ts") + c.obs.window_s / 2) / c.obs.window_s))
    r = materialize(r.select("win", "v"), "windows")
    both = _STATISTICS.several(["count", "mean"], lambda x: x[0].unionByName(x[1]))
    return both(r.groupBy("win")).select("win", "name", F.when(F.col("name") == "mean", r6("value")).otherwise(F.col("value")).alias("value"))


@query(f"{_AN} SELECT iff, count(*) AS n, {q6('sum(x)', '1e2')} AS total FROM (SELECT iff, x + 0.5 * coalesce(x, 0) AS x FROM an) GROUP BY iff")
def control_vector_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control vector written by scale and read back as the background, to which half of it is added as an increment."""
    path = new_folder(spark, "control")
    x = _analysis(shared(spark, sf_dir))[2]
    sinks.write_windows(x, path, ["iff"])
    key = ["iff", "pj", "pi", "itheta", "phase", "it"]
    background = spark.read.parquet(path)
    step = background.select(*key, (0.5 * F.col("x")).alias("dx"))
    new = background.join(step, key, "left").withColumn("x", F.col("x") + F.coalesce("dx", F.lit(0.0)))
    return new.groupBy(F.col("iff").cast("int").alias("iff")).agg(F.count("*").alias("n"), r6(F.sum("x"), 1e2).alias("total"))


@query(f"{_AN} SELECT iff, pj, pi, itheta, phase, it, {q6('x * 0.1 * pow(least(half / 3000.0, 1), 2.5)', '1e6')} AS xi FROM an JOIN (SELECT iff AS f, lam AS half FROM (VALUES {_LAD_ROWS}) l(iff, lam)) ON f = iff")
def preconditioned_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient in the preconditioned space: each wavelet's analysis times the root of its background variance."""
    x = _analysis(shared(spark, sf_dir))[2]
    law = basis.spectral_laws(_scales(spark), 3000.0, 0.1, 2.5, 10.0, 1.2, 1.0)
    return x.join(F.broadcast(law), "iff").select("iff", "pj", "pi", F.col("itheta").cast("long").alias("itheta"), "phase", "it", r6(F.col("x") * F.col("q")).alias("xi"))  # a row a scale


def _scales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, float(lam)) for n, lam in enumerate(LADDER)], "iff int, half double")


@query(f"{R_SQL}, {_GW} SELECT k, j, i, {q6('h')} AS h FROM gw WHERE k = (SELECT max(k) FROM gw WHERE k <= (SELECT floor(avg(k)) FROM gw))")
def restart_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States written by day; the one to restart from is the latest at or before a date (the mean day), and only its folder is read."""
    path = new_folder(spark, "restart")
    sinks.write_windows(_wide(readings(spark, sf_dir)), path, ["k"])
    states = spark.read.parquet(path)
    date = states.agg(F.floor(F.avg("k")).alias("date"))
    last = states.select("k").join(F.broadcast(date)).filter("k <= date").agg(F.max("k").alias("k"))  # one row each
    return states.join(F.broadcast(last), "k").select(F.col("k").cast("long").alias("k"), F.col("j"), "i", r6("h").alias("h"))


@query("SELECT file_id, regexp_replace(obs_path, '^.*/', 'copy/') AS path, obs_name FROM dict_obs WHERE window_ts BETWEEN TIMESTAMP '1993-01-02' AND TIMESTAMP '1993-01-05' AND obs_path IS NOT NULL")
def manifest_dated_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's entries of some days, written for another folder with their paths moved there, and read back."""
    path = new_folder(spark, "manifest")
    d = table(spark, sf_dir, "dict_obs").filter(F.col("window_ts").between(F.lit("1993-01-02").cast("timestamp_ntz"), F.lit("1993-01-05").cast("timestamp_ntz")) & F.col("obs_path").isNotNull())
    d.select("file_id", F.regexp_replace("obs_path", "^.*/", "copy/").alias("path"), "obs_name").write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT sensor, CAST(floor(epoch_us(name_time) / 1e6 / 10800) AS BIGINT) AS win, count(*) AS n FROM obs WHERE name_time IS NOT NULL AND sensor IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (NOT isnan(name_lon * name_lat) AND NOT isinf(name_lon * name_lat)) > 0")
def windows_not_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of which at least one row has a position."""
    at = F.col("name_lon") * F.col("name_lat")
    o = table(spark, sf_dir, "obs").filter("name_time is not null and sensor is not null")
    g = o.groupBy("sensor", F.floor(F.unix_micros(F.col("name_time").cast("timestamp")) / 1e6 / 10800).alias("win")).agg(F.count("*").alias("n"), F.count_if(F.abs(at) < float("inf")).alias("given"))
    return g.filter("given > 0").drop("given")


@query(f"""{R_SQL}, {_GW}, ax AS (SELECT j, i, stddev_pop(h) AS s FROM gw GROUP BY j, i HAVING count(*) > 1) SELECT obs_id, {q6('coalesce(1.5 * s, err, sigma, 1.0)')} AS err FROM (SELECT obs_id, err, sigma, CAST(least(floor((lat + 90) / {WIDE}), 5) AS BIGINT) AS j, CAST(floor(lon / {WIDE}) AS BIGINT) AS i FROM r) LEFT JOIN ax USING (j, i)""")
def obs_error_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors from an auxiliary map (the deviation of the daily maps) times a factor; else as delivered, nominal, or 1."""
    r = shared(spark, sf_dir)
    aux = _wide(r).groupBy("j", "i").agg(F.when(F.count("*") > 1, F.stddev_pop("h")).alias("s"))
    r = r.withColumns({"j": F.least(F.floor((F.col("lat") + 90) / WIDE), F.lit(5)), "i": F.floor(F.col("lon") / WIDE)}).join(aux, ["j", "i"], "left")
    return r.select("obs_id", r6(F.coalesce(1.5 * F.col("s"), "err", "sigma", F.lit(1.0))).alias("err"))


@query(f"WITH {B_SQL} SELECT bc_id, {q6("v + CASE var_name WHEN 'ssh' THEN 0.25 WHEN 'sst' THEN -0.5 ELSE 0 END")} AS v FROM b WHERE v IS NOT NULL")
def offset_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gridded values with the offset of their own variable; 0 for variables that have none."""
    offset = F.create_map(F.lit("ssh"), F.lit(0.25), F.lit("sst"), F.lit(-0.5))
    return nodes(spark, sf_dir).filter("v is not null").select("bc_id", r6(F.col("v") + F.coalesce(offset[F.col("var_name")], F.lit(0.0))).alias("v"))


@query("""SELECT l_orderkey, floor(sum(p * dz) / sum(dz) * 1e9 + 0.37) / 1e9 AS one, floor(sum(p * p * dz) / sum(dz) * 1e9 + 0.37) / 1e9 AS two, floor(sum(p * p * p * dz) / sum(dz) * 1e9 + 0.37) / 1e9 AS three, floor(sum(p * t * dz) / sum(dz) * 1e9 + 0.37) / 1e9 AS crossed
FROM (SELECT l_orderkey, CAST(l_discount AS DOUBLE) AS p, CAST(l_tax AS DOUBLE) AS t, CAST(l_quantity AS DOUBLE) AS dz FROM lineitem) GROUP BY l_orderkey""")
def coupling_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-weighted means of a mode, its square, its cube and its product with another; an order's lines are its layers."""
    p, t, dz = (F.col(c).cast("double") for c in ("l_discount", "l_tax", "l_quantity"))
    mean = lambda x: F.floor(F.sum(x * dz) / F.sum(dz) * 1e9 + 0.37) / 1e9
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(mean(p).alias("one"), mean(p * p).alias("two"), mean(p * p * p).alias("three"), mean(p * t).alias("crossed"))


@query(r"""SELECT file_id, regexp_extract(obs_path, '_([A-Z0-9]+)_SSH_', 1) AS sensor, regexp_extract(obs_path, '_SSH_([0-9]{8})_', 1) AS day, upper(split_part(obs_path, '.', -1)) AS kind, length(obs_path) AS size FROM dict_obs WHERE obs_path IS NOT NULL""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest's paths tell: sensor, day and kind of file."""
    d = table(spark, sf_dir, "dict_obs").filter("obs_path is not null")
    return d.select("file_id", F.regexp_extract("obs_path", "_([A-Z0-9]+)_SSH_", 1).alias("sensor"), F.regexp_extract("obs_path", "_SSH_([0-9]{8})_", 1).alias("day"), F.upper(F.substring_index("obs_path", ".", -1)).alias("kind"), F.length("obs_path").alias("size"))


FINE, SHORT = 1.0, basis.scales(970.0, 121.0, 2.0)
_SHORT = ", ".join(f"({n}, CAST({lam} AS DOUBLE))" for n, lam in enumerate(SHORT))
_WAVE = "sqrt(2) * pow(cos(pi() / 2 * x / half), 2) * pow(cos(pi() / 2 * y / half), 2) * CASE WHEN phase = 0 THEN cos(2 * pi() / half * (cos(t * pi() / 2) * x + sin(t * pi() / 2) * y)) ELSE sin(2 * pi() / half * (cos(t * pi() / 2) * x + sin(t * pi() / 2) * y)) END"


@query(f"""{R_SQL}, fd AS (SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, CAST(least(floor((lat + 90) / {FINE}), 179) AS BIGINT) AS j, CAST(floor(lon / {FINE}) AS BIGINT) AS i, avg(v) AS y FROM r WHERE abs(v) < 5 GROUP BY ALL),
g AS (SELECT DISTINCT j, i, (j + 0.5) * {FINE} - 90 AS lat, (i + 0.5) * {FINE} AS lon FROM fd),
ce AS (SELECT *, pj * step AS lat0, pi * step AS lon0 FROM (SELECT DISTINCT iff, lam AS half, lam / 110.0 / 2 AS step, CAST(floor(lat / (lam / 110.0 / 2) + 0.5) AS BIGINT) AS pj, CAST(floor(lon / (lam / 110.0 / 2) + 0.5) AS BIGINT) AS pi FROM g, (VALUES {_SHORT}) l(iff, lam)) WHERE abs(pj * step) <= 85),
bx AS (SELECT iff, pj, pi, half, j, i, (lon - lon0 + 540 - 360 * floor((lon - lon0 + 540) / 360) - 180) * 110.0 * cos(radians(lat0)) AS x, (lat - lat0) * 110.0 AS y FROM ce JOIN g ON lat BETWEEN lat0 - half / 109.0 AND lat0 + half / 109.0),
gx AS (SELECT iff, pj, pi, j, i, t AS itheta, phase, {_WAVE} AS w FROM bx, (VALUES (0), (1)) a(t), (VALUES (0), (1)) q(phase) WHERE abs(x) <= half AND abs(y) <= half),
gt AS (SELECT day, it, pow(cos(pi() / 2 * (day - it * {DECAY}) / {DECAY}), 2) AS wt FROM (SELECT day, unnest([CAST(floor(day / {DECAY}) AS BIGINT), CAST(floor(day / {DECAY}) AS BIGINT) + 1]) AS it FROM (SELECT DISTINCT day FROM fd))),
an AS (SELECT iff, pj, pi, itheta, phase, it, sum(w * s) AS x FROM (SELECT it, j, i, sum(wt * y) AS s FROM fd JOIN gt USING (day) GROUP BY ALL) JOIN gx USING (j, i) GROUP BY ALL)
SELECT iff, itheta, phase, it, count(*) FILTER (abs(x) > 1e-6) AS n, {q6('sum(x)', '1e2')} AS total, {q6('sum(x * x)', '1e2')} AS energy FROM an GROUP BY ALL""")
def basis_analysis_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis by wavelets of 970 to 121 km on a map of one degree: number, sum and energy of the control vector by scale, direction and time."""
    j = F.least(F.floor((F.col("lat") + 90) / FINE), F.lit(179))
    d = readings(spark, sf_dir).filter(F.abs("v") < 5).groupBy(F.floor(F.col("ts") / 86400).alias("day"), j.alias("j"), F.floor(F.col("lon") / FINE).alias("i")).agg(F.avg("v").alias("y"))
    d = materialize(d, "daily")
    cells = materialize(d.select("j", "i").distinct().withColumns({"lat": (F.col("j") + 0.5) * FINE - 90, "lon": (F.col("i") + 0.5) * FINE}), "cells")
    x = basis.analysis(basis.gx(basis.centres(cells, FINE, SHORT), cells, FINE, 2), basis.gt(d.select("day").distinct(), DECAY), d, "y")
    return x.groupBy("iff", F.col("itheta").cast("long").alias("itheta"), "phase", "it").agg(F.count_if(F.abs("x") > 1e-6).alias("n"), r6(F.sum("x"), 1e2).alias("total"), r6(F.sum(F.col("x") ** 2), 1e2).alias("energy"))
