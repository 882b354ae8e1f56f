"""Scores of gridded maps, gridded observations, boundary fields on the grid, blocks of swaths, several bases at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import scalars
from tidemill.operators import gridded, grids, rowops, spatial, stats, stencils
from tidemill.operators.blocks import ranked
from tidemill.plans.base import B_SQL, CELL, G_SQL, NI, NJ, R_SQL, Registry, field, nodes, q6, r6, readings, shared
from tidemill.plans.dynamics import _AN, _DX, _DY, _F, _X, _analysis, _daily, _sten
from tidemill.plans.joins import _xyz
from tidemill.sources.tables import materialize

query = Registry()
QUERIES, SQL = query.queries, query.sql

TWO_DAYS, TEN = 172800.0, 30.0
NT = round(360 / TEN)


def _maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference: day, j, i, ref; pairs: run, day, j, i, ref, exp).

    The reference is the daily map of the swath sensors. The experiment is the map of the nadir sensors in wider cells and
    steps of two days, regridded to the reference's cells and days; the baseline is their mean by band of latitude, on
    the reference's own grid. A cell that either lacks takes no part in the run's differences.
    """
    r = materialize(readings(spark, sf_dir).filter(F.abs("v") < 5).select("obs_class", "ts", "lat", "lon", "v"), "readings")
    swath, nadir = r.filter("obs_class = 'OBS_SSH_SWATH'"), r.filter("obs_class = 'OBS_SSH_NADIR'")
    row = lambda cell, n: F.least(F.floor((F.col("lat") + 90) / cell), F.lit(n - 1)).alias("j")
    col = lambda cell: F.floor(F.col("lon") / cell).alias("i")
    ref = materialize(swath.groupBy(F.floor(F.col("ts") / 86400).alias("day"), row(CELL, NJ), col(CELL)).agg(F.avg("v").alias("ref")), "reference")
    made = nadir.groupBy(F.floor(F.col("ts") / TWO_DAYS).alias("k"), row(TEN, round(180 / TEN)), col(TEN)).agg(F.avg("v").alias("h"))
    at = ref.select(((F.col("day") * NJ + F.col("j")) * NI + F.col("i")).alias("cell"), ((F.col("j") + 0.5) * CELL - 90).alias("lat"), ((F.col("i") + 0.5) * CELL).alias("lon"), ((F.col("day") + 0.5) * 86400).alias("ts"))
    exp = spatial.interpolate(at, made, TEN, "h", at_time="ts", step_s=TWO_DAYS, point="cell", to="exp")
    bas = nadir.groupBy(row(CELL, NJ)).agg(F.avg("v").alias("exp"))
    keyed = ref.withColumn("cell", (F.col("day") * NJ + F.col("j")) * NI + F.col("i"))
    cols = ["day", "j", "i", "ref", "exp"]
    pairs = keyed.join(exp, "cell").select(F.lit("experiment").alias("run"), *cols).unionByName(ref.join(bas, "j").select(F.lit("baseline").alias("run"), *cols))
    return ref, pairs.filter("exp is not null")


_O = f"""{R_SQL}, k AS (SELECT * FROM r WHERE abs(v) < 5), rd AS (SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, CAST(least(floor((lat + 90) / {CELL}), {NJ - 1}) AS BIGINT) AS j, CAST(floor(lon / {CELL}) AS BIGINT) AS i, avg(v) AS ref FROM k WHERE obs_class = 'OBS_SSH_SWATH' GROUP BY ALL),
mk AS (SELECT CAST(floor(ts / {TWO_DAYS}) AS BIGINT) AS k, CAST(least(floor((lat + 90) / {TEN}), {180 // TEN - 1}) AS BIGINT) AS j, CAST(floor(lon / {TEN}) AS BIGINT) AS i, avg(v) AS h FROM k WHERE obs_class = 'OBS_SSH_NADIR' GROUP BY ALL),
p AS (SELECT day, j, i, ref, (j + 0.5) * {CELL} / {TEN} - 0.5 AS y, (i + 0.5) * {CELL} / {TEN} - 0.5 AS x, (day + 0.5) * 86400 / {TWO_DAYS} - 0.5 AS s FROM rd),
a AS (SELECT day, j, i, ref, floor(y) + dj AS mj, (CAST(floor(x) AS BIGINT) + di + {NT}) % {NT} AS mi, floor(s) + dk AS mt, abs(1 - dj - (y - floor(y))) * abs(1 - di - (x - floor(x))) * abs(1 - dk - (s - floor(s))) AS w FROM p, (VALUES (0), (1)) b(dj), (VALUES (0), (1)) c(di), (VALUES (0), (1)) d(dk)),
oe AS (SELECT day, a.j, a.i, any_value(ref) AS ref, sum(w * h) AS exp FROM a JOIN mk ON mk.j = mj AND mk.i = mi AND mk.k = mt GROUP BY day, a.j, a.i HAVING count(*) = 8),
ob AS (SELECT CAST(least(floor((lat + 90) / {CELL}), {NJ - 1}) AS BIGINT) AS j, avg(v) AS exp FROM k WHERE obs_class = 'OBS_SSH_NADIR' GROUP BY 1),
pr AS (SELECT 'experiment' AS run, day, j, i, ref, exp FROM oe UNION ALL SELECT 'baseline', day, j, i, ref, exp FROM rd JOIN ob USING (j)),
st AS (SELECT run, day, n, rmse, 1 - rmse / rms AS score FROM (SELECT run, day, count(*) AS n, sqrt(avg((exp - ref) * (exp - ref))) AS rmse FROM pr GROUP BY run, day) JOIN (SELECT day, sqrt(avg(ref * ref)) AS rms FROM rd GROUP BY day) USING (day))"""


@query(f"{_O} SELECT run, day, n, {q6('rmse')} AS rmse, {q6('score')} AS score FROM st")
def osse_rmse_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE and score of the regridded maps by day."""
    ref, pairs = _maps(spark, sf_dir)
    return gridded.scores_in_time(pairs, ref, ["run"], "day").select("run", "day", "n", r6("rmse").alias("rmse"), r6("score").alias("score"))


@query(f"{_O} SELECT run, j, i, count(*) AS n, {q6('sqrt(avg((exp - ref) * (exp - ref)))')} AS rmse FROM pr GROUP BY ALL")
def osse_rmse_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE of the regridded maps by cell."""
    return _maps(spark, sf_dir)[1].groupBy("run", "j", "i").agg(F.count("*").alias("n"), r6(stats.rmse(F.col("exp") - F.col("ref"))).alias("rmse"))


@query(f"""{_O}, q AS (SELECT run, j, i, sqrt(avg((exp - ref) * (exp - ref))) AS rmse FROM pr GROUP BY ALL)
SELECT e.j, e.i, {q6('100 * (e.rmse - b.rmse) / b.rmse', '1e4')} AS pct FROM q e JOIN q b ON e.j = b.j AND e.i = b.i AND e.run = 'experiment' AND b.run = 'baseline' WHERE b.rmse > 1e-6""")
def osse_improvement_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the RMSE by cell against the baseline, in per cent."""
    q = _maps(spark, sf_dir)[1].groupBy("j", "i").pivot("run", ["experiment", "baseline"]).agg(stats.rmse(F.col("exp") - F.col("ref")))
    return q.filter("baseline > 1e-6 and experiment is not null").select("j", "i", r6(100 * (F.col("experiment") - F.col("baseline")) / F.col("baseline"), 1e4).alias("pct"))


@query(f"""{_O} SELECT run, {q6('any_value(mu)')} AS mu, {q6('stddev_pop(score)')} AS sigma, count(*) AS n_days FROM st JOIN (SELECT run, 1 - sqrt(avg((exp - ref) * (exp - ref))) / (SELECT sqrt(avg(ref * ref)) FROM rd) AS mu FROM pr GROUP BY run) USING (run) GROUP BY run""")
def osse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global score of each run, and the deviation of its daily scores."""
    ref, pairs = _maps(spark, sf_dir)
    pairs = materialize(pairs, "pairs")
    daily = gridded.scores_in_time(pairs, ref, ["run"], "day").groupBy("run").agg(r6(F.stddev_pop("score")).alias("sigma"), F.count("*").alias("n_days"))
    rms = ref.agg(F.sqrt(F.avg(F.col("ref") ** 2)).alias("rms"))
    mu = pairs.groupBy("run").agg(stats.rmse(F.col("exp") - F.col("ref")).alias("rmse")).join(F.broadcast(rms))  # one row
    return mu.select("run", r6(1 - F.col("rmse") / F.col("rms")).alias("mu")).join(daily, "run")


@query(f"""{G_SQL}, ix AS (SELECT DISTINCT CAST(floor(ts / 432000) AS BIGINT) AS win FROM r WHERE abs(v) < 5 AND obs_class = 'OBS_SSH_SWATH'),
lw AS (SELECT CAST(floor(ts / 432000) AS BIGINT) AS win, CAST(least(floor((lat + 90) / {TEN}), {180 // TEN - 1}) AS BIGINT) AS lj, CAST(floor(lon / {TEN}) AS BIGINT) AS li, avg(v) AS y, avg(coalesce(err, sigma, 1.0)) AS e FROM r WHERE abs(v) < 5 AND obs_class = 'OBS_SSH_SWATH' GROUP BY ALL),
lg AS (SELECT win, min(y) AS lo, max(y) AS hi, avg(cos(radians((lj + 0.5) * {TEN} - 90))) * {TEN * TEN} AS area FROM lw GROUP BY win), ga AS (SELECT avg(cos(radians(lat))) * {CELL * CELL} AS area FROM g),
cg AS (SELECT j, i, {_xyz('p')} FROM g), cw AS (SELECT lj, li, {_xyz('c')} FROM (SELECT DISTINCT lj, li, (lj + 0.5) * {TEN} - 90 AS lat, (li + 0.5) * {TEN} AS lon FROM lw)),
nr AS (SELECT j, i, lj, li, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy) + (pz - cz) * (pz - cz)) AS d FROM cg, cw),
nn AS (SELECT win, j, i, y, e FROM (SELECT win, j, i, y, e, row_number() OVER (PARTITION BY win, j, i ORDER BY d, lj * {NT} + li) AS rk FROM nr JOIN lw USING (lj, li) WHERE d <= 4000) WHERE rk = 1),
c AS (SELECT j, i, (j + 0.5) * {CELL} / {TEN} - 0.5 AS yy, (i + 0.5) * {CELL} / {TEN} - 0.5 AS xx FROM g),
a AS (SELECT j, i, floor(yy) + dj AS lj, (CAST(floor(xx) AS BIGINT) + di + {NT}) % {NT} AS li, abs(1 - dj - (yy - floor(yy))) * abs(1 - di - (xx - floor(xx))) AS w FROM c, (VALUES (0), (1)) p(dj), (VALUES (0), (1)) q(di)),
li AS (SELECT win, j, i, sum(w * y) AS y, sum(w * e) AS e FROM a JOIN lw USING (lj, li) GROUP BY win, j, i HAVING count(*) = 4),
v AS (SELECT nn.win, nn.j, nn.i, coalesce(li.y, nn.y) AS y, coalesce(li.e, nn.e) * greatest(1.0, lg.area / ga.area) AS e, lo, hi FROM nn LEFT JOIN li ON li.win = nn.win AND li.j = nn.j AND li.i = nn.i JOIN lg ON lg.win = nn.win, ga)
SELECT win, j, i, {q6('CASE WHEN ok THEN y ELSE 0.0 END')} AS y, CASE WHEN ok THEN {q6('e')} ELSE 1e15 END AS err FROM (SELECT *, coalesce(y BETWEEN lo AND hi AND y <= 1e7 AND e >= 1e-7, false) AS ok FROM v)""")
def l4_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gridded product as observations of the model's cells: for each window of five days the mean map of the swath sensors in
    wide cells, nearest first and linear where it can be, errors grown by the ratio of cell areas, guarded by its range."""
    r = shared(spark, sf_dir)
    g = materialize(field(r), "cells")
    wide_j, wide_i = F.least(F.floor((F.col("lat") + 90) / TEN), F.lit(round(180 / TEN) - 1)), F.floor(F.col("lon") / TEN)
    sw = r.filter("abs(v) < 5 and obs_class = 'OBS_SSH_SWATH'")
    l4 = sw.groupBy(F.floor(F.col("ts") / 432000).alias("win"), wide_j.alias("j"), wide_i.alias("i")).agg(F.avg("v").alias("y"), F.avg(F.coalesce("err", "sigma", F.lit(1.0))).alias("e"))
    l4 = materialize(l4, "product").withColumns({"lat": (F.col("j") + 0.5) * TEN - 90, "lon": (F.col("i") + 0.5) * TEN, "wide": F.col("j") * NT + F.col("i")})
    area = F.avg(F.cos(F.radians("lat")))
    span = l4.groupBy("win").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), (area * TEN * TEN).alias("area"))
    own = g.agg((area * CELL * CELL).alias("own"))  # one row
    cells = g.select((F.col("j") * NI + F.col("i")).alias("cell"), "lat", "lon")
    near = spatial.near_cells(cells, l4.select("wide", "lat", "lon").distinct(), 4000.0, "cell", "wide")  # geometry only: cells by wide cells
    nearest = near.join(l4.select("win", "wide", "y", "e"), "wide").groupBy("win", "cell").agg(F.min(F.struct("d", "wide", "y", "e")).alias("m")).select("win", "cell", F.col("m.y").alias("ny"), F.col("m.e").alias("ne"))
    fj, fi = (F.col("lat") + 90) / TEN - 0.5, F.col("lon") / TEN - 0.5
    part = lambda f, d: F.abs(1 - d - (f - F.floor(f)))
    corners = F.array(*[F.struct(((F.floor(fj) + dj) * NT + F.pmod(F.floor(fi) + di, F.lit(NT))).alias("wide"), (part(fj, dj) * part(fi, di)).alias("w")) for dj in (0, 1) for di in (0, 1)])
    asked = cells.select("cell", F.explode(corners).alias("c")).select("cell", "c.*")
    linear = asked.join(l4, "wide").groupBy("win", "cell").agg(F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.col("w") * F.col("e")).alias("e"), F.count("*").alias("n")).filter("n = 4").drop("n")
    v = nearest.join(linear, ["win", "cell"], "left").join(span, "win").join(F.broadcast(own))
    err = F.coalesce("e", "ne") * F.greatest(F.lit(1.0), F.col("area") / F.col("own"))
    y, e = gridded.guarded(F.coalesce("y", "ny"), err, F.col("lo"), F.col("hi"))
    return v.select("win", F.floor(F.col("cell") / NI).alias("j"), (F.col("cell") % NI).alias("i"), r6(y).alias("y"), F.when(e < 1e15, r6(e)).otherwise(e).alias("err"))


STEP, FINE, K_FILL, REACH = 0.8, 0.4, 4, 600.0


@query(f"""WITH {B_SQL}, s AS (SELECT * FROM b WHERE var_name = 'ssh'), x AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM s),
la AS (SELECT j, i, s + j * {STEP} AS lat, w + i * {STEP} AS lon FROM x, (SELECT unnest(generate_series(0, 400)) AS j), (SELECT unnest(generate_series(0, 400)) AS i) WHERE j <= floor((n - s) / {STEP} + 1e-9) AND i <= floor((e - w) / {STEP} + 1e-9)),
nd AS (SELECT node_id, min(lat) AS lat, min(lon) AS lon FROM s GROUP BY node_id), dv AS (SELECT node_id, CAST(floor(ts / 86400) AS BIGINT) AS k, avg(v) AS v FROM s GROUP BY ALL HAVING avg(v) IS NOT NULL),
lp AS (SELECT j, i, {_xyz('p')} FROM la), np AS (SELECT node_id, {_xyz('c')} FROM nd), pr AS (SELECT * FROM (SELECT j, i, node_id, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy) + (pz - cz) * (pz - cz)) AS d FROM lp, np) WHERE d <= {REACH}),
rk AS (SELECT k, j, i, d, v, row_number() OVER (PARTITION BY k, j, i ORDER BY d, node_id) AS rk FROM pr JOIN dv USING (node_id)),
fl AS (SELECT k, j, i, sum(v / pow(greatest(d, 1e-3), 2)) / sum(1 / pow(greatest(d, 1e-3), 2)) AS v FROM rk WHERE rk <= {K_FILL} GROUP BY k, j, i), z AS (SELECT min(k) AS k0, max(k) AS k1 FROM dv),
tg AS (SELECT k AS day, tj, ti, tj * {FINE} / {STEP} AS y, ti * {FINE} / {STEP} AS xx, greatest(least(k * 86400.0, (k1 + 0.5) * 86400 - 0.001), (k0 + 0.5) * 86400) / 86400 - 0.5 AS t FROM z, (SELECT unnest(generate_series(k0, k1)) AS k FROM z), x, (SELECT unnest(generate_series(0, 800)) AS tj), (SELECT unnest(generate_series(0, 800)) AS ti) WHERE tj <= floor((n - s) / {FINE} + 1e-9) AND ti <= floor((e - w) / {FINE} + 1e-9)),
a AS (SELECT day, tj, ti, CAST(floor(y) + dj AS BIGINT) AS j, CAST(floor(xx) + di AS BIGINT) AS i, CAST(floor(t) + dk AS BIGINT) AS k, abs(1 - dj - (y - floor(y))) * abs(1 - di - (xx - floor(xx))) * abs(1 - dk - (t - floor(t))) AS w FROM tg, (VALUES (0), (1)) b(dj), (VALUES (0), (1)) c(di), (VALUES (0), (1)) d(dk))
SELECT day, tj AS j, ti AS i, {q6('sum(w * v)')} AS v FROM a JOIN fl USING (k, j, i) WHERE w > 0 GROUP BY day, tj, ti HAVING abs(sum(w) - 1) < 1e-9""")
def boundary_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary fields on the model's grid at the start of each day: daily means of the nodes, filled on their lattice from the
    nearest given ones, then interpolated in space and time; before the first and after the last field these are held."""
    s = materialize(nodes(spark, sf_dir).filter("var_name = 'ssh'"), "boundary")
    at = s.groupBy("node_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    daily = materialize(s.groupBy("node_id", F.floor(F.col("ts") / 86400).alias("k")).agg(F.avg("v").alias("v")).filter("v is not null"), "daily")
    pack = (F.col("j") * 100000 + F.col("i")).alias("cell")
    filled = gridded.on_lattice(daily, at, grids.lonlat_grid(s, STEP).select(pack, "lat", "lon"), K_FILL, REACH, "k")
    ends = daily.agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    held = F.greatest(F.least(F.col("day") * 86400.0, (F.col("k1") + 0.5) * 86400 - 0.001), (F.col("k0") + 0.5) * 86400) / 86400 - 0.5
    asked = grids.lonlat_grid(s, FINE).select("j", "i").join(F.broadcast(ends)).withColumn("day", F.explode(F.sequence("k0", "k1"))).withColumn("t", held)  # one row
    y, x = F.col("j") * FINE / STEP, F.col("i") * FINE / STEP
    part = lambda f, d: F.abs(1 - d - (f - F.floor(f)))
    corners = F.array(*[F.struct(((F.floor(y) + dj) * 100000 + F.floor(x) + di).alias("cell"), (F.floor("t") + dk).alias("k"), (part(y, dj) * part(x, di) * part(F.col("t"), dk)).alias("w")) for dj in (0, 1) for di in (0, 1) for dk in (0, 1)])
    c = asked.select("day", "j", "i", F.explode(corners).alias("c")).select("day", "j", "i", "c.*").filter("w > 0")
    out = c.join(filled, ["cell", "k"]).groupBy("day", "j", "i").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.sum("w").alias("w")).filter(F.abs(F.col("w") - 1) < 1e-9)
    return out.select("day", "j", "i", r6("v").alias("v"))


@query(f"""{R_SQL}, k AS (SELECT *, CAST(floor(ts / 10800) AS BIGINT) AS window_no FROM r WHERE xac IS NOT NULL),
d AS (SELECT *, dense_rank() OVER (PARTITION BY sensor, window_no ORDER BY ts) - 1 AS ri, dense_rank() OVER (PARTITION BY sensor, window_no ORDER BY floor(xac / 10)) - 1 AS ci FROM k),
z AS (SELECT sensor, window_no, floor((max(ri) + 1) / 2) AS nr, floor((max(ci) + 1) / 2) AS nc FROM d GROUP BY ALL)
SELECT sensor, window_no, CAST(ri // 2 AS BIGINT) AS block_row, CAST(ci // 2 AS BIGINT) AS block_col, count(*) AS n, {q6('avg(v)')} AS v, {q6('avg(lat)')} AS lat, {q6('avg(xac)')} AS xac, {q6('avg(ts)', '1e3')} AS ts FROM d JOIN z USING (sensor, window_no) WHERE ri // 2 < nr AND ci // 2 < nc GROUP BY ALL""")
def block_mean_swath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over blocks of 2 x 2 along and across the track of each swath sensor's window, coordinates too."""
    r = readings(spark, sf_dir).filter("xac is not null").withColumn("window_no", F.floor(F.col("ts") / 10800))
    b = rowops.block_mean_2d(r, ["sensor", "window_no"], F.col("ts"), F.floor(F.col("xac") / 10), 2, ["v", "lat", "xac", "ts"])
    return b.withColumns({"v": r6("v"), "lat": r6("lat"), "xac": r6("xac"), "ts": r6("ts", 1e3)})


@query(f"""{R_SQL}, k AS (SELECT obs_id, t, row_number() OVER (ORDER BY t, obs_id) - 1 AS position FROM r WHERE lon BETWEEN 100 AND 260 AND lat BETWEEN -60 AND 60 AND v IS NOT NULL) SELECT position, obs_id, t FROM k""")
def get_obs_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a box in order of time, with their place in it: days are counted, each is put in order by itself."""
    r = readings(spark, sf_dir).filter("lon between 100 and 260 and lat between -60 and 60 and v is not null").select("obs_id", "t", "ts", F.lit(1).alias("all"))
    out = ranked(materialize(r, "box"), ["all"], F.floor(F.col("ts") / 3600), ["ts", "obs_id"])
    return out.select(F.col("rank").alias("position"), "obs_id", "t").orderBy("position")


@query(f"""{_AN}, mb AS (SELECT 'offset' AS basis, it, -1 AS iff, -1 AS pj, -1 AS pi, -1 AS itheta, -1 AS phase, sum(wt * y) AS x FROM fd JOIN gt USING (day) GROUP BY it UNION ALL SELECT 'wave', it, iff, pj, pi, itheta, phase, x FROM an)
SELECT basis, it, iff, pj, pi, itheta, phase, {q6('x', '1e4')} AS x FROM mb""")
def basis_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis by two bases at once: one control vector, each part under the name of its basis; what a basis has not is -1."""
    r = shared(spark, sf_dir)
    _, gt_, x, d = _analysis(r)
    wave = x.select(F.lit("wave").alias("basis"), "it", *[F.col(c).cast("long").alias(c) for c in ("iff", "pj", "pi", "itheta")], F.col("phase").cast("int").alias("phase"), "x")
    offset = d.join(gt_, "day").groupBy("it").agg(F.sum(F.col("wt") * F.col("y")).alias("x"))
    none = {c: F.lit(-1).cast(t) for c, t in wave.dtypes if c not in ("basis", "it", "x")}
    return wave.unionByName(offset.withColumn("basis", F.lit("offset")).withColumns(none)).withColumn("x", r6("x", 1e4))


@query(f"""{_AN}, mb AS (SELECT 'offset' AS basis, count(DISTINCT it) AS n FROM gt UNION ALL SELECT 'wave', count(*) FROM an) SELECT basis, n, coalesce(CAST(sum(n) OVER (ORDER BY basis ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM mb""")
def basis_multi_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each basis in the joint control vector and where its slice starts."""
    from pyspark.sql import Window as W

    n = basis_multi(spark, sf_dir).groupBy("basis").agg(F.count("*").alias("n"))  # a row a basis
    start = F.sum("n").over(W.orderBy("basis").rowsBetween(W.unboundedPreceding, -1))
    return n.select("basis", "n", F.coalesce(start, F.lit(0)).alias("start"))


@query(f"""{_X}, uv AS (SELECT j, i, lat, -9.81 / ({_F}) * (n - s) / (2 * {_DY}) AS u, 9.81 / ({_F}) * (e - w) / (2 * {_DX}) AS v FROM st WHERE n IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND w IS NOT NULL)
SELECT c.j, c.i, {q6(f"((coalesce((e.v - w.v) / 2, e.v - c.v, c.v - w.v)) / ({_DX.replace('lat', 'c.lat')}) - (coalesce((n.u - s.u) / 2, n.u - c.u, c.u - s.u)) / ({_DY})) / ({_F.replace('lat', 'c.lat')})", '1e6')} AS rv
FROM uv c LEFT JOIN uv n ON n.j = c.j + 1 AND n.i = c.i LEFT JOIN uv s ON s.j = c.j - 1 AND s.i = c.i LEFT JOIN uv e ON e.j = c.j AND e.i = (c.i + 1) % {NI} LEFT JOIN uv w ON w.j = c.j AND w.i = (c.i + {NI} - 1) % {NI}""")
def vorticity_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative vorticity of the map's geostrophic currents from u and v, divided by the Coriolis parameter."""
    u, v = stencils.geostrophic(F.col("h"), F.col("lat"), CELL)
    g = _sten(readings(spark, sf_dir), stencils.CROSS).select("j", "i", u.alias("u"), v.alias("v")).filter("u is not null and v is not null")
    lat = (F.col("j") + 0.5) * CELL - 90
    rv = gridded.gradient_vorticity(g, "u", "v", stencils.spacing(lat, CELL), NI)
    return rv.select("j", "i", r6(F.col("rv") / scalars.coriolis(lat), 1e6).alias("rv"))


@query(f"""{R_SQL}, k AS (SELECT sensor, lon, lat, ts / 86400 AS d, v FROM r WHERE abs(v) < 5), m AS (SELECT sensor, var_pop(lon) AS xx, var_pop(lat) AS yy, var_pop(d) AS tt, covar_pop(lon, lat) AS xy, covar_pop(lon, d) AS xt, covar_pop(lat, d) AS yt, covar_pop(lon, v) AS xz, covar_pop(lat, v) AS yz, covar_pop(d, v) AS tz, count(*) AS n FROM k GROUP BY sensor),
w AS (SELECT *, xx * (yy * tt - yt * yt) - xy * (xy * tt - yt * xt) + xt * (xy * yt - yy * xt) AS det FROM m)
SELECT sensor, {q6('(xz * (yy * tt - yt * yt) - xy * (yz * tt - yt * tz) + xt * (yz * yt - yy * tz)) / det', '1e7')} AS a, {q6('(xx * (yz * tt - yt * tz) - xz * (xy * tt - yt * xt) + xt * (xy * tz - yz * xt)) / det', '1e7')} AS b, {q6('(xx * (yy * tz - yz * yt) - xy * (xy * tz - yz * xt) + xz * (xy * yt - yy * xt)) / det', '1e7')} AS c, n FROM w WHERE det > 1e-9 * xx * yy * tt""")
def detrend_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of each sensor's values along longitude, latitude and time at once."""
    r = readings(spark, sf_dir).filter(F.abs("v") < 5).withColumn("d", F.col("ts") / 86400)
    f = stats.plane_fit_3d(r, ["sensor"], ("lon", "lat", "d"), "v").filter("a is not null")
    return f.select("sensor", *[r6(c, 1e7).alias(c) for c in "abc"], "n")


TILE = 12
_HX = f"(0.5 - 0.5 * cos(2 * pi() * (x + 1) / {TILE + 1}))"
_NORM = sum((0.5 - 0.5 * math.cos(2 * math.pi * (x + 1) / (TILE + 1))) ** 2 for x in range(TILE)) ** 2


@query(f"""{R_SQL}, fd AS (SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, CAST(least(floor((lat + 90) / {CELL}), {NJ - 1}) AS BIGINT) AS j, CAST(floor(lon / {CELL}) AS BIGINT) AS i, avg(v) AS y FROM r WHERE abs(v) < 5 GROUP BY ALL),
t AS (SELECT day, j // {TILE} AS tj, i // {TILE} AS ti, j % {TILE} AS y, i % {TILE} AS x, y AS h FROM fd), c AS (SELECT day, tj, ti, y, x, (h - avg(h) OVER (PARTITION BY day, tj, ti)) * {_HX} * {_HX.replace('x + 1', 'y + 1')} AS h FROM t),
w AS (SELECT unnest(generate_series(0, {TILE - 1})) AS k), d AS (SELECT day, tj, ti, kx.k AS kx, ky.k AS ky, sum(h * cos(2 * pi() * (kx.k * x + ky.k * y) / {TILE})) AS re, sum(h * sin(2 * pi() * (kx.k * x + ky.k * y) / {TILE})) AS im FROM c, w kx, w ky GROUP BY ALL),
p AS (SELECT day, tj, ti, CAST(floor(sqrt(pow(CASE WHEN kx > {TILE // 2} THEN kx - {TILE} ELSE kx END, 2) + pow(CASE WHEN ky > {TILE // 2} THEN ky - {TILE} ELSE ky END, 2)) + 0.5 + 1e-9) AS BIGINT) AS ring, (re * re + im * im) * {CELL * CELL / _NORM!r} AS p FROM d)
SELECT day, tj, ti, ring, {q6('avg(p)')} AS psd FROM p WHERE ring BETWEEN 1 AND {TILE // 2} GROUP BY ALL""")
def psd2d_isotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional spectrum of each tile of 12 x 12 cells and day, averaged over rings of wavenumber."""
    p = gridded.isotropic_spectra(_daily(readings(spark, sf_dir)), ["day"], "y", TILE, CELL)
    return p.withColumn("psd", r6("psd"))
