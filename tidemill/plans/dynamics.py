"""Stencils, schemes, bases, grids and the numeric kernels of sub-windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import scalars
from tidemill.operators import basis, grids, stencils
from tidemill.plans.base import B_SQL, CELL, G_SQL, NI, NJ, R_SQL, Registry, field, nodes, q6, r6, readings, shared
from tidemill.plans.joins import WIDE, _GW, _wide
from tidemill.sources.tables import materialize

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _sten(r: DataFrame, offsets: dict) -> DataFrame:
    s = stencils.neighbours(field(r), "h", offsets, NI)
    return s.withColumn("lat", (F.col("j") + 0.5) * CELL - 90)


def _joins(offsets: dict) -> str:
    names = {n: f"x{k}" for k, n in enumerate(offsets)}
    cols = ", ".join(f"{a}.h AS {n}" for n, a in names.items())
    joins = " ".join(f"LEFT JOIN g {a} ON {a}.j = g.j + ({dj}) AND {a}.i = (g.i + ({di}) + {NI}) % {NI}" for (n, (dj, di)), a in zip(offsets.items(), names.values()))
    return f"{G_SQL}, st AS (SELECT g.j, g.i, g.lat, g.h, {cols} FROM g {joins})"


_X = _joins(stencils.CROSS)
_DX, _DY = f"({CELL} * 111000.0 * cos(radians(lat)))", f"({CELL} * 111000.0)"
_LAP = f"((e - 2 * h + w) / pow({_DX}, 2) + (n - 2 * h + s) / pow({_DY}, 2))"
_F = scalars.SQL["coriolis"]


@query(f"{_X} SELECT j, i, {q6(f'-9.81 / ({_F}) * (n - s) / (2 * {_DY})')} AS u, {q6(f'9.81 / ({_F}) * (e - w) / (2 * {_DX})')} AS v FROM st")
def geostrophic_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = stencils.geostrophic(F.col("h"), F.col("lat"), CELL)
    return _sten(readings(spark, sf_dir), stencils.CROSS).select("j", "i", r6(u).alias("u"), r6(v).alias("v"))


@query(f"{_X} SELECT j, i, {q6(f'9.81 / ({_F}) * {_LAP}', '1e12')} AS zeta FROM st")
def relative_vorticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = scalars.GRAVITY / scalars.coriolis(F.col("lat")) * stencils.laplacian(F.col("h"), F.col("lat"), CELL)
    return _sten(readings(spark, sf_dir), stencils.CROSS).select("j", "i", r6(z, 1e12).alias("zeta"))


@query(f"{_X} SELECT j, i, {q6(f'9.81 / ({_F}) * {_LAP} - 9.81 * ({_F}) / pow(2.7, 2) * h', '1e10')} AS pv FROM st")
def qg_pv(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = stencils.potential_vorticity(F.col("h"), F.col("lat"), CELL, 2.7)
    return _sten(readings(spark, sf_dir), stencils.CROSS).select("j", "i", r6(pv, 1e10).alias("pv"))


@query(f"{_X} SELECT j, i, {q6('h + 0.1 * (coalesce(n, h) + coalesce(s, h) + coalesce(e, h) + coalesce(w, h) - 4 * h)')} AS h FROM st")
def diffusion_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One explicit step; a missing neighbour lets nothing through."""
    s = _sten(readings(spark, sf_dir), stencils.CROSS)
    flow = sum((F.coalesce(F.col(c), F.col("h")) for c in "nsew"), F.lit(0.0)) - 4 * F.col("h")
    return s.select("j", "i", r6(F.col("h") + 0.1 * flow).alias("h"))


_UP = {"w": (0, -1), "ww": (0, -2), "e": (0, 1)}


@query(f"{_joins(_UP)} SELECT j, i, {q6(f'h + 86400 * (-0.5 * (2 * e + 3 * h - 6 * w + ww) / (6 * {_DX}))')} AS h FROM st WHERE e IS NOT NULL AND w IS NOT NULL AND ww IS NOT NULL")
def upwind3_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of eastward drift of 0.5 m/s."""
    s = _sten(readings(spark, sf_dir), _UP)
    out = F.col("h") + 86400 * stencils.upwind3(F.col("h"), 0.5, stencils.spacing(F.col("lat"), CELL)[0])
    return s.select("j", "i", r6(out).alias("h")).filter("h is not null")


_W5 = {"ww": (0, -2), "w": (0, -1), "e": (0, 1), "ee": (0, 2)}
_B0, _B1, _B2 = "(13.0 / 12 * pow(ww - 2 * w + h, 2) + pow(ww - 4 * w + 3 * h, 2) / 4)", "(13.0 / 12 * pow(w - 2 * h + e, 2) + pow(w - e, 2) / 4)", "(13.0 / 12 * pow(h - 2 * e + ee, 2) + pow(3 * h - 4 * e + ee, 2) / 4)"
_WA = [f"({g} / pow(1e-8 + {b}, 2))" for g, b in (("0.1", _B0), ("0.6", _B1), ("0.3", _B2))]


@query(f"{_joins(_W5)} SELECT j, i, {q6(f'({_WA[0]} * (2 * ww - 7 * w + 11 * h) / 6 + {_WA[1]} * (-w + 5 * h + 2 * e) / 6 + {_WA[2]} * (2 * h + 5 * e - ee) / 6) / ({_WA[0]} + {_WA[1]} + {_WA[2]})', '1e5')} AS face FROM st WHERE ww IS NOT NULL AND w IS NOT NULL AND e IS NOT NULL AND ee IS NOT NULL")
def weno_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value at the eastern face of each cell for an eastward wind."""
    s = _sten(readings(spark, sf_dir), _W5)
    face = stencils.weno5(*[F.col(c) for c in ("ww", "w", "h", "e", "ee")])
    return s.select("j", "i", r6(face, 1e5).alias("face")).filter("face is not null")


_P9 = {f"p{a}{b}": (a - 1, b - 1) for a in range(3) for b in range(3) if (a, b) != (1, 1)}
_P9S = " + ".join(f"coalesce({n}, 0)" for n in _P9)
_P9N = " + ".join(f"({n} IS NOT NULL)::INT" for n in _P9)


@query(f"{_joins(_P9)} SELECT j, i, {q6(f'(h + {_P9S}) / (1 + {_P9N})')} AS pooled, 1 + {_P9N} AS n FROM st")
def avg_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the cells present in each 3 x 3 window."""
    s = _sten(readings(spark, sf_dir), _P9)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in _P9), F.col("h"))
    n = sum((F.col(c).isNotNull().cast("int") for c in _P9), F.lit(1))
    return s.select("j", "i", r6(total / n).alias("pooled"), n.alias("n"))


_EN = {"e": (0, 1), "n": (1, 0)}


@query(f"{_joins(_EN)} SELECT j, i, {q6('(h + e) / 2')} AS hu, {q6('(h + n) / 2')} AS hv FROM st")
def cgrid_averaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-point means of the map on the faces of its cells."""
    s = _sten(readings(spark, sf_dir), _EN)
    return s.select("j", "i", r6((F.col("h") + F.col("e")) / 2).alias("hu"), r6((F.col("h") + F.col("n")) / 2).alias("hv"))


@query(f"{R_SQL}, {_GW} SELECT a.k, a.j, a.i, {q6('a.h + 0.1 * (b.h - 2 * a.h + c.h)')} AS h FROM gw a JOIN gw b ON b.k = a.k - 1 AND b.j = a.j AND b.i = a.i JOIN gw c ON c.k = a.k + 1 AND c.j = a.j AND c.i = a.i")
def asselin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time filter of the daily maps where the days before and after are there."""
    by = W.partitionBy("j", "i").orderBy("k")  # days of one cell
    g = _wide(readings(spark, sf_dir)).withColumns({"b": F.lag("h").over(by), "kb": F.lag("k").over(by), "c": F.lead("h").over(by), "kc": F.lead("k").over(by)})
    g = g.filter((F.col("kb") == F.col("k") - 1) & (F.col("kc") == F.col("k") + 1))
    return g.select("k", "j", "i", r6(stencils.asselin(F.col("b"), F.col("h"), F.col("c"))).alias("h"))


_GRID = f"""WITH {B_SQL}, x AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM b), a AS (SELECT unnest(generate_series(0, CAST(floor((e - w) / 0.4 + 1e-9) AS BIGINT))) AS i FROM x), c AS (SELECT unnest(generate_series(0, CAST(floor((n - s) / 0.4 + 1e-9) AS BIGINT))) AS j FROM x),
gg AS (SELECT j, i, w + i * 0.4 AS lon, s + j * 0.4 AS lat FROM a, c, x)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.lonlat_grid(nodes(spark, sf_dir), 0.4)


@query(f"{_GRID} SELECT j, i, {q6('lon')} AS lon, {q6('lat')} AS lat, {q6(_F, '1e12')} AS f FROM gg")
def grid_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular grid over the extent of the boundary nodes, with the Coriolis parameter."""
    return _grid(spark, sf_dir).select("j", "i", r6("lon").alias("lon"), r6("lat").alias("lat"), r6(scalars.coriolis(F.col("lat")), 1e12).alias("f"))


@query(f"{_GRID} SELECT j, i, {q6('0.4 * 111000.0 * cos(radians(lat))', '1e2')} AS dx, {q6('0.4 * 111000.0', '1e2')} AS dy, {q6('i * 0.4 * 111000.0 * cos(radians(lat))', '1e2')} AS x, {q6('j * 0.4 * 111000.0', '1e2')} AS y FROM gg")
def grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of the grid in metres and the distance run from its western and southern edges."""
    dx, dy = stencils.spacing(F.col("lat"), 0.4)
    return _grid(spark, sf_dir).select("j", "i", r6(dx, 1e2).alias("dx"), r6(dy, 1e2).alias("dy"), r6(F.col("i") * dx, 1e2).alias("x"), r6(F.col("j") * dy, 1e2).alias("y"))


@query(f"{_GRID} SELECT stagger, j, i, {q6('lon + 0.2 * dx')} AS lon, {q6('lat + 0.2 * dy')} AS lat FROM gg, (VALUES ('h', 0, 0), ('u', 1, 0), ('v', 0, 1)) s(stagger, dx, dy)")
def grid_stagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the staggered grid: cells, eastern and northern faces."""
    kinds = F.array(*[F.struct(F.lit(n).alias("stagger"), F.lit(x).alias("sx"), F.lit(y).alias("sy")) for n, x, y in (("h", 0.0, 0.0), ("u", 0.2, 0.0), ("v", 0.0, 0.2))])
    g = _grid(spark, sf_dir).withColumn("s", F.explode(kinds))
    return g.select("s.stagger", "j", "i", r6(F.col("lon") + F.col("s.sx")).alias("lon"), r6(F.col("lat") + F.col("s.sy")).alias("lat"))


_CAR = "floor(50 * {a} / 1e9 + 1e-9)"


@query(f"""WITH {B_SQL}, x AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM b), c AS (SELECT unnest(generate_series(0, CAST(floor((n - s) * 111.32 / 50 + 1e-9) AS BIGINT))) AS j FROM x),
l AS (SELECT j, s + j * 50 / 111.32 AS lat FROM c, x), k AS (SELECT j, lat, unnest(generate_series(0, CAST(floor((e - w) * 111.32 * cos(radians(lat)) / 50 + 1e-9) AS BIGINT))) AS i FROM l, x)
SELECT j, i, {q6('lat')} AS lat, {q6('w + i * 50 / (111.32 * cos(radians(lat)))')} AS lon FROM k, x""")
def grid_car(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid of equal spacing in km over the extent of the boundary nodes: fewer columns towards the pole."""
    return grids.km_grid(nodes(spark, sf_dir), 50.0).select("j", "i", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query(f"{R_SQL} SELECT obs_id, {q6(f'sqrt((pow(2 * pi() / (12.4206012 * 3600), 2) - pow({_F}, 2)) / (9.81 * 0.9))', '1e10')} AS k FROM r WHERE pow(2 * pi() / (12.4206012 * 3600), 2) - pow({_F}, 2) >= 0")
def tide_wave_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wave number of the M2 internal tide, of 0.9 m equivalent depth, at the readings equatorward of its critical latitude."""
    k = stencils.plane_wave_number(F.col("lat"), "M2", 0.9)
    return readings(spark, sf_dir).select("obs_id", r6(k, 1e10).alias("k")).filter("k is not null")


LADDER = basis.scales(4000.0, 2000.0, 2.0)
DECAY, N_THETA = 5.0, 2
_LAD = ", ".join(f"({n}, CAST({lam} AS DOUBLE))" for n, lam in enumerate(LADDER))
_C = f"""{G_SQL}, ce AS (SELECT *, pj * step AS lat0, pi * step AS lon0 FROM (SELECT DISTINCT iff, lam AS half, lam / 110.0 / 2 AS step, CAST(floor(lat / (lam / 110.0 / 2) + 0.5) AS BIGINT) AS pj, CAST(floor(lon / (lam / 110.0 / 2) + 0.5) AS BIGINT) AS pi FROM g, (VALUES {_LAD}) l(iff, lam)) WHERE abs(pj * step) <= 85)"""
_GX = f"""{_C}, gx0 AS (SELECT iff, pj, pi, half, j, i, (lon - lon0 + 540 - 360 * floor((lon - lon0 + 540) / 360) - 180) * 110.0 * cos(radians(lat0)) AS x, (lat - lat0) * 110.0 AS y FROM ce, g),
gx AS (SELECT iff, pj, pi, itheta, phase, j, i, sqrt(2) * pow(cos(pi() / 2 * x / half), 2) * pow(cos(pi() / 2 * y / half), 2) * CASE WHEN phase = 0 THEN cos(2 * pi() / half * (cos(itheta * pi() / {N_THETA}) * x + sin(itheta * pi() / {N_THETA}) * y)) ELSE sin(2 * pi() / half * (cos(itheta * pi() / {N_THETA}) * x + sin(itheta * pi() / {N_THETA}) * y)) END AS w
  FROM gx0, (SELECT unnest(generate_series(0, {N_THETA - 1})) AS itheta) a, (VALUES (0), (1)) q(phase) WHERE abs(x) <= half AND abs(y) <= half)"""
_FD = f"""fd AS (SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, CAST(least(floor((lat + 90) / {CELL}), {NJ - 1}) AS BIGINT) AS j, CAST(floor(lon / {CELL}) AS BIGINT) AS i, avg(v) AS y FROM r WHERE abs(v) < 5 GROUP BY ALL),
gt AS (SELECT day, it, pow(cos(pi() / 2 * (day - it * {DECAY}) / {DECAY}), 2) AS wt FROM (SELECT day, unnest([CAST(floor(day / {DECAY}) AS BIGINT), CAST(floor(day / {DECAY}) AS BIGINT) + 1]) AS it FROM (SELECT DISTINCT day FROM fd)))"""


def _daily(r: DataFrame) -> DataFrame:
    j = F.least(F.floor((F.col("lat") + 90) / CELL), F.lit(NJ - 1))
    return r.filter(F.abs("v") < 5).groupBy(F.floor(F.col("ts") / 86400).alias("day"), j.alias("j"), F.floor(F.col("lon") / CELL).alias("i")).agg(F.avg("v").alias("y"))


def _gx(r: DataFrame) -> DataFrame:
    cells = materialize(field(r), "cells")
    return basis.gx(basis.centres(cells, CELL, LADDER), cells, CELL, N_THETA)


@query(f"{_C} SELECT iff, pj, pi, {q6('lat0')} AS lat0, {q6('lon0')} AS lon0 FROM ce")
def wavelet_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basis.centres(field(readings(spark, sf_dir)), CELL, LADDER).select("iff", "pj", "pi", r6("lat0").alias("lat0"), r6("lon0").alias("lon0"))


@query(f"{_C} SELECT iff, pj, pi, {q6('0.1 * pow(least(half / 3000.0, 1), 2.5)')} AS q, {q6('greatest(10.0 * pow(least(half / 3000.0, 1), 1.2), 1.0)')} AS tdec FROM ce")
def q_tdec_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = basis.spectral_laws(basis.centres(field(readings(spark, sf_dir)), CELL, LADDER), 3000.0, 0.1, 2.5, 10.0, 1.2, 1.0)
    return w.select("iff", "pj", "pi", r6("q").alias("q"), r6("tdec").alias("tdec"))


@query(f"{_GX} SELECT iff, pj, pi, itheta, phase, count(*) AS n, {q6('sum(w)', '1e4')} AS sum_w, {q6('sum(w * w)', '1e4')} AS sum_w2 FROM gx GROUP BY ALL")
def gx_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the space factor, summed by wavelet."""
    return _gx(readings(spark, sf_dir)).groupBy("iff", "pj", "pi", F.col("itheta").cast("long").alias("itheta"), "phase").agg(F.count("*").alias("n"), r6(F.sum("w"), 1e4).alias("sum_w"), r6(F.sum(F.col("w") ** 2), 1e4).alias("sum_w2"))


@query(f"{R_SQL}, {_FD} SELECT day, it, {q6('wt')} AS wt FROM gt")
def gt_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basis.gt(_daily(readings(spark, sf_dir)).select("day").distinct(), DECAY).select("day", "it", r6("wt").alias("wt"))


_AN = f"{_GX}, {_FD}, an AS (SELECT iff, pj, pi, itheta, phase, it, sum(w * s) AS x FROM (SELECT it, j, i, sum(wt * y) AS s FROM fd JOIN gt USING (day) GROUP BY ALL) JOIN gx USING (j, i) GROUP BY ALL)"


def _analysis(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(gx, gt, control vector, daily map) of readings ``r``, which should be a table."""
    d = materialize(_daily(r), "daily")
    gt_, gx_ = basis.gt(d.select("day").distinct(), DECAY), _gx(r)
    return gx_, gt_, basis.analysis(gx_, gt_, d, "y"), d


@query(f"{_AN} SELECT iff, pj, pi, itheta, phase, it, {q6('x', '1e4')} AS x FROM an")
def basis_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(shared(spark, sf_dir))[2].withColumn("itheta", F.col("itheta").cast("long")).withColumn("x", r6("x", 1e4))


@query(f"{_AN}, sy AS (SELECT day, j, i, sum(w * s) AS value FROM (SELECT iff, pj, pi, itheta, phase, day, sum(wt * x) AS s FROM an JOIN gt USING (it) GROUP BY ALL) JOIN gx USING (iff, pj, pi, itheta, phase) GROUP BY ALL) SELECT day, j, i, {q6('value', '1e2')} AS value FROM sy")
def basis_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field that the analysed control vector makes."""
    gx_, gt_, x, _ = _analysis(shared(spark, sf_dir))
    return basis.synthesis(gx_, gt_, x).withColumn("value", r6("value", 1e2))
