"""Sparse operators, windows and statistics: adjoints by dot products, analytic solutions, brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import basis, blend, fill, segments, spatial, stats, windows

RNG = np.random.default_rng(5)


def test_matvec_and_transpose_by_dot_product(spark):
    pts = spark.createDataFrame([(k, float(RNG.uniform(0, 2)), float(RNG.uniform(0, 2)), float(RNG.standard_normal())) for k in range(60)], "obs_id long, lat double, lon double, y double")
    cells = spark.createDataFrame([(k, float(k // 5) / 2, float(k % 5) / 2, float(RNG.standard_normal())) for k in range(25)], "cell_id long, lat double, lon double, x double")
    h = spatial.knn_weights(pts, cells, 4, 120.0)
    assert h.groupBy("obs_id").agg(F.sum("w").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    a = spatial.matvec(h, cells, "obs_id", "cell_id", "x", "hx").join(pts, "obs_id").agg(F.sum(F.col("hx") * F.col("y"))).first()[0]
    b = spatial.matvec(h, pts, "cell_id", "obs_id", "y", "hty").join(cells, "cell_id").agg(F.sum(F.col("hty") * F.col("x"))).first()[0]
    assert a == pytest.approx(b)


def test_basis_transpose_by_dot_product(spark):
    cells = spark.createDataFrame([(j, i, j * 5.0 - 10, i * 5.0) for j in range(5) for i in range(5)], "j long, i long, lat double, lon double").withColumn("lat", (F.col("j") + 0.5) * 5 - 90).withColumn("lon", (F.col("i") + 0.5) * 5)
    days = spark.range(0, 8).select(F.col("id").alias("day"))
    y = days.crossJoin(cells).withColumn("y", F.sin(F.col("day") + F.col("j") * 2.0 + F.col("i"))).select("day", "j", "i", "y")
    gx, gt = basis.gx(basis.centres(cells, 5.0, [1500.0]), cells, 5.0, 2), basis.gt(days, 5.0)
    x = basis.analysis(gx, gt, y, "y")
    back = basis.synthesis(gx, gt, x).join(y, ["day", "j", "i"]).agg(F.sum(F.col("value") * F.col("y"))).first()[0]
    assert back == pytest.approx(x.agg(F.sum(F.col("x") * F.col("x"))).first()[0])


def test_bilinear_is_exact_for_a_plane(spark):
    grid = spark.createDataFrame([(j, i, 2.0 * j + 3 * i) for j in range(36) for i in range(72)], "j long, i long, h double")
    pts = spark.createDataFrame([(1, 12.0, 100.0), (2, -33.3, 222.2)], "obs_id long, lat double, lon double")
    got = {r.obs_id: r.value for r in spatial.interpolate(pts, grid, 5.0, "h").collect()}
    assert got[1] == pytest.approx(2 * (102 / 5 - 0.5) + 3 * (100 / 5 - 0.5)) and got[2] == pytest.approx(2 * (56.7 / 5 - 0.5) + 3 * (222.2 / 5 - 0.5))


def test_spectrum_of_a_wave_peaks_at_its_number(spark):
    x = [float(np.cos(2 * np.pi * 3 * k / 16)) for k in range(16)]
    p = segments.welch(spark.createDataFrame([("a", x)], "k string, v array<double>"), {"k": "string"}, ["v"], 1.0).first().v
    assert int(np.argmax(p)) == 3


def test_sessions_of_one_dense_source(spark):
    t = np.cumsum(RNG.choice([1.0, 2.0, 50.0], 3000, p=[0.5, 0.45, 0.05]))
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(t)], "source string, id long, ts double")
    got = sorted((r.id, r.seg, r.pos) for r in segments.sessions(df, "source", "ts", "id", 10.0, block=100, bin_s=60).collect())
    seg = np.r_[0, np.cumsum(np.diff(t) > 10)]
    assert [g[1] for g in got] == seg.tolist()
    assert all(a[2] + 1 == b[2] for a, b in zip(got, got[1:]) if a[1] == b[1])


def test_lerp_holds_the_ends(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 20.0)], "k string, ts double, v double")
    t = spark.createDataFrame([("a", -5.0), ("a", 5.0), ("a", 10.0), ("a", 99.0), ("b", 1.0)], "k string, ts double")
    got = {(r.k, r.ts): r.v for r in windows.lerp_in_time(t, s, ["k"], "v").collect()}
    assert got == {("a", -5.0): 0.0, ("a", 5.0): 10.0, ("a", 10.0): 20.0, ("a", 99.0): 20.0, ("b", 1.0): None}


def test_plane_fit_recovers_the_plane(spark):
    df = spark.createDataFrame([("s", float(x), float(y), 2.0 * x - y + 7) for x in range(5) for y in range(4)] + [("flat", 1.0, 1.0, 1.0)], "k string, x double, y double, z double")
    got = {r.k: r for r in stats.plane_fit(df, ["k"], "x", "y", "z").collect()}
    assert (got["s"].a, got["s"].b, got["s"].c) == pytest.approx((2, -1, 7)) and got["flat"].a is None


def test_half_a_step_keeps_every_reading(spark):
    df = spark.createDataFrame([(1, 900.0), (2, 1250.0), (3, 1349.0), (4, 1350.0), (5, 1351.0)], "obs_id long, ts double")
    got = {r.obs_id: (r.step, r.lag_s) for r in windows.nearest_step(df, 900.0, 0.0, 450.0).collect()}
    assert got == {1: (1, 0.0), 2: (1, 350.0), 3: (1, 449.0), 4: (1, 450.0), 5: (2, -449.0)}


@pytest.mark.parametrize("name", ["asof_half_step", "checkpoint_half_step"])
def test_steps_beyond_300_s_are_kept(spark, name):
    from compare import DATA

    from tidemill import plans

    q = plans.registry()[0]
    narrow = {"asof_half_step": "asof_nearest_step", "checkpoint_half_step": "checkpoint_schedule"}[name]
    got, less = q[name](spark, DATA), q[narrow](spark, DATA)
    assert got.join(less, got.columns, "left_semi").count() == less.count() < got.count()
    if name == "asof_half_step":
        assert got.count() == plans.joins.readings(spark, DATA).count()


def test_nearest_sample_at_any_distance(spark):
    times = {"a": [0.0, 100.0, 110.0, 50000.0], "b": [7e5], "c": []}
    s = spark.createDataFrame([(k, t, t + 1) for k in times for t in times[k]] + [("a", 120.0, None), ("a", 100.0, 900.0)], "k string, ts double, v double")
    at = [-1e6, -5.0, 50.0, 51.0, 105.0, 106.0, 25000.0, 25055.0, 25056.0, 49999.0, 3e5, 7e5, 1e7]
    got = sorted((r.k, r.ts, r.near_t, r.near_v) for r in windows.nearest_sample(spark.createDataFrame([(k, t) for k in times for t in at], "k string, ts double"), s, ["k"], "ts", "ts", "v", 600.0).collect())
    want = [(k, t, n, n + 1) for k in "ab" for t in at for n in [min(times[k], key=lambda x: (abs(x - t), x))]]
    assert got == sorted(want)




def test_windows_of_long_histories_against_brute_force(spark):
    t = np.cumsum(RNG.integers(1, 4000, 400)).astype(float)
    v = [None if x < 0.4 else float(x) for x in RNG.random(400)]
    df = spark.createDataFrame([("a", k, a, b) for k, (a, b) in enumerate(zip(t.tolist(), v))] + [("none", 900, 1.0, None)], "k string, id long, ts double, v double")
    got = {r.id: r.nearest for r in fill.nearest_in_time(df, "k", "ts", "id", "v", width=5000.0).collect()}
    given = [(a, b) for a, b in zip(t, v) if b is not None]
    assert got == {**{k: min(given, key=lambda g: (abs(g[0] - a), g[0]))[1] for k, a in enumerate(t)}, 900: None}


def test_exact_median(spark):
    x = [float(y) for y in np.round(RNG.standard_normal(501), 2)]
    df = spark.createDataFrame([("a", y) for y in x] + [("b", y) for y in x[:100]] + [("c", 1.0), ("d", None)] + [("e", 2.0)] * 50, "k string, x double")
    got = {r.k: r.median for r in stats.exact_median(df, ["k"], "x").collect()}
    assert got == pytest.approx({"a": float(np.median(x)), "b": float(np.median(x[:100])), "c": 1.0, "e": 2.0})


def test_handed_on_state(spark):
    days = sorted({int(d) for d in RNG.integers(0, 900, 300)})
    h = RNG.standard_normal(len(days)).tolist()
    got = {r.d: r.state for r in blend.handed_on(spark.createDataFrame([("a", d, x) for d, x in zip(days, h)], "k string, d long, h double"), ["k"], "d", "h", 0.7, 0.3).collect()}
    state, last = 0.0, days[0]
    for d, x in zip(days, h):
        state, last = 0.3 * x + 0.7 ** (d - last) * state, d
        assert got[d] == pytest.approx(state, abs=1e-9)


def test_distances_across_blocks(spark):
    t = np.cumsum(RNG.choice([1.0, 50.0], 1000, p=[0.98, 0.02]))
    df = spark.createDataFrame([("s", k, float(x), k / 1000, 0.0) for k, x in enumerate(t)], "source string, id long, ts double, lat double, lon double")
    track = segments.sessions(df, "source", "ts", "id", 10.0, block=64, bin_s=60)
    got = sorted((r.id, r.d, r.run) for r in segments.distances(track, "source", lambda a, b, c, d: c - a, block=64).collect())
    run = 0.0
    for k, (i, d, r) in enumerate(got):
        begins = k == 0 or t[k] - t[k - 1] > 10
        run = 0.0 if begins else run + 0.001
        assert i == k and (d is None) == begins and r == pytest.approx(run, abs=1e-9)


def test_multiquadric_reproduces_the_sources(spark):
    src = spark.createDataFrame([(k, float(k % 5) / 5, float(k // 5) / 5, float(k)) for k in range(25)], "obs_id long, lat double, lon double, v double")
    at = spark.createDataFrame([(7, 2 / 5, 1 / 5), (12, 2 / 5, 2 / 5)], "cell_id long, lat double, lon double")
    got = {r.cell_id: r.v for r in fill.multiquadric(src, at, 11, 600.0, "v", "obs_id", "cell_id").collect()}
    assert got == {7: pytest.approx(7.0, abs=1e-6), 12: pytest.approx(12.0, abs=1e-6)}


def test_wavelets_cross_the_zero_meridian(spark):
    cells = spark.createDataFrame([(18, i) for i in (71, 0, 1, 40)], "j long, i long").withColumn("lat", (F.col("j") + 0.5) * 5 - 90).withColumn("lon", (F.col("i") + 0.5) * 5)
    gx = basis.gx(spark.createDataFrame([(0, 0, 0, 0.0, 1.0, 1500.0)], "iff int, pj long, pi long, lat0 double, lon0 double, half double"), cells, 5.0, 1)
    assert {r.i for r in gx.collect()} == {71, 0, 1}
