"""The numbered problems of the core against brute force, and their defined results on odd input."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tidemill.operators import blocks, compaction, proximity, regrid, spikes

T0 = dt.datetime(1993, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def test_series_marks_gaps_and_fits_lines(spark):
    rows = [("a", at(t), 2.0 + t / 10800, 10.0, 359.9 + 0.02 * t / 10800) for t in range(0, 40000, 900) if not 10800 <= t < 21600]
    rows += [("b", at(100), 1.0, None, None), (None, at(5), 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "sensor string, name_time timestamp_ntz, name_var double, lat double, lon double")
    out = {(r.sensor, r.period_no): r for r in regrid.regular_series(df).collect()}
    p = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) // 10800
    assert set(out) == {("a", p), ("a", p + 1), ("a", p + 2), ("a", p + 3), ("b", p)}
    gap = out["a", p + 1]
    assert gap.missing and gap.value is None and gap.filled == pytest.approx(2 + 1.5, abs=1e-6)
    full = out["a", p + 2]
    assert not full.missing and full.value == pytest.approx(2 + 2.5, abs=1e-6) and full.lon == pytest.approx(359.9 + 0.05, abs=1e-4)
    alone = out["b", p]
    assert alone.value == pytest.approx(1.0) and alone.lat is None and alone.support == pytest.approx(1.0)


def test_infinite_values_support_a_period_and_enter_no_fit(spark):
    rows = [("a", at(t), math.inf if t == 12000 else 1.0, None, None) for t in range(0, 32400, 1200)] + [("i", at(5), math.inf, 0.0, 0.0), ("i", at(30000), 2.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "sensor string, name_time timestamp_ntz, name_var double, lat double, lon double")
    out = regrid.regular_series(df).orderBy("sensor", "period_no").collect()
    assert [r.value for r in out if r.sensor == "a"] == pytest.approx([1.0] * 3)
    assert [(r.missing, r.insufficient, r.value) for r in out if r.sensor == "i"] == [(False, True, None), (True, False, None), (False, False, 2.0)]


def test_series_of_nothing(spark):
    df = spark.createDataFrame([], "sensor string, name_time timestamp_ntz, name_var double, lat double, lon double")
    assert regrid.regular_series(df).count() == 0


def _km(a, b):
    h = math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(700):
        lat, lon = rnd.choice([(0, 0), (89.98, 10), (-60, 179.99), (45, 359.98)])
        rows.append((k, rnd.choice("abc"), at(rnd.randrange(20000)), max(-90.0, min(90.0, lat + rnd.gauss(0, 0.04))), lon + rnd.gauss(0, 0.05) * (20 if abs(lat) > 80 else 1)))
    rows += [(1001, "a", at(0), 0.0, 0.0), (1002, "b", at(1800), 0.0, 0.0), (1003, "b", None, 0.0, 0.0), (1004, "b", at(0), None, 0.0), (1005, "b", at(0), 91.0, 0.0), (1006, "b", at(0), 0.0, float("nan")), (None, "b", at(0), 0.0, 0.0), (1007, None, at(0), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, source string, time timestamp_ntz, lat double, lon double")
    got = [(r.id_a, r.id_b) for r in proximity.near_pairs(df).collect()]
    good = [r for r in rows if r[0] is not None and r[1] and r[2] and r[3] is not None and -90 <= r[3] <= 90 and r[4] == r[4]]
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[1] != b[1] and abs((a[2] - b[2]).total_seconds()) <= 1800 and _km(a, b) <= 5}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100 and (1001, 1002) in want


def test_candidates_stay_near_the_radius(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(k, "ab"[k % 2], at(rnd.randrange(7200)), rnd.uniform(0, 1), rnd.uniform(0, 1)) for k in range(3000)], "id long, source string, time timestamp_ntz, lat double, lon double")
    pairs, tried = proximity.near_pairs(df).count(), proximity.candidate_pairs(df).count()
    assert 0 < pairs <= tried < 12 * pairs  # a box of 3 x 3 x 3 cells holds 27 / (pi * 2) = 4.3 times what the radius does; cells at the rims of bands more


def test_regions(spark):
    ring = [(350.0, -5.0), (370.0, -5.0), (360.0, 5.0)]
    regions = spark.createDataFrame([("t", [{"lon": x, "lat": y} for x, y in ring]), ("thin", [{"lon": 0.0, "lat": 0.0}])], "region string, ring array<struct<lon: double, lat: double>>")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 359.0), (3, 4.9, 5.0), (4, 0.0, 180.0), (5, None, 1.0)], "id long, lat double, lon double")
    assert {(r.id, r.region) for r in proximity.containing_regions(points, regions).collect()} == {(1, "t"), (2, "t")}


def _readings(spark, rows):
    return spark.createDataFrame([(s, i, t, v, -100.0, 100.0) for s, i, t, v in rows], "source string, rec_id long, time timestamp_ntz, value double, low double, high double")


def test_spikes_and_stuck_runs_across_blocks(spark):
    rng = np.random.default_rng(0)
    v = 1 + 0.2 * rng.standard_normal(500)
    v[100] += 5
    v[197:206] = 0.75  # a run over the border of blocks of 200
    v[396:401] = 0.5  # five are too few
    v[450] = 1e20
    rows = [("s", k, at(60 * k), float(x)) for k, x in enumerate(v)]
    rows += [("s", 900, None, -9.0), ("s", 901, None, 1.1), ("s", 902, at(5), None), ("s", 903, at(5), float("nan")), ("one", 904, at(0), 3.0), ("one", None, at(0), 3.0), (None, 905, at(0), 1e9), ("inf", 906, at(0), float("inf"))]
    got = {r.rec_id: r for r in spikes.implausible(_readings(spark, rows), block=200, halo=16).collect()}
    assert set(got) == {100, 450, 900, 906, *range(197, 206)}
    assert got[100].spike and not got[100].stuck and got[200].stuck and got[450].impossible and got[906].impossible


def test_spikes_of_a_constant_source_and_none(spark):
    rows = [("c", k, at(k), 2.0) for k in range(30)] + [("c", 99, at(99), 2.5)]
    assert [r.rec_id for r in spikes.implausible(_readings(spark, rows)).filter("not stuck").collect()] == [99]
    assert spikes.implausible(_readings(spark, [])).count() == 0


def _limited(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(5, 1, 400)
    return v, spark.createDataFrame([("s", k, at(60 * k), float(x), -10.0, 6.5) for k, x in enumerate(v)], "source string, rec_id long, time timestamp_ntz, value double, low double, high double")


def test_every_reading_beyond_a_limit_is_flagged(spark):
    v, df = _limited(spark)
    got = {r.rec_id for r in spikes.implausible(df).collect()}
    assert got == {k for k, x in enumerate(v) if x > 6.5} and len(got) > 15


def test_flags_do_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in "abc":
        v = np.cumsum(rng.normal(0, 0.02, 3000)) + 0.1 * rng.standard_normal(3000)
        v[rng.integers(0, 3000, 20)] += rng.choice([-9, 9], 20)
        for k in rng.integers(0, 2900, 5):
            v[k : k + rng.integers(4, 12)] = v[k]
        rows += [(s, 10000 * ord(s) + k, at(int(x)), float(y)) for k, (x, y) in enumerate(zip(np.cumsum(rng.integers(1, 400, 3000)), v))]
    df = _readings(spark, rows)
    want = sorted((r.rec_id, r.spike, r.stuck) for r in spikes.implausible(df, block=200).collect())
    assert want == sorted((r.rec_id, r.spike, r.stuck) for r in spikes.implausible(df, block=20000).collect()) and len(want) > 60
    # the first model's gate loses no reading that the exact check would flag
    flagged, normal = spikes.candidates(df, block=200)
    lost = df.join(normal, "source").filter("abs(value - good_mean) > 8 * good_sd").join(flagged, "rec_id", "left_anti")
    assert lost.count() == 0


def test_ranks_and_halos(spark):
    rows = [(s, (k * 37) % 101, k) for s in "ab" for k in range(300)]
    df = spark.createDataFrame(rows, "source string, t long, id long")
    from pyspark.sql import functions as F

    r = blocks.ranked(df, ["source"], F.floor(F.col("t") / 10), ["t", "id"])
    for s in "ab":
        got = [(x.t, x.id) for x in sorted(r.filter(F.col("source") == s).collect(), key=lambda x: x["rank"])]
        assert got == sorted((t, i) for x, t, i in rows if x == s)
    cut = blocks.with_halo(r, 50, 5)
    assert cut.filter("own").count() == 600
    assert cut.groupBy("source", "block").count().agg(F.max("count")).first()[0] <= 60


OBS = "obs_id long, file_id long, sensor string, name_time timestamp_ntz, output_id string"
MAN = "file_id long, obs_name string, window_ts timestamp_ntz, n_rec int, level string"


def _archive(spark, first, last):
    rnd = random.Random(7)
    obs = []
    for f in range(first, last):
        obs += [(rnd.randrange(f * 3, f * 3 + 12), f, "s", at(f * 10800)) for _ in range(rnd.randrange(0, 9))]
    man = [(f, "s", at(f * 10800), None) for f in range(first, last)]
    # columns of the same names as the operator's own must do no harm
    return obs, man


def _frames(spark, obs, man):
    o = spark.createDataFrame(obs, "obs_id long, file_id long, sensor string, name_time timestamp_ntz")
    return o, spark.createDataFrame([(*m, "x") for m in man], MAN)


def _stored_ids(spark, out):
    return [r.obs_id for r in compaction.compacted(spark, out).select("obs_id").collect()]


def test_compaction_is_whole_and_idempotent(spark, tmp_path):
    obs, man = _archive(spark, 0, 120)
    out = f"file://{tmp_path}/store"
    j1 = compaction.compact(spark, *_frames(spark, obs, man), out, target_rows=100).count()
    data = lambda: _stored_ids(spark, out)
    assert sorted(data()) == sorted({o[0] for o in obs})
    assert compaction.compact(spark, *_frames(spark, obs, man), out, target_rows=100).count() == j1
    assert sorted(data()) == sorted({o[0] for o in obs})
    more_o, more_m = _archive(spark, 120, 150)
    compaction.compact(spark, *_frames(spark, obs + more_o, man + more_m), out, target_rows=100)
    assert sorted(data()) == sorted({o[0] for o in obs + more_o})


def test_operators_on_empty_tables_and_clashing_names(spark, tmp_path):
    o, m = _frames(spark, [], [])
    assert compaction.compact(spark, o, m, f"file://{tmp_path}/empty").count() == 0
    o, m = _frames(spark, [(1, 10, "s", at(0)), (1, 11, "s", at(0))], [(10, "s", at(0), None), (11, "s", at(0), None)])
    from pyspark.sql import functions as F

    clash = o.withColumns({c: F.lit(7) for c in ("output_id", "run_id", "n_kept", "now", "run", "span", "level", "txn_id")})
    compaction.compact(spark, clash, m.withColumns({c: F.lit(7) for c in ("output_id", "n_kept", "slot", "small")}), f"file://{tmp_path}/clash")
    assert [(r.obs_id, r.output_id, r.now) for r in compaction.compacted(spark, f"file://{tmp_path}/clash").collect()] == [(1, 10, 7)]
    points = spark.createDataFrame([], "id long, source string, time timestamp_ntz, lat double, lon double, cell long, band long")
    assert proximity.near_pairs(points).count() == 0
    regions = spark.createDataFrame([], "region string, ring array<struct<lon: double, lat: double>>")
    assert proximity.containing_regions(points, regions).count() == 0
    rows = [("a", at(60 * k), 1.0 + k % 3, 1.0, 2.0) for k in range(9)]
    series = spark.createDataFrame(rows, "sensor string, name_time timestamp_ntz, name_var double, lat double, lon double")
    plain, clash = regrid.regular_series(series), regrid.regular_series(series.withColumns({c: F.lit("x") for c in ("u", "w", "own", "period_no", "t", "px")}))
    assert plain.collect() == clash.collect()
    r = _readings(spark, [("s", k, at(60 * k), 50.0 if k == 20 else float(k % 5)) for k in range(60)])
    assert [x.rec_id for x in spikes.implausible(r.withColumns({c: F.lit("x") for c in ("t", "rank", "block", "centre", "spread", "stuck", "z")})).collect()] == [20]
    near = proximity.near_pairs(spark.createDataFrame([(1, "a", at(0), 0.0, 0.0, 1, 1), (2, "b", at(0), 0.0, 0.01, 2, 2)], points.schema))
    assert [(x.id_a, x.id_b) for x in near.collect()] == [(1, 2)]


def test_compaction_journal(spark):
    obs = [(1, 10, "s", at(0)), (1, 11, "s", at(0)), (2, 12, "s", at(0)), (None, 13, "s", at(0)), (3, None, "s", at(0)), (4, 99, None, None)]
    man = [(10, "s", at(0), None), (11, "s", at(0), 5), (12, None, None, None), (13, "s", at(0), None), (14, "s", at(0), 7), (None, "s", at(0), 1), (14, "s", at(0), 7)]
    o, m = _frames(spark, obs, man)
    journal, placement = compaction.plan(compaction.contributions(compaction.owners(o), m))
    assert sorted(r.file_id for r in journal.filter("action = 'drop'").collect()) == [11, 13, 14]
    assert sorted(r.file_id for r in placement.collect()) == [10, 12, 99]


def test_compaction_bounds_its_outputs(spark):
    from pyspark.sql import functions as F

    obs, man = _archive(spark, 0, 400)
    o, m = _frames(spark, obs, man)
    own = compaction.owners(o)
    _, placement = compaction.plan(compaction.contributions(own, m), target_rows=64)
    sizes = own.join(placement, "file_id").groupBy("output_id").count()
    assert sizes.agg(F.max("count")).first()[0] <= 64 + 8
    assert sizes.count() < 60


def test_repeated_compaction_takes_files_that_the_manifest_does_not_list(spark, tmp_path):
    obs, man = _archive(spark, 0, 20)
    out = f"file://{tmp_path}/unlisted"
    compaction.compact(spark, *_frames(spark, obs, man), out, target_rows=100)
    more = [(9001, 900, "s", at(0)), (9002, 900, "s", at(0)), (obs[0][0], 901, "s", at(0))]
    j = compaction.compact(spark, *_frames(spark, obs + more, man), out, target_rows=100).count()
    assert sorted(_stored_ids(spark, out)) == sorted({o[0] for o in obs + more})
    assert compaction.compact(spark, *_frames(spark, obs + more, man), out, target_rows=100).count() == j


def test_six_runs_end_as_one_run(spark, tmp_path):
    obs, man = _archive(spark, 56, 116)  # within one span of the second level
    out = f"file://{tmp_path}/six"
    for k in range(6):
        new = range(56 + 10 * k, 66 + 10 * k)
        o, m = [x for x in obs if x[1] in new], [x for x in man if x[0] in new]
        j = compaction.compact(spark, *_frames(spark, o, m), out, target_rows=1000)
    whole = f"file://{tmp_path}/one"
    j1 = compaction.compact(spark, *_frames(spark, obs, man), whole, target_rows=1000)
    live, one = compaction.live_outputs(j).collect(), compaction.live_outputs(j1).collect()
    assert len(live) == len(one) == 1 and live[0].n_rows == one[0].n_rows
    assert sorted(_stored_ids(spark, out)) == sorted(_stored_ids(spark, whole)) == sorted({o[0] for o in obs})
    import os

    assert all(os.path.isfile(r.path.removeprefix("file://").removeprefix("file:")) for r in live + one)
    assert j.filter("action = 'retire'").count() == 5


def test_a_large_output_is_not_moved_for_a_few_rows(spark, tmp_path):
    out = f"file://{tmp_path}/large"
    step = lambda rows, f: compaction.compact(spark, *_frames(spark, rows, [(f, "s", at(0), None)]), out, target_rows=5000)
    step([(k, 1, "s", at(0)) for k in range(1000)], 1)
    j = step([(5000, 2, "s", at(0)), (3, 2, "s", at(0))], 2)
    assert sorted(r.n_rows for r in compaction.live_outputs(j).collect()) == [1, 1000]
    j = step([(6000 + k, 3, "s", at(0)) for k in range(160)], 3)
    assert [r.n_rows for r in compaction.live_outputs(j).collect()] == [1161]
    assert sorted(_stored_ids(spark, out)) == sorted([*range(1000), 5000, *range(6000, 6160)])


@pytest.mark.parametrize("stage", ["data", "journal"])
def test_a_killed_run_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, stage):
    obs, man = _archive(spark, 0, 40)
    out = f"file://{tmp_path}/killed"
    first = [x for x in obs if x[1] < 20], [x for x in man if x[0] < 20]
    compaction.compact(spark, *_frames(spark, *first), out, target_rows=1000)
    before = sorted(_stored_ids(spark, out))
    from pyspark.sql.readwriter import DataFrameWriter

    real = DataFrameWriter.parquet

    def dying(self, path, *args, **kw):
        if f"/{stage if stage == 'journal' else 'commits'}" in path or (stage == "data" and "/journal/" in path):
            raise KeyboardInterrupt
        return real(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", dying)
    with pytest.raises(KeyboardInterrupt):
        compaction.compact(spark, *_frames(spark, obs, man), out, target_rows=1000)
    monkeypatch.undo()
    assert sorted(_stored_ids(spark, out)) == before
    compaction.compact(spark, *_frames(spark, obs, man), out, target_rows=1000)
    assert sorted(_stored_ids(spark, out)) == sorted({o[0] for o in obs})


def test_entries_without_sensor_or_window_are_spread(spark):
    obs = [(k, k // 2, None, None) for k in range(2000)] + [(5000 + k, 5000 + k // 3, "q", at(k * 7200)) for k in range(30)]
    o, m = _frames(spark, obs, [])
    rows = {r.file_id: r for r in compaction.contributions(o, m).collect()}
    assert len({r.slot for k, r in rows.items() if k < 1000}) == 1000
    assert rows[5000].obs_name == "q" and rows[5009].slot > rows[5000].slot
