"""Scans, caches, sinks and configuration."""

import pytest
from pyspark.sql import functions as F

from tidemill import config
from tidemill.sources import ingest, sinks, tables


def test_scan_maps_roles_and_fills_optional_ones(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    spark.createDataFrame([(1, 2.0)], "a int, b double").write.parquet(f"{at}/1")
    spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string").write.parquet(f"{at}/2")
    got = ingest.scan(spark, [f"{at}/*"], {"lon": "b", "note": "c", "err": "e"}, optional=("err",))
    assert sorted((r.lon, r.note or "", r.err) for r in got.collect()) == [(2.0, "", None), (2.0, "x", None)]
    with pytest.raises(KeyError):
        ingest.scan(spark, [f"{at}/1"], {"lon": "b", "err": "e"})


def test_cached_ingest_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")

    for _ in range(2):
        assert ingest.cached(spark, f"file://{tmp_path}", {"x": 1}, make, ["k"]).count() == 2
    assert len(made) == 1
    ingest.cached(spark, f"file://{tmp_path}", {"x": 2}, make, ["k"])
    assert len(made) == 2


def test_upserts(spark):
    old = spark.createDataFrame([(1, 1.0, 5), (2, 2.0, 6)], "k int, h double, n int")
    new = spark.createDataFrame([(2, 9.0), (3, None)], "k int, h double")
    assert sorted(tuple(r) for r in sinks.upsert_variables(old, new, ["k"]).fillna(-1).collect()) == [(1, 1.0, 5), (2, 9.0, 6), (3, -1.0, -1)]
    assert sorted(r.k for r in sinks.upsert(old, new, ["k"]).collect()) == [1, 2, 3]


def test_windows_and_log(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("w"))
    sinks.write_windows(df, f"file://{tmp_path}/w", ["w"])
    assert spark.read.parquet(f"file://{tmp_path}/w").filter("w = 1").count() == 5
    for _ in range(2):
        sinks.append_log(df, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 20


def test_release_deletes_left_tables(spark):
    df = tables.materialize(spark.range(3), "t")
    assert df.count() == 3 and tables.release(spark) >= 1 and tables.release(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert tables.shared_dir(Session()).startswith("file://")


def test_once_makes_again_what_was_released(spark):
    made = []

    def make():
        made.append(1)
        return (tables.materialize(spark.range(5), "once"),)

    for _ in range(2):
        assert tables.once(spark, ("t",), make)[0].count() == 5
    tables.release(spark)
    assert tables.once(spark, ("t",), make)[0].count() == 5 and len(made) == 2


def test_broadcast_only_when_small(spark):
    small, large = tables.broadcast_if_small(spark.range(3)), tables.broadcast_if_small(spark.range(30), rows=10)
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small).lower() and "broadcast" not in plan(large).lower()


def test_config_merges_and_raises():
    c = config.merge({"obs": {"window_s": 3600}})
    assert c.obs.window_s == 3600 and c.obs.varmax == 100.0
    for bad in ({"nope": {}}, {"obs": {"dy": 1}}):
        with pytest.raises(KeyError):
            config.merge(bad)
    f = config.Factory()
    f.register("a")(lambda x: x + 1)
    f.register("b")(lambda x: x * 2)
    assert f.several(["a", "b"], sum)(5) == 16
    with pytest.raises(KeyError):
        f("c")
