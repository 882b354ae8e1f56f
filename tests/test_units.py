"""Longitudes in every notation, and the defined results of odd input."""

import math

import pytest

from tidemill.operators import units

OBS = "obs_id long, file_id long, name_lon double, lon_unit string, lon_east double"
MAN = "file_id long, attributes string, unit string"


def obs_result(spark, rows, man=()):
    df = spark.createDataFrame([(*r, -1.0) for r in rows], OBS)
    m = spark.createDataFrame([(*r, "x") for r in man], MAN)
    return {r.obs_id: (r.lon_east, r.bare_east) for r in units.observation_longitudes(df, m).collect()}


def test_units_of_readings(spark):
    rows = [
        (1, 1, 10.0, "degrees_east"),
        (2, 1, -10.0, "degrees"),
        (3, 1, math.pi, "rad"),
        (4, 1, 600.0, "' east"),
        (5, 1, 90e6, "1e-6 degrees_east"),
        (6, 1, 20.0, "deg W"),
        (7, 2, 20.0, "degrees"),  # made exact by the file: westward
        (8, 3, 1.5, None),  # the file says radians
        (9, 1, 123456789.0, None),  # size decides
        (10, 1, 123456789.0, "degrees_east"),  # cannot be degrees
        (11, 4, -20.0, None),  # negative west is east positive
        (12, 5, 30.0, ""),  # the file speaks of other things
        (13, 1, 360.0, None),
        (14, 6, 2e7, None),
    ]
    man = [(2, "step 3 h. lon: degrees west of the zero meridian. No mean"), (3, "super: track | longitude: signed radians | var: x"), (4, "lon: deg, negative west of the zero meridian"), (5, "time=t; lon=lon; var=sla west"), (6, "lon packed, scale_factor=1e-06, degrees_east")]
    got = obs_result(spark, rows, man)
    want = {1: 10, 2: 350, 3: 180, 4: 10, 5: 90, 6: 340, 7: 340, 8: math.degrees(1.5), 9: 123.456789, 10: 123.456789, 11: 340, 12: 30, 13: 0, 14: 20}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want)
    assert {k for k, v in got.items() if v[1]} == {1, 12}


def test_odd_readings(spark):
    rows = [(1, None, None, None), (2, 9, float("nan"), "rad"), (3, 9, float("inf"), "rad"), (None, 1, 5.0, None), (4, None, 5.0, "x" * 10000), (5, 1, 5.0, None), (5, 1, 5.0, None), (6, 1, -1e30, None)]
    got = obs_result(spark, rows, [(None, "lon in radians"), (1, None), (1, "lon=lon")])
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: None, 3: None, 4: 5.0, 5: 5.0, 6: None}


def test_copies_are_read_together(spark):
    got = obs_result(spark, [(1, 1, 1.0, None), (1, 2, 1.0, None)], [(2, "longitude given in radians")])
    assert got[1][0] == pytest.approx(math.degrees(1))


def test_empty_tables(spark):
    assert obs_result(spark, []) == {}
    ref = spark.createDataFrame([], "ref_id long, name_ref_lon string, lon_note string")
    bas = spark.createDataFrame([], "bas_id long, name_bas_lon double, lon_unit string, lon_note string")
    assert units.reference_longitudes(ref).count() == 0 and units.baseline_longitudes(bas).count() == 0


def test_other_quantities(spark):
    rows = [(1, "20.5 C", None), (2, "68", "fahrenheit"), (3, "300", "K"), (4, "none", "K"), (5, None, "K"), (6, "12", "furlongs"), (7, "1e9", "c"), (8, "15,5", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, t string, unit string, factor string")
    got = {r.id: r.base for r in units.convert(df, "temperature", "t", "unit", default="celsius").collect()}
    assert got == {1: pytest.approx(293.65), 2: pytest.approx(293.15), 3: 300.0, 4: None, 5: None, 6: pytest.approx(285.15), 7: None, 8: pytest.approx(288.65)}
    m = spark.createDataFrame([(1, 120.0, "depth in cm"), (2, float("nan"), "cm"), (3, 3.0, None)], "id long, z double, note string")
    assert {r.id: r.base for r in units.convert(m, "length", "z", text="note").collect()} == {1: pytest.approx(1.2), 2: None, 3: None}


@pytest.mark.parametrize(
    ("text", "note", "lon", "bare"),
    [
        ("110.5", None, 110.5, True),
        ("-110.5", None, 249.5, False),
        ("110,5", None, 110.5, False),
        ("6.0 radians", None, math.degrees(6), False),
        ("rad 1.5", "checked", math.degrees(1.5), False),
        ("10534.5'", None, 175.575, False),
        ("30 min of arc", None, 0.5, False),
        ("113°26'47\"W", None, 360 - (113 + 26 / 60 + 47 / 3600), False),
        ("44°33.96'E", None, 44 + 33.96 / 60, False),
        ("21 47.5 W", None, 360 - (21 + 47.5 / 60), False),
        ("38d20.07mW", None, 360 - (38 + 20.07 / 60), False),
        ("128:30:36 W", None, 360 - 128.51, False),
        ("31.7E", None, 31.7, False),
        ("8.3070 deg W", None, 351.693, False),
        ("111463686e-6 deg", None, 111.463686, False),
        ("47865411 microdegrees", None, 47.865411, False),
        ("104.4", "lon counted westward", 255.6, False),
        ("0.5", "deg W", 359.5, False),
        ("1149.23", "arc minutes", 1149.23 / 60, False),
        ("1.5", "lon in rad", math.degrees(1.5), False),
        ("20.5", "track edited by hand", 20.5, True),
        ("n/a", None, None, None),
        ("NaN", None, None, None),
        ("", None, None, None),
        (None, "rad", None, None),
    ],
)
def test_reference_notations(spark, text, note, lon, bare):
    got = units.reference_longitudes(spark.createDataFrame([(1, text, note)], "ref_id long, name_ref_lon string, lon_note string")).collect()
    if lon is None:
        assert got == []
    else:
        assert got[0].lon_east == pytest.approx(lon) and got[0].bare_east == bare
