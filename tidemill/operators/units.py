"""Problem 5: quantities recorded in different units, brought to common ones; longitudes to degrees east, 0 <= lon < 360.

Pure SQL expressions: the number and the unit are extracted by regular expression, the unit's alias is
normalised by a join with a fixed table of aliases, the unit field, the text unit and the default by the
number's size are coalesced, then factor and offset are applied. No Python runs on the rows. ``convert`` does so for any
quantity of the table; longitudes add directions, notations in degrees and minutes, and packed integers told by size.

Defined results: null, NaN and text without a number have no longitude (null); infinite numbers and
numbers beyond every unit are null too; a missing manifest entry counts as silent. Copies of a reading
that tell different things are read together: the most exact telling holds.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.readings import strings
from tidemill.sources.tables import broadcast_if_small

# The spellings of units in lon_unit, attributes and lon_note.
# (spelling, unit)
ALIASES = [
    ("degrees_east", "deg"),
    ("degree_east", "deg"),
    ("degrees_west", "deg"),
    ("degree_west", "deg"),
    ("degrees", "deg"),
    ("degree", "deg"),
    ("deg", "deg"),
    ("radians", "rad"),
    ("radian", "rad"),
    ("rad", "rad"),
    ("minutes of arc", "arcmin"),
    ("min of arc", "arcmin"),
    ("arc minutes", "arcmin"),
    ("arc minute", "arcmin"),
    ("arc_minutes", "arcmin"),
    ("arc_minute", "arcmin"),
    ("arcmin", "arcmin"),
    ("'", "arcmin"),
    ("millionths of a degree", "udeg"),
    ("scale_factor=1e-06", "udeg"),
    ("scale_factor=1e-6", "udeg"),
    ("1e-6", "udeg"),
    ("10^-6", "udeg"),
    ("microdegrees", "udeg"),
    ("microdegree", "udeg"),
    ("udeg", "udeg"),
]
# Of each quantity its units: factor and offset to the quantity's base unit (the first), largest number that can be one.
QUANTITIES = {
    "longitude": {"deg": (1.0, 0.0, 360.0), "rad": (57.29577951308232, 0.0, 6.2832), "arcmin": (1 / 60, 0.0, 21600.0), "udeg": (1e-6, 0.0, 360e6)},
    "temperature": {"K": (1.0, 0.0, 1000.0), "degC": (1.0, 273.15, 1000.0), "degF": (5 / 9, 459.67 * 5 / 9, 1800.0)},
    "length": {"m": (1.0, 0.0, 1e9), "cm": (0.01, 0.0, 1e11), "mm": (0.001, 0.0, 1e12), "km": (1000.0, 0.0, 1e6), "ft": (0.3048, 0.0, 1e9)},
}
# The spellings of the other quantities' units. (spelling, unit)
OTHER_ALIASES = {
    "temperature": [("kelvin", "K"), ("k", "K"), ("degrees celsius", "degC"), ("celsius", "degC"), ("degc", "degC"), ("c", "degC"), ("degrees fahrenheit", "degF"), ("fahrenheit", "degF"), ("degf", "degF"), ("f", "degF")],
    "length": [("metres", "m"), ("meters", "m"), ("metre", "m"), ("meter", "m"), ("m", "m"), ("centimetres", "cm"), ("centimeters", "cm"), ("cm", "cm"), ("millimetres", "mm"), ("millimeters", "mm"), ("mm", "mm"), ("kilometres", "km"), ("kilometers", "km"), ("km", "km"), ("feet", "ft"), ("foot", "ft"), ("ft", "ft")],
}
UNITS = {u: (f, most) for u, (f, _, most) in QUANTITIES["longitude"].items()}

_TOKEN = "(" + "|".join(a.replace("^", r"\^") for a, _ in sorted(ALIASES, key=lambda a: -len(a[0])) if a != "'") + ")"
_WEST = r"(?<!negative )(west|deg ?w\b|[0-9°'\"m ]w\s*$)"
_LON_CLAUSE = r"\b(lon(?:gitude)?(?![a-z])(?:[^;|.]|\.(?=\d))*)"


def lon_clause(text: Column) -> Column:
    """The part of a free text that speaks of the longitude, in lower case; empty if there is none."""
    return F.regexp_extract(F.lower(text), _LON_CLAUSE, 1)


def unit_token(text: Column) -> Column:
    """The spelling of the first unit told in a text, or null; a lone minute sign counts."""
    low = F.lower(F.trim(text))
    word = F.regexp_extract(low, _TOKEN, 1)
    return F.when(word != "", word).when(low.rlike(r"^'|\d\s*'$"), F.lit("'"))


def says_west(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(_WEST), F.lit(False))


def alias_table(spark: SparkSession) -> DataFrame:
    """The fixed alias table as a DataFrame of len(ALIASES) rows, whatever the input's size."""
    rows = [(a, u, UNITS[u][0], UNITS[u][1]) for a, u in ALIASES]
    return spark.createDataFrame(rows, "alias string, unit string, factor double, most double")


def with_unit(df: DataFrame, token: str, to: str) -> DataFrame:
    """Join the alias in column ``token`` with the alias table; adds struct ``to`` (unit, factor, most), null if silent."""
    al = alias_table(df.sparkSession).select(F.col("alias").alias("_alias"), F.struct("unit", "factor", "most").alias(to))
    return df.join(F.broadcast(al), F.col(token) == F.col("_alias"), "left").drop("_alias", token)


def convert(df: DataFrame, quantity: str, value: str, field: str | None = None, text: str | None = None, default: str | Column | None = None, to: str = "base") -> DataFrame:
    """Add ``to``: ``value`` in the base unit of ``quantity`` (factor * number + offset).

    ``value`` is a number, or a text that holds one and perhaps its unit. The unit is that of the column ``field``, else
    one told in the column ``text`` or beside the number, else ``default`` (a spelling of the source's own unit). Spellings are
    normalised by joins with the fixed table of aliases, a few rows whatever the input's size. Null where there is no
    number, no known unit, or a number that cannot be one in its unit.
    """
    aliases = ALIASES if quantity == "longitude" else OTHER_ALIASES[quantity]
    rows = [(a, *QUANTITIES[quantity][u]) for a, u in aliases]
    table_ = F.broadcast(df.sparkSession.createDataFrame(rows, "_alias string, _factor double, _offset double, _most double"))
    written = dict(df.dtypes)[value] == "string"
    number = F.regexp_extract(value, r"([+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?)", 1) if written else F.col(value)
    number = F.regexp_replace(number, ",", ".").try_cast("double") if written else F.when(~F.isnan(number.cast("double")), number.cast("double"))
    token = r"(?<![a-z])(" + "|".join(re.escape(a) for a, _ in sorted(aliases, key=lambda a: -len(a[0]))) + r")(?![a-z])"
    told = lambda c: F.regexp_extract(F.lower(c), token, 1)
    texts = [F.lower(F.trim(field))] if field else []
    texts += [told(F.col(c)) for c in ([text] if text else []) + ([value] if written else [])]
    texts += [F.lower(default if isinstance(default, Column) else F.lit(default))] if default is not None else []
    known = F.array(*[F.lit(a) for a, _ in aliases])
    spelling = F.coalesce(*[F.when(F.array_contains(known, c), c) for c in texts], F.lit(None).cast("string"))
    j = df.withColumn("_n", number).withColumn("_alias", spelling).join(table_, "_alias", "left")
    fits = F.abs("_n") <= F.col("_most")
    return j.withColumn(to, F.when(fits, F.col("_n") * F.col("_factor") + F.col("_offset"))).select(*df.columns, to)


def more_exact(field: Column, text: Column) -> Column:
    """Coalesce the unit of the field and of the text; plain degrees give way to anything more exact."""
    general = F.coalesce(field["unit"] == "deg", F.lit(True))
    return F.when(general & text.isNotNull(), text).otherwise(field)


def degrees_east(number: Column, unit: Column, west: Column) -> Column:
    """Apply factor and offset. If no unit is told, or the number cannot be a longitude in it, the number's
    size decides between degrees and an integer scaled by a million."""
    size = F.abs(number)
    east = F.when(west & unit.isNull(), -number).otherwise(number)  # a direction told without a unit still holds
    told = unit.isNotNull() & (size <= unit["most"] * 1.0001)
    deg = (
        F.when(told, F.when(west, -number).otherwise(number) * unit["factor"])
        .when(size <= 360, east)
        .when(size <= 360e6 * 1.0001, east * 1e-6)
    )
    wrapped = F.pmod(deg, F.lit(360.0))
    return F.when(wrapped >= 360, 0.0).otherwise(wrapped)


def already_east(number: Column, unit: Column, west: Column) -> Column:
    """Is the bare number degrees east within 0..360 as it stands?"""
    plain = unit.isNull() | (unit["unit"] == "deg")
    wrong_unit = unit.isNotNull() & (F.abs(number) > unit["most"] * 1.0001)
    return (plain | wrong_unit) & ~west & (number >= 0) & (number < 360)


def manifest_units(manifest: DataFrame) -> DataFrame:
    """file_id, text_unit (struct or null), text_west for the manifest entries that tell something of the longitude."""
    clause = lon_clause(F.col("attributes"))
    told = (
        manifest.filter(F.col("file_id").isNotNull())
        .select("file_id", clause.alias("c"))
        .filter("c <> ''")
        .select("file_id", unit_token(F.col("c")).alias("t"), says_west(F.col("c")).alias("text_west"))
        .filter("t is not null or text_west")
    )
    told = with_unit(told, "t", "text_unit")
    return told.groupBy("file_id").agg(F.max(code(F.col("text_unit"))).alias("text_code"), F.max("text_west").alias("text_west"))


def spelled_units(df: DataFrame, field: str) -> DataFrame:
    """field, field_code, field_west for each distinct spelling of a unit field: expressions run once a spelling, not once a row."""
    d = df.select(field).filter(F.col(field).isNotNull()).distinct()
    d = d.select(field, unit_token(F.col(field)).alias("t"), says_west(F.col(field)).alias("field_west"))
    return with_unit(d, "t", "u").select(field, code(F.col("u")).alias("field_code"), "field_west")


CODES = {"deg": 1, "arcmin": 2, "rad": 3, "udeg": 4}  # 0: silent, 1: general, above: exact


def code(unit: Column) -> Column:
    """Number of a unit struct, 0 where it is null."""
    return F.coalesce(*[F.when(unit["unit"] == u, c) for u, c in CODES.items()], F.lit(0))


def unit_of(c: Column) -> Column:
    """The unit struct of a number; null for 0."""
    struct = lambda u: F.struct(F.lit(u).alias("unit"), F.lit(UNITS[u][0]).alias("factor"), F.lit(UNITS[u][1]).alias("most"))
    return F.coalesce(*[F.when(c == n, struct(u)) for u, n in CODES.items()])


def lookups(obs: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spellings of the unit field, telling entries of the manifest), each broadcast behind a count, else joined by shuffle."""
    return broadcast_if_small(spelled_units(obs, "lon_unit"), "spellings"), broadcast_if_small(manifest_units(manifest), "told")


def observation_longitudes(obs: DataFrame, manifest: DataFrame, *cols: str, small: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per obs_id: obs_id, name_lon, lon_east, bare_east, and the columns named.

    The two ``lookups`` (made here unless they are given) are joined first; then one partial hash aggregate reduces to
    one row per reading, the only shuffle of readings. Where copies differ in what their files tell, the most exact
    telling wins. Strings among ``cols`` are grouped by (see ``distinct_readings``).
    """
    spellings, told_by_file = small or lookups(obs, manifest)
    rows = obs.filter(F.col("obs_id").isNotNull()).select("obs_id", "file_id", "name_lon", "lon_unit", *cols)
    rows = rows.join(spellings, "lon_unit", "left")
    rows = rows.join(told_by_file, "file_id", "left")
    field, text = F.coalesce("field_code", F.lit(0)), F.coalesce("text_code", F.lit(0))
    told = F.when((field <= 1) & (text > 0), text).otherwise(field)
    west = F.coalesce("field_west", F.lit(False)) | F.coalesce("text_west", F.lit(False))
    text_cols = strings(obs, cols)
    one = rows.groupBy("obs_id", *text_cols).agg(
        F.any_value("name_lon").alias("name_lon"),
        F.max(told).alias("_code"),
        F.max(west).alias("_west"),
        *[F.any_value(c).alias(c) for c in cols if c not in text_cols],
    )
    number, unit = F.when(~F.isnan("name_lon"), F.col("name_lon")), unit_of(F.col("_code"))
    return one.select(
        "obs_id",
        "name_lon",
        degrees_east(number, unit, F.col("_west")).alias("lon_east"),
        already_east(number, unit, F.col("_west")).alias("bare_east"),
        *cols,
    )


def baseline_longitudes(bas: DataFrame) -> DataFrame:
    """One row per bas_id: bas_id, lon_east, bare_east. lon_unit and lon_note are read together; copies too."""
    rows = bas.filter(F.col("bas_id").isNotNull()).select(
        "bas_id",
        F.when(~F.isnan("name_bas_lon"), F.col("name_bas_lon")).alias("n"),
        unit_token(F.col("lon_unit")).alias("t1"),
        unit_token(F.col("lon_note")).alias("t2"),
        (says_west(F.col("lon_unit")) | says_west(F.col("lon_note"))).alias("west"),
    )
    rows = with_unit(with_unit(rows, "t1", "u1"), "t2", "u2").withColumn("u", more_exact(F.col("u1"), F.col("u2")))
    out = rows.select("bas_id", degrees_east(F.col("n"), F.col("u"), F.col("west")).alias("lon_east"), already_east(F.col("n"), F.col("u"), F.col("west")).alias("bare_east"))
    return out.groupBy("bas_id").agg(F.max("lon_east").alias("lon_east"), F.min("bare_east").alias("bare_east"))


_NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
_BARE = r"^[+-]?[0-9]+(?:\.[0-9]+)?$"
_SEXAGESIMAL = rf"^([+-]?{_NUMBER})\s*(?:[°d:]\s*|\s+(?=[0-9]))({_NUMBER})?\s*['m:]?\s*({_NUMBER})?\s*\"?\s*([ew])?$"


def reference_longitudes(ref: DataFrame) -> DataFrame:
    """One row per ref_id: ref_id, lon_east, bare_east, of longitudes written as text in many notations.

    Understood are plain numbers with point or comma and exponent, a unit before or behind the number, a
    hemisphere letter, and degrees with minutes and seconds. Text without digits is no longitude.
    """
    low = F.lower(F.trim("name_ref_lon"))
    part = lambda i: F.regexp_replace(F.regexp_extract("low", _SEXAGESIMAL, i), ",", ".")
    as_double = lambda c: F.when(c != "", c).cast("double")
    first = F.regexp_replace(F.regexp_extract("low", r"([+-]?[0-9]+(?:[.,][0-9]+)?(?:e[+-]?[0-9]+)?)", 1), ",", ".")
    rows = ref.filter(F.col("ref_id").isNotNull()).select("ref_id", low.alias("low"), "lon_note")
    rows = rows.filter(F.col("low").rlike("[0-9]"))
    sexagesimal = F.col("low").rlike(_SEXAGESIMAL) & F.col("low").rlike("[°d:]|[0-9]\\s+[0-9]")
    deg = as_double(part(1))
    dms = F.abs(deg) + F.coalesce(as_double(part(2)), F.lit(0.0)) / 60 + F.coalesce(as_double(part(3)), F.lit(0.0)) / 3600
    dms = F.when(F.col("low").startswith("-"), -dms).otherwise(dms)
    sex_token = F.when(sexagesimal, F.lit("deg")).otherwise(unit_token(F.regexp_replace("low", r"[0-9]e-?[0-9]+", "0")))
    rows = rows.select(
        "ref_id",
        F.when(sexagesimal, dms).otherwise(as_double(first)).alias("n"),
        sex_token.alias("t1"),
        unit_token(F.col("lon_note")).alias("t2"),
        (says_west(F.col("low")) | says_west(F.col("lon_note"))).alias("west"),
        F.col("low").rlike(_BARE).alias("bare"),
    )
    rows = with_unit(with_unit(rows, "t1", "u1"), "t2", "u2").withColumn("u", more_exact(F.col("u1"), F.col("u2")))
    out = rows.select("ref_id", degrees_east(F.col("n"), F.col("u"), F.col("west")).alias("lon_east"), (F.col("bare") & already_east(F.col("n"), F.col("u"), F.col("west"))).alias("bare_east"))
    return out.groupBy("ref_id").agg(F.max("lon_east").alias("lon_east"), F.min("bare_east").alias("bare_east"))


def converted_records(obs: DataFrame, manifest: DataFrame, ref: DataFrame, bas: DataFrame) -> DataFrame:
    """tab, rec_id, lon_east, bare_east of every record of the three tables that has a longitude."""
    parts = [
        ("obs", "obs_id", observation_longitudes(obs, manifest)),
        ("diag_ref", "ref_id", reference_longitudes(ref)),
        ("diag_bas", "bas_id", baseline_longitudes(bas)),
    ]
    union = [d.select(F.lit(t).alias("tab"), F.col(k).alias("rec_id"), "lon_east", "bare_east") for t, k, d in parts]
    return reduce(DataFrame.unionByName, union).filter("lon_east is not null")
