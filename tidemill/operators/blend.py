"""Decomposition into overlapping sub-windows and their weighted blend."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.scalars import hann


def overlapping(df: DataFrame, axis: str, width: float, step: float) -> DataFrame:
    """A copy of each row for every window [n * step, n * step + width) that holds it; adds sub_window and w, the Hann
    weight of the row's place in the window. With width = 2 * step the weights of a row sum to 1. No shuffle."""
    last = F.floor(F.col(axis) / step)
    n = round(width / step)
    df = df.withColumn("sub_window", F.explode(F.sequence(last - (n - 1), last)))
    return df.withColumn("w", hann((F.col(axis) - F.col("sub_window") * step) / width))


def weighted(df: DataFrame, keys: list[str], value: str, to: str | None = None) -> DataFrame:
    """Sum of w * value over sum of w for each key, and the number of windows that took part."""
    return df.groupBy(*keys).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(to or value), F.count("*").alias("n_windows"))


def sub_windows(df: DataFrame, days: float, degrees: float) -> DataFrame:
    """The table of sub-windows that cover the rows' time and the globe, half overlapping in each dimension."""
    half_d, half_g = days / 2, degrees / 2
    t = df.agg(F.floor(F.floor(F.min("ts") / 86400) / half_d).alias("a"), F.floor(F.floor(F.max("ts") / 86400) / half_d).alias("b"))
    t = t.select(F.explode(F.sequence(F.col("a") - 1, F.col("b"))).alias("tw"))
    g = t.withColumn("yw", F.explode(F.sequence(F.lit(int(-90 / half_g)), F.lit(int(90 / half_g) - 1))))
    g = g.withColumn("xw", F.explode(F.sequence(F.lit(0), F.lit(int(360 / half_g) - 1))))
    lo = lambda c, h: (F.col(c) * h).cast("double")
    return g.select("tw", "yw", "xw", lo("tw", half_d).alias("day0"), (lo("tw", half_d) + days).alias("day1"), lo("yw", half_g).alias("lat0"), (lo("yw", half_g) + degrees).alias("lat1"), lo("xw", half_g).alias("lon0"), (lo("xw", half_g) + degrees).alias("lon1"))


def handed_on(df: DataFrame, keys: list[str], step: str, value: str, keep: float, gain: float, block: int = 64) -> DataFrame:
    """keys, step, state of each row: a state handed from step to step, of which ``keep`` is left after each step, plus
    ``gain`` times the row's value.

    The state is a sum of values weighted by age. Steps are cut into blocks that also hold the steps before them as far
    as these still weigh in double precision, so a key's history of any length is spread over groups of bounded size.
    ``step`` is a whole number, at most one row of a key has it, and 0 < keep < 1.
    """
    reach = max(1, math.ceil(math.log(1e-19) / math.log(keep) / block))
    own = F.floor(F.col(step) / block)
    b = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, own + reach)))
    age = F.col(step) - F.col("_block") * block
    k = F.lit(float(keep))
    so_far = F.sum(gain * F.col(value) * F.pow(k, -age)).over(W.partitionBy(*keys, "_block").orderBy(step))
    return b.withColumn("state", so_far * F.pow(k, age)).filter("_own = _block").select(*keys, step, "state")


def kernel_filled(grid: DataFrame, keys: list[str], value: str, n_j: int, n_i: int) -> DataFrame:
    """keys, j, i, given, value: the given cells, and the cells beside them with the mean of those under a Gaussian kernel of 3 x 3.

    Each cell sends its value to the cells around it and one partial aggregate collects them; longitudes are periodic.
    """
    cell = lambda dj, di: F.struct((F.col("j") + dj).alias("j"), F.pmod(F.col("i") + di, F.lit(n_i)).alias("i"), F.lit(math.exp(-(dj * dj + di * di) / 2)).alias("w"), F.lit(dj == di == 0).alias("own"))
    around = F.explode(F.array(*[cell(dj, di) for dj in (-1, 0, 1) for di in (-1, 0, 1)]))
    s = grid.select(*keys, value, around.alias("c")).select(*keys, value, "c.*").filter((F.col("j") >= 0) & (F.col("j") < n_j))
    own = F.max(F.when(F.col("own"), F.col(value)))
    mean = F.sum(F.col("w") * F.col(value)) / F.sum("w")
    return s.groupBy(*keys, "j", "i").agg((F.count_if("own") > 0).alias("given"), F.coalesce(own, mean).alias(value))
