"""Row transforms: roles, boxes, wrapping, block means and strides."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.blocks import ranked
from tidemill.sources.tables import materialize


def rename_roles(df: DataFrame, roles: dict[str, str], keep: list[str]) -> DataFrame:
    """Project a file's variables to their roles; columns that have no role are pruned from the scan."""
    return df.select(*keep, *[F.col(c).alias(role) for c, role in roles.items()])


def signed_sum(signs: dict[str, int]) -> Column:
    """Sum of sign times variable; null if any is null."""
    return reduce(Column.__add__, [F.lit(s) * F.col(c) for c, s in signs.items()])


def wrap_longitude(df: DataFrame, lon: str, to: str) -> DataFrame:
    """Wrap longitudes if the whole data set's extent asks for it, not row by row.

    The extent is one partial aggregate of two numbers, which is joined back as a single row.
    """
    extent = df.agg(F.min(lon).alias("_lo"), F.max(lon).alias("_hi"))
    if to == "0..360":
        wrapped = F.when(F.col("_lo") < 0, F.pmod(lon, F.lit(360.0))).otherwise(F.col(lon))
    else:
        wrapped = F.when((F.col("_lo") >= 0) | (F.col("_hi") > 180), F.pmod(F.col(lon) + 180, F.lit(360.0)) - 180).otherwise(F.col(lon))
    return df.join(F.broadcast(extent)).withColumn(lon, wrapped).drop("_lo", "_hi")


def box(df: DataFrame, lon: tuple, lat: tuple, pad: float = 0.0, start: str | None = None, end: str | None = None) -> DataFrame:
    """Closed box in space, widened by ``pad``, and closed range in time."""
    keep = F.col("lon").between(float(lon[0] - pad), float(lon[1] + pad)) & F.col("lat").between(float(lat[0] - pad), float(lat[1] + pad))
    if start is not None:
        keep &= F.col("t") >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        keep &= F.col("t") <= F.lit(end).cast("timestamp_ntz")
    return df.filter(keep)


def block_mean(df: DataFrame, group: list[str], order: list[str], k: int, cols: list[str]) -> DataFrame:
    """Means of each k consecutive rows of a group; an incomplete last block is trimmed. Groups should be short windows."""
    block = F.floor((F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1) / k)
    means = df.withColumn("block_no", block).groupBy(*group, "block_no").agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in cols])
    return means.filter(F.col("_n") == k).drop("_n")


def stride(df: DataFrame, group: list[str], order: str, k: int, width: float = 86400.0) -> DataFrame:
    """Every k-th distinct value of ``order`` (seconds) in each group; adds ``step``. Values are ranked in bins of ``width``."""
    times = materialize(df.select(*group, order).distinct(), "times")
    steps = ranked(times, group, F.floor(F.col(order) / width), [order]).withColumnRenamed("rank", "step")
    return df.join(steps.filter(F.col("step") % k == 0), [*group, order])


def block_mean_2d(df: DataFrame, group: list[str], row: Column, col: Column, k: int, cols: list[str]) -> DataFrame:
    """Means over blocks of k x k of a swath laid out as a matrix: rows are the distinct values of ``row`` in the group, columns
    those of ``col``. Nulls are left out of a mean; incomplete blocks at the ends are trimmed. Groups should be short windows.

    Returns group, block_row, block_col, n (rows of the block) and the means of ``cols``, coordinates among them.
    """
    df = df.withColumns({"_r": row, "_c": col})
    over = lambda c: W.partitionBy(*group).orderBy(c)
    df = df.withColumns({"_ri": F.dense_rank().over(over("_r")) - 1, "_ci": F.dense_rank().over(over("_c")) - 1})
    size = df.groupBy(*group).agg(F.floor((F.max("_ri") + 1) / k).alias("_nr"), F.floor((F.max("_ci") + 1) / k).alias("_nc"))
    b = df.withColumns({"block_row": F.floor(F.col("_ri") / k), "block_col": F.floor(F.col("_ci") / k)}).join(size, group)
    b = b.filter((F.col("block_row") < F.col("_nr")) & (F.col("block_col") < F.col("_nc")))
    return b.groupBy(*group, "block_row", "block_col").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])


def normal_noise(number: Column) -> Column:
    """Standard normal numbers made from a whole number (Box-Muller over two rounds of integer mixing), the same in every run and engine."""
    most = 1 << 31
    mix = lambda x: F.pmod(F.shiftright(x * x, 16), F.lit(most))
    one = mix(F.pmod(F.pmod(number.cast("long"), F.lit(most)) * 1103515245 + 12345, F.lit(most)))
    two = mix(F.pmod(one * 69069 + 1, F.lit(most)))
    return F.sqrt(-2 * F.log((one + 1) / most)) * F.cos(2 * math.pi * two / most)
