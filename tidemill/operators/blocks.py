"""Exact ranks and bounded blocks of an ordered source, without putting a source into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.sources.tables import materialize


def ranked(df: DataFrame, source: list[str], bin_: Column, order: list[str]) -> DataFrame:
    """Add ``rank``: the exact 0-based position of each row within its source, ordered by (bin, order).

    ``bin_`` is a coarse, order-preserving number (a span of time). Rows are counted by bin with a partial
    aggregate; bins are cumulated per source; rows are numbered within their own bin. The largest group any task
    sorts is one bin of one source, however many rows the source has. ``df`` is read twice, so it should be a table.
    """
    df = df.withColumn("_bin", bin_)
    counts = df.groupBy(*source, "_bin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*source).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*source, "_bin", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(*source, "_bin").orderBy(*order)) - 1
    out = df.withColumn("_in", within).join(offsets, [*source, "_bin"])
    return out.withColumn("rank", F.col("_before") + F.col("_in")).drop("_bin", "_in", "_before")


def with_halo(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Cut ranked rows into blocks of ``size``; each row is also copied to the blocks within ``halo`` ranks of it.

    Adds ``block`` and ``own`` (false for a copy). Every block has at most size + 2 * halo rows.
    """
    first = F.floor(F.greatest(F.col("rank") - halo, F.lit(0)) / size)
    last = F.floor((F.col("rank") + halo) / size)
    return df.withColumn("block", F.explode(F.sequence(first, last))).withColumn("own", F.col("block") == F.floor(F.col("rank") / size))


def around(df: DataFrame, keys: list[str], at: str, tie: str, value: str, width: float) -> DataFrame:
    """Add _t0, _v0: time and value of the last row of the same keys at or before each row that has a value, and _t1, _v1
    of the first at or after it; null where there is none. Equal times are ordered by ``tie``, on both sides.

    Rows are looked at in buckets of ``width`` seconds; what lies beyond a bucket's ends comes from one row a bucket, so
    that no task holds the history of a key.
    """
    df = df.withColumn("_b", F.floor(F.col(at) / width))
    found = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(tie).alias("k"), F.col(value).alias("v")))
    ends = df.groupBy(*keys, "_b").agg(F.min(found).alias("_lo"), F.max(found).alias("_hi"))
    up, down = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "_b", F.last("_hi", True).over(up).alias("_before"), F.last("_lo", True).over(down).alias("_after"))
    inside = W.partitionBy(*keys, "_b")
    back = inside.orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)
    ahead = inside.orderBy(F.desc(at), tie).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_s", found).withColumns({"_0": F.last("_s", True).over(back), "_1": F.last("_s", True).over(ahead)}).join(ends, [*keys, "_b"], "left")
    pick = {f"_{c}{n}": F.coalesce(F.col(f"_{n}.{c}"), F.col(f"{far}.{c}")) for n, far in ((0, "_before"), (1, "_after")) for c in "tv"}
    return df.withColumns(pick).drop("_b", "_s", "_0", "_1", "_before", "_after")
