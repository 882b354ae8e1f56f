"""Assimilation windows, as-of joins and interpolation in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.blocks import around


def assign_windows(df: DataFrame, width_s: int, at: str = "ts") -> DataFrame:
    """Half-open windows centred on multiples of the width: each row falls into one; adds window_ts. No shuffle."""
    no = F.floor((F.col(at) + width_s / 2) / width_s)
    return df.withColumn("window_ts", F.timestamp_seconds(no * width_s).cast("timestamp_ntz"))


def assign_windows_closed(df: DataFrame, width_s: int, at: str = "ts") -> DataFrame:
    """Windows closed at both ends: a row on a border falls into both; adds window_no."""
    first = F.ceil((F.col(at) - width_s / 2) / width_s)
    no = F.explode(F.array(first, first + 1))
    inside = F.col(at).between(F.col("window_no") * width_s - width_s / 2, F.col("window_no") * width_s + width_s / 2)
    return df.withColumn("window_no", no).filter(inside)


def nearest_step(df: DataFrame, dt: float, start: float, tolerance: float, at: str = "ts") -> DataFrame:
    """Nearest step of a regular model clock, kept within the tolerance, the earlier on ties; adds step, lag_s."""
    pos = (F.col(at) - start) / dt
    step = F.ceil(pos - 0.5)
    out = df.withColumn("step", step.cast("long")).withColumn("lag_s", F.col(at) - (F.col("step") * dt + start))
    return out.filter((F.abs("lag_s") <= tolerance) & (F.col("step") >= 0))


def nearest_rows(left: DataFrame, right: DataFrame, on: list[str], lt: str, rt: str, value: str, reach: float) -> DataFrame:
    """For each left row the right row of the same key that is nearest in time within ``reach``, the earlier on ties.

    A bucketed equi-join: times fall into buckets of 2 * reach, the right side is copied to the bucket beside it, so a
    left row meets only rows near it; then one aggregate keeps the nearest. Left rows without a match are left out.
    """
    width = 2 * reach
    l_ = left.withColumn("_b", F.floor(F.col(lt) / width))
    near = F.array_distinct(F.array(F.floor((F.col("_rt") - reach) / width), F.floor((F.col("_rt") + reach) / width)))
    r_ = right.select(*on, F.col(rt).alias("_rt"), F.col(value).alias("_v")).withColumn("_b", F.explode(near))
    j = l_.join(r_, [*on, "_b"]).withColumn("_d", F.abs(F.col("_rt") - F.col(lt))).filter(F.col("_d") <= reach)
    best = F.min(F.struct("_d", "_rt", "_v")).alias("m")
    keys = [c for c in left.columns]
    return j.groupBy(*keys).agg(best).select(*keys, F.col("m._rt").alias("near_t"), F.col("m._v").alias("near_v"))


def _samples_and_targets(targets: DataFrame, samples: DataFrame, on: list[str], lt: str, rt: str, value: str) -> DataFrame:
    """One relation of both, with _target 0 for samples and 1 for targets, _t and _v; targets keep their other columns."""
    extra = [c for c in targets.columns if c not in on]
    s = samples.filter(F.col(value).isNotNull()).select(*on, F.col(rt).alias("_t"), F.lit(0).alias("_target"), F.col(value).cast("double").alias("_v"))
    t = targets.select(*on, F.col(lt).alias("_t"), F.lit(1).alias("_target"), F.lit(None).cast("double").alias("_v"), *extra)
    return s.unionByName(t, allowMissingColumns=True)


def nearest_sample(left: DataFrame, right: DataFrame, on: list[str], lt: str, rt: str, value: str, width: float) -> DataFrame:
    """For each left row the right row of the same key that is nearest in time, however far, the earlier on ties.

    The samples around each left row are found in buckets of ``width`` seconds. Of samples of one key and time the smallest
    value holds. Left rows whose key has no value are left out.
    """
    one = right.filter(F.col(value).isNotNull()).groupBy(*on, rt).agg(F.min(value).alias(value))
    u = around(_samples_and_targets(left, one, on, lt, rt, value), on, "_t", "_target", "_v", width).filter("_target = 1 and (_t0 is not null or _t1 is not null)")
    first = F.col("_t1").isNull() | (F.col("_t") - F.col("_t0") <= F.col("_t1") - F.col("_t"))
    pick = lambda c: F.when(F.col("_t0").isNotNull() & first, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    return u.select(*left.columns, pick("_t").alias("near_t"), pick("_v").alias("near_v"))


def lerp_in_time(targets: DataFrame, samples: DataFrame, on: list[str], value: str, width: float = 86400.0) -> DataFrame:
    """Linear interpolation of ``value`` (samples: on, ts, value) at the targets' (on, ts); held constant outside.

    One union; the last sample at or before and the first at or after each target are found in buckets of ``width`` seconds.
    """
    u = around(_samples_and_targets(targets.select(*on, "ts"), samples, on, "ts", "ts", value), on, "_t", "_target", "_v", width).filter("_target = 1")
    alpha = F.when(F.col("_t1") > F.col("_t0"), (F.col("_t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))).otherwise(0.0)
    lerp = F.col("_v0") + alpha * (F.col("_v1") - F.col("_v0"))
    return u.select(*on, "ts", F.coalesce(lerp, F.col("_v0"), F.col("_v1")).alias("v"))
