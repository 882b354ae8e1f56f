"""Resampled and binned statistics, scores and detrending."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.sources.tables import materialize


def moments(x: str) -> list[Column]:
    """mean, min, max, count, population variance, median and rms of the given values."""
    c = F.col(x)
    return [F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("count"), F.var_pop(c).alias("variance"), F.sqrt(F.avg(c * c)).alias("rms")]


def resample(df: DataFrame, keys: list[str], x: str, width_s: int = 86400, at: str = "ts") -> DataFrame:
    """Statistics for each time bin and key; adds bin (number of the bin since 1970) and the exact median."""
    df = materialize(df.select(*keys, F.floor(F.col(at) / width_s).alias("bin"), x), "values")
    return df.groupBy(*keys, "bin").agg(*moments(x)).join(exact_median(df, [*keys, "bin"], x), [*keys, "bin"], "left")


def exact_median(df: DataFrame, keys: list[str], x: str, width: float = 0.01) -> DataFrame:
    """keys, median, of the given values, without a state that holds them.

    Distinct values are counted, counts are cumulated over bins of ``width``, and only the one or two bins that hold the
    middle ranks are put in order. ``df`` should be a table.
    """
    seen = materialize(df.filter(F.col(x).isNotNull()).groupBy(*keys, F.floor(F.col(x) / width).alias("_b"), F.col(x).alias("_x")).agg(F.count("*").alias("_c")), "seen")
    bins = seen.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumns({"_before": before, "_all": F.sum("_n").over(W.partitionBy(*keys))})
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))))
    bins = bins.withColumn("_rank", middle).filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    up_to = F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_b", "_rank").orderBy("_x"))
    hit = seen.join(bins.select(*keys, "_b", "_before", "_rank"), [*keys, "_b"]).withColumn("_to", up_to).filter((F.col("_to") > F.col("_rank")) & (F.col("_to") - F.col("_c") <= F.col("_rank")))
    return hit.groupBy(*keys).agg(F.avg("_x").alias("median"))


def with_empty_bins(stats: DataFrame, keys: list[str], at: str = "bin") -> DataFrame:
    """Left join with the full calendar between each key's first and last bin, so that empty bins stand as rows."""
    span = stats.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(at)).join(stats, [*keys, at], "left")


def bin2d(df: DataFrame, x: str, step: float) -> DataFrame:
    """Statistics by the nearest bin of longitude and latitude: index = round((x - x0) / step), population moments."""
    i, j = F.floor(F.col("lon") / step + 0.5).alias("i"), F.floor((F.col("lat") + 90) / step + 0.5).alias("j")
    c = F.col(x)
    return df.filter(c.isNotNull()).groupBy(j, i).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))


def rmse(d: Column) -> Column:
    return F.sqrt(F.avg(d * d))


def daily_scores(df: DataFrame, ref: str, exp: str, min_obs: int = 10, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """rmse, rms of the reference and score = 1 - rmse / rms by run and day; days of fewer than ``min_obs`` are masked."""
    d = F.col(exp) - F.col(ref)
    s = df.groupBy(*keys, F.floor(F.col("ts") / 86400).alias("day")).agg(F.count(d).alias("n"), rmse(d).alias("rmse"), F.sqrt(F.avg(F.col(ref) * F.col(ref))).alias("rms"))
    return s.filter(F.col("n") >= min_obs).withColumn("score", 1 - F.col("rmse") / F.col("rms"))


def leaderboard(daily: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """mu and sigma (population) of the daily score, and the mean rmse of each run."""
    return daily.groupBy(*keys).agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sigma"), F.avg("rmse").alias("rmse"), F.count("*").alias("n_days"))


def plane_fit(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a x + b y + c of each key, from centred sums in one pass of partial aggregates; null where x and y do not span a plane."""
    sxx, syy = F.var_pop(x), F.var_pop(y)
    sxy, sxz, syz = F.covar_pop(x, y), F.covar_pop(x, z), F.covar_pop(y, z)
    m = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).groupBy(*keys).agg(sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), sxz.alias("sxz"), syz.alias("syz"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.count("*").alias("n"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2
    det = F.when(det > 1e-9 * F.col("sxx") * F.col("syy"), det)
    m = m.withColumn("a", (F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy")) / det).withColumn("b", (F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy")) / det)
    return m.withColumn("c", F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).select(*keys, "a", "b", "c", "n")


def cfl_step(speed: Column, dx: Column, cfl: float) -> Column:
    """Largest divisor of 3600 s that is at most cfl * dx / speed."""
    limit = cfl * dx / speed
    divisors = [d for d in range(1, 3601) if 3600 % d == 0]
    return F.array_max(F.filter(F.array(*map(F.lit, divisors)), lambda d: d <= limit))


def coupling(mode: Column, dz: Column, depth: float) -> Column:
    """Vertical integral of a mode's cube over the depth."""
    return F.sum(mode**3 * dz) / depth


def window_norm(decay: float, steps: int = 50) -> float:
    """Largest partial left Riemann sum of the squared cosine over [-decay, decay] in ``steps`` points."""
    total = best = 0.0
    for s in range(steps):
        total += math.cos(math.pi / 2 * (-1 + 2 * s / (steps - 1))) ** 2 * 2 * decay / (steps - 1)
        best = max(best, total)
    return best


def plane_fit_3d(df: DataFrame, keys: list[str], axes: tuple[str, str, str], z: str) -> DataFrame:
    """Least-squares z = a x + b y + c t + d of each key, from centred sums in one pass of partial aggregates (Cramer's rule);
    null where the axes do not span the space."""
    x, y, t = axes
    cov = {f"{p}{q}": F.covar_pop(p, q).alias(f"_{k}{m}") for k, p in zip("xyt", axes) for m, q in zip("xyt", axes)}
    right = [F.covar_pop(p, z).alias(f"_{k}z") for k, p in zip("xyt", axes)]
    m = df.groupBy(*keys).agg(*cov.values(), *right, *[F.avg(p).alias(f"_m{k}") for k, p in zip("xytz", (*axes, z))], F.count("*").alias("n"))
    c = lambda k: F.col(f"_{k}")

    def det(a: list[str], b: list[str], d: list[str]) -> Column:
        return c(a[0]) * (c(b[1]) * c(d[2]) - c(b[2]) * c(d[1])) - c(a[1]) * (c(b[0]) * c(d[2]) - c(b[2]) * c(d[0])) + c(a[2]) * (c(b[0]) * c(d[1]) - c(b[1]) * c(d[0]))

    rows = [[f"{p}{q}" for q in "xyt"] for p in "xyt"]
    whole = det(*rows)
    whole = F.when(whole > 1e-9 * c("xx") * c("yy") * c("tt"), whole)
    swap = lambda k: det(*[[f"{p}z" if n == k else q for n, q in enumerate(r)] for p, r in zip("xyt", rows)])
    m = m.withColumns({name: swap(k) / whole for k, name in enumerate(("a", "b", "c"))})
    return m.withColumn("d", c("mz") - F.col("a") * c("mx") - F.col("b") * c("my") - F.col("c") * c("mt")).select(*keys, "a", "b", "c", "d", "n")
