"""Problem 3: spikes, stuck values and impossible readings, relative to their own source.

Each source's normal behaviour (mean and deviation of its good values, noise of a reading) comes from partial
aggregates. Two state-space models then run over each source in order of time:

* a level that returns to the source's mean at a given rate and is read with noise. A Kalman filter forecasts it; a
  reading whose standardised innovation passes GATE is flagged and its update withheld. The level is held within CLAMP
  deviations of the mean and its variance never exceeds the source's, so that a reading more than LIMIT_SD deviations
  from the mean always has an innovation of at least (LIMIT_SD - CLAMP) / sqrt(2) = 3.5 > GATE: no case is lost.
* a level that is read without noise, whose gain is 1. Its innovations' variance over the last RUN - 1 steps vanishes
  where a source is stuck; the RUN readings that these steps join are flagged.

Sources are cut into blocks of ranked readings, each warmed up on the readings before it, so a source that holds a
third of all rows is spread over many tasks; a task runs many blocks side by side, as columns of one matrix. Readings
flagged by the first model are then held exactly against LIMIT_SD deviations, and all against the physical limits.

Defined results: null and NaN are never flagged; infinite values and those of 1e15 or more always are impossible;
readings without known time are held against the mean, as there is no past, and belong to no run; equal times are
ordered by rec_id; a source whose good values are all equal flags every other value; a source of one reading, or of
none within its limits, flags nothing finite within physical limits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.blocks import ranked, with_halo
from tidemill.operators.regrid import seconds
from tidemill.sources.tables import BROADCAST_ROWS, given, materialize

BLOCK = 2000
HALO = 64
BIN_S = 600
ROWS_A_GROUP = 200_000  # readings whose blocks one call runs side by side
RELAX_S = 21600.0  # time in which the level returns to the mean
GATE = 3.0  # standardised innovation from which an update is withheld
CLAMP = 3.0  # deviations that the level may lie from the mean
LIMIT_SD = 8.0
RUN = 6
HUGE = 1e15


def beyond(value: Column, low: Column, high: Column) -> Column:
    """Physically impossible: infinite, of absurd size, or outside the limits there are."""
    out = lambda c: F.coalesce(c, F.lit(False))
    return (F.abs(value) >= HUGE) | out(value < low) | out(value > high)


def behaviour(values: DataFrame) -> tuple[DataFrame, bool]:
    """(source, good_mean, good_sd of each source; whether they are few enough to broadcast). Possible values within
    LIMIT_SD robust spreads of the median are good.

    Two passes of partial aggregates: quantiles, then moments of the values they admit. Quantiles are of bounded
    error and tolerate that half of the values are wrong, if they lie on both sides.
    """
    values = values.filter("not bad")
    q = values.groupBy("source").agg(F.percentile_approx("value", [0.1, 0.25, 0.5, 0.75, 0.9], 2000).alias("q"))
    # a source mostly stuck has no middle spread; the outer quantiles stand in
    rough = F.greatest((F.col("q")[3] - F.col("q")[1]) / 1.349, (F.col("q")[4] - F.col("q")[0]) / 2.563 / 2)
    q = materialize(q.select("source", F.col("q")[2].alias("centre"), rough.alias("spread")), "quantiles")
    few = q.count() <= BROADCAST_ROWS
    # one row a source; a source with a third of the rows would skew a shuffle join
    good = values.join(F.broadcast(q) if few else q, "source").filter(F.abs(F.col("value") - F.col("centre")) <= LIMIT_SD * F.col("spread"))
    return materialize(good.groupBy("source").agg(F.avg("value").alias("good_mean"), F.stddev_pop("value").alias("good_sd")), "behaviour"), few


def _innovations(v: np.ndarray, t: np.ndarray, mean: np.ndarray, sd: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Standardised innovations; rows are ranks, columns are blocks, and NaN stands below the end of a block."""
    q = np.maximum(sd * sd, 1e-18)  # stationary variance of the level
    r = np.clip(noise * noise, 0.04 * q, q)  # variance of a reading
    x, p, held = np.zeros(v.shape[1]), q.copy(), CLAMP * np.sqrt(q)
    fade = np.exp(-np.maximum(np.diff(t, axis=0, prepend=t[:1]), 0.0) / RELAX_S)
    z = np.empty_like(v)
    for i in range(len(v)):
        f2 = fade[i] * fade[i]
        x, p = fade[i] * x, f2 * p + (1 - f2) * q
        s = p + r
        nu = v[i] - mean - x
        z[i] = nu / np.sqrt(s)
        keep = np.abs(z[i]) <= GATE  # false for NaN
        gain = np.where(keep, p / s, 0.0)
        x = np.clip(x + gain * np.where(keep, nu, 0.0), -held, held)
        p = p * (1 - gain)
    return z


def _stuck(v: np.ndarray) -> np.ndarray:
    """Where the innovations of the level read without noise, v[i] - v[i - 1], have no variance over RUN - 1 steps."""
    if len(v) < RUN:
        return np.zeros(v.shape, bool)
    with np.errstate(invalid="ignore"):
        nu = np.abs(np.diff(v, axis=0))  # of infinite values inf - inf is no number, so they are never stuck
        steps = len(nu) - (RUN - 2)
        deviation = sum(nu[k : k + steps] for k in range(RUN - 1))  # the root of the variance would lose tiny steps to underflow
        ends = deviation == 0
    out = np.zeros(v.shape, bool)
    for k in range(RUN):
        out[k : k + steps] |= ends
    return out


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Flagged readings of the many blocks of one group."""
    pdf = pdf.sort_values(["source", "block", "rank"], kind="stable", ignore_index=True)
    new = np.r_[True, (pdf["block"].to_numpy()[1:] != pdf["block"].to_numpy()[:-1]) | (pdf["source"].to_numpy()[1:] != pdf["source"].to_numpy()[:-1])]
    column = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    row = np.arange(len(pdf)) - first[column]
    shape = (int(row.max()) + 1, len(first))
    v, t = np.full(shape, np.nan), np.full(shape, np.nan)
    v[row, column], t[row, column] = pdf["value"], pdf["t"]
    mean, sd, noise = (pdf[c].to_numpy(float)[first] for c in ("good_mean", "good_sd", "noise"))
    z = _innovations(v, t, mean, sd, np.where(np.isnan(noise), sd, noise))[row, column]
    stuck = _stuck(v)[row, column]
    keep = pdf["own"].to_numpy() & (stuck | (np.abs(z) > GATE) | pdf["bad"].to_numpy())
    return pd.DataFrame({"source": pdf["source"].to_numpy()[keep], "rec_id": pdf["rec_id"].to_numpy()[keep], "value": pdf["value"].to_numpy()[keep], "z": z[keep], "stuck": stuck[keep], "bad": pdf["bad"].to_numpy()[keep]})


def candidates(readings: DataFrame, block: int = BLOCK, halo: int = HALO) -> tuple[DataFrame, DataFrame]:
    """(source, rec_id, value, z, stuck, bad of the readings that a model flags or a limit excludes; behaviour of the sources)."""
    assert halo >= RUN - 1
    base = readings.filter(F.col("source").isNotNull() & F.col("rec_id").isNotNull() & given(F.col("value")))
    base = materialize(base.select("source", "rec_id", seconds(F.col("time")).alias("t"), "value", beyond(F.col("value"), F.col("low"), F.col("high")).alias("bad")), "readings")
    normal, few = behaviour(base)
    normal = F.broadcast(normal) if few else normal
    order = ["t", "rec_id"]
    bin_ = F.floor(F.col("t") / BIN_S)
    timed = ranked(base.filter("t is not null"), ["source"], bin_, order)
    # the step from the reading before in the same bin, for the noise of the source
    timed = materialize(timed.withColumn("step", F.abs(F.col("value") - F.lag("value").over(W.partitionBy("source", bin_).orderBy(*order)))), "ranked")
    near = timed.join(normal, "source").filter(F.abs(F.col("value") - F.col("good_mean")) <= LIMIT_SD * F.col("good_sd"))
    noise = near.groupBy("source").agg((F.percentile_approx("step", 0.5, 2000) * 1.4826 / math.sqrt(2)).alias("noise"))
    own = normal.join(F.broadcast(noise) if few else noise, "source", "left")
    cut = with_halo(timed.drop("step"), block, halo).join(F.broadcast(own) if few else own, "source", "left")
    groups = max(1, -(-timed.count() // ROWS_A_GROUP))
    flagged = cut.groupBy(F.pmod(F.xxhash64("source", "block"), F.lit(groups)).alias("group")).applyInPandas(_blocks, "source string, rec_id long, value double, z double, stuck boolean, bad boolean")
    loose = base.filter("t is null").join(normal, "source", "left")
    z = (F.col("value") - F.col("good_mean")) / (F.greatest("good_sd", F.lit(1e-9)) * math.sqrt(2))
    loose = loose.select("source", "rec_id", "value", z.alias("z"), F.lit(False).alias("stuck"), "bad").filter((F.abs("z") > GATE) | F.col("bad"))
    return flagged.unionByName(loose), normal


def implausible(readings: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """``readings``: source, rec_id, time (null if unknown), value, low, high (physical limits, may be null).

    Rows without source or rec_id are no readings and are left out. Returns source, rec_id, value, innovation
    (standardised), spike, stuck, impossible; one row for each flagged one, whatever the size of the blocks.
    """
    flagged, normal = candidates(readings, block, halo)
    spike = F.coalesce(F.abs(F.col("value") - F.col("good_mean")) > LIMIT_SD * F.col("good_sd"), F.lit(False))
    checked = flagged.join(normal, "source", "left")
    return checked.select("source", "rec_id", "value", F.col("z").alias("innovation"), spike.alias("spike"), "stuck", F.col("bad").alias("impossible")).filter("spike or stuck or impossible")
