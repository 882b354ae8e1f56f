"""Track segments: gaps, sub-segments and their spectra."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.blocks import ranked, with_halo
from tidemill.sources.tables import materialize

BLOCK = 50000  # ranked rows of a source that one task holds


def sessions(df: DataFrame, source: str, at: str, tie: str, gap_s: float, block: int = BLOCK, bin_s: int = 3600) -> DataFrame:
    """Add seg (0, 1, ...), pos, rank and block to each row: a new segment begins where more than ``gap_s`` lie before a row.

    Exact for sources of any length: rows are ranked by bins, the step before each is taken in blocks that overlap by
    one row, and segments are numbered by cumulating the blocks' counts. No window holds a whole source.
    """
    df = materialize(df, "track")
    r = ranked(df, [source], F.floor(F.col(at) / bin_s), [at, tie])
    by = W.partitionBy(source, "block").orderBy("rank")
    new = F.coalesce((F.col(at) - F.lag(at).over(by) > gap_s).cast("int"), F.lit(0))
    cut = materialize(with_halo(r, block, 1).withColumn("_new", new).filter("own").drop("own"), "steps")
    begins = F.when(F.col("_new") == 1, F.col("rank"))
    # of the blocks before: how many segments began, and where the last one did
    earlier = W.partitionBy(source).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offset = cut.groupBy(source, "block").agg(F.sum("_new").alias("_n"), F.max(begins).alias("_last"))
    offset = offset.select(source, "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.max("_last").over(earlier), F.lit(0)).alias("_first"))
    out = cut.join(offset, [source, "block"]).withColumn("seg", F.col("_before") + F.sum("_new").over(by))
    out = out.withColumn("pos", F.col("rank") - F.coalesce(F.max(begins).over(by), F.col("_first")))
    return out.drop("_new", "_before", "_first")


def distances(track: DataFrame, source: str, step: Callable[[Column, Column, Column, Column], Column], block: int = BLOCK) -> DataFrame:
    """Rows of ``sessions`` with d: ``step`` (lat, lon of the row before, lat, lon), null at the start of a segment, and run: d
    cumulated along the segment.

    ``block`` is that of ``sessions``. The row before is looked up in blocks that overlap by one row, and blocks are cumulated by segment, so that a
    segment of any length is spread over tasks.
    """
    edge = track.filter(F.col("rank") + 1 == (F.col("block") + 1) * block).select(source, (F.col("block") + 1).alias("block"), "rank", "seg", "lat", "lon", F.lit(False).alias("own"))
    both = track.withColumn("own", F.lit(True)).unionByName(edge, allowMissingColumns=True)
    by = W.partitionBy(source, "block").orderBy("rank")
    same = F.lag("seg").over(by) == F.col("seg")
    d = F.when(same, step(F.lag("lat").over(by), F.lag("lon").over(by), F.col("lat"), F.col("lon")))
    out = materialize(both.withColumn("d", d).filter("own").drop("own"), "steps")
    whole = out.groupBy(source, "seg", "block").agg(F.sum("d").alias("_d"))
    before = whole.select(source, "seg", "block", F.coalesce(F.sum("_d").over(W.partitionBy(source, "seg").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    run = F.col("_before") + F.coalesce(F.sum("d").over(W.partitionBy(source, "seg", "block").orderBy("rank")), F.lit(0.0))
    return out.join(before, [source, "seg", "block"]).withColumn("run", run).drop("_before")


def sub_segments(df: DataFrame, keys: list[str], npt: int, stride: int, cols: list[str]) -> DataFrame:
    """Windows of ``npt`` consecutive rows of each segment, one every ``stride`` rows; incomplete ones are left out.

    ``df`` has ``pos`` in the segment. Each row goes to the few windows that hold it, then one aggregate builds the
    window's arrays, each of npt values. Returns keys, sub and the arrays.
    """
    first = F.greatest(F.ceil((F.col("pos") - npt + 1) / stride), F.lit(0))
    w = df.withColumn("sub", F.explode(F.sequence(first, F.floor(F.col("pos") / stride))))
    rows = F.sort_array(F.collect_list(F.struct("pos", *cols)))
    g = w.groupBy(*keys, "sub").agg(rows.alias("_r")).filter(F.size("_r") == npt)
    return g.select(*keys, "sub", *[F.col("_r")[c].alias(c) for c in cols])


def _spectra(batches: Iterable[pa.RecordBatch], keys: list[str], cols: list[str], dx: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [b.column(k) for k in keys]
        for c in cols:
            n = len(b)
            x = b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 2))
            npt = x.shape[1]
            hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(npt) / npt))
            p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * hann, axis=1)) ** 2 * dx / (hann**2).sum()
            p[:, 1 : (npt + 1) // 2] *= 2
            out.append(pa.array(list(p), pa.list_(pa.float64())))
        yield pa.RecordBatch.from_arrays(out, [*keys, *cols])


def welch(df: DataFrame, keys: dict[str, str], cols: list[str], dx: float) -> DataFrame:
    """Power spectral density of each array: constant detrend, periodic Hann window, one-sided, density scaling.

    Arrow batches of many windows at once, one real FFT for each batch.
    """
    schema = ", ".join([*[f"{k} {t}" for k, t in keys.items()], *[f"{c} array<double>" for c in cols]])
    names, cs = list(keys), list(cols)
    return df.select(*names, *cs).mapInArrow(lambda it: _spectra(it, names, cs, dx), schema)


def resolved_scale(spectra: DataFrame, k: str, noise: str, signal: str) -> DataFrame:
    """Wavelength where 1 - noise / signal crosses 0.5, by linear interpolation between neighbouring wavenumbers."""
    order = W.orderBy(k)  # a handful of wavenumbers, already averaged over all segments
    s = spectra.filter(F.col(k) > 0).withColumn("score", 1 - F.col(noise) / F.col(signal)).withColumn("wl", 1 / F.col(k))
    s = s.withColumn("s0", F.lag("score").over(order)).withColumn("w0", F.lag("wl").over(order))
    crossing = s.filter(F.col("s0").isNotNull() & ((F.col("s0") - 0.5) * (F.col("score") - 0.5) <= 0) & (F.col("s0") != F.col("score")))
    return crossing.select((F.col("w0") + (0.5 - F.col("s0")) / (F.col("score") - F.col("s0")) * (F.col("wl") - F.col("w0"))).alias("wavelength"))
