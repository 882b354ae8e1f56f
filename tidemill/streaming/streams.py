"""Structured Streaming twins of the batch queries on windows and sessions.

Each runs over files as an unbounded source with trigger(availableNow): everything there is read in micro-batches, state
and progress live in a checkpoint folder, and results go to a Parquet sink, so a run that dies resumes where it stopped
and nothing passes through the driver. Point the same functions at a longer-lived trigger for a live stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidemill.sources.tables import new_folder


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream; the schema is taken from the files that are there."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parque[t]")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is available into a table of the shared folder and read it back."""
    spark = stream.sparkSession
    at = new_folder(spark, f"stream-{name}")
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def tumbling(events: DataFrame, at: str, width: str, late: str, keys: list[str], offset: str | None = None) -> DataFrame:
    """Rows per window and key; a window is emitted once the watermark has passed its end."""
    w = F.window(at, width, width, offset) if offset else F.window(at, width)
    g = events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sliding(events: DataFrame, at: str, width: str, slide: str, late: str, keys: list[str], value: str) -> DataFrame:
    w = F.window(at, width, slide)
    g = events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of each key that end after ``gap`` without a row; exactly the gap still joins no longer (rows at the gap start anew)."""
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """First delivery of each key within the watermark's delay; state is dropped as the watermark passes."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_in_turns(batches: list[DataFrame], work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Deliver ``batches`` one after the other to one stream, each followed by a run over what is new, and return all that was put out.

    Each run takes up the checkpoint of the run before: offsets, watermark and state are handed over.
    """
    spark = batches[0].sparkSession
    at = new_folder(spark, f"stream-{name}")
    for n, batch in enumerate(batches):
        batch.write.parquet(f"{at}/in/turn={n}")
        stream = spark.readStream.schema(batch.schema).parquet(f"{at}/in/turn=*")
        out = work(stream)
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def handed_over(events: DataFrame, key: str, at: str, value: str, decay_s: float) -> DataFrame:
    """key, n, last, state after each micro-batch: the sum of ``value`` weighted by exp(-age / decay_s), age being counted from the
    key's last event (``at``, in seconds). What is kept of a key is one row, whatever its history; the order of events does not matter."""

    def step(k: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, total = state.get if state.exists else (0, -math.inf, 0.0)
        for p in parts:
            t, v = p[at].to_numpy(float), p[value].to_numpy(float)
            now = max(last, float(t.max()))
            total = (total * math.exp((last - now) / decay_s) if n else 0.0) + float((v * np.exp((t - now) / decay_s)).sum())
            n, last = n + len(p), now
        state.update((n, last, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last": [last], "state": [total]})

    e = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).select(key, at, value)
    kind = dict(e.dtypes)[key]
    return e.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, last double, state double", "n long, last double, state double", "append", "NoTimeout")
