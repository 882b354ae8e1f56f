"""Sinks: files per window, upsert of variables, appended logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_windows(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per window; rows are brought together by window first, so that a window is few files, however many tasks read it."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` does not have; columns that one lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_variables(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full join on the keys: variables of ``new`` stand over those of ``old`` where they are given."""
    variables = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    a, b = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys]), new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys])
    sides = lambda v: [F.col(f"{p}{v}") for p, d in (("_n_", new), ("_o_", old)) if v in d.columns]
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(*sides(v)).alias(v) for v in variables])


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log table, such as the costs of each iteration."""
    df.write.mode("append").parquet(path)
