"""Queries of the numbered problems on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import packing, reading_level, tokens
from tidemill.sources.tables import materialize, table

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


@query
def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(materialize(tokens.count_tokens(table(spark, sf_dir, "documents")), "sizes"))


@query
def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece_no, n_tokens, container of each file or piece."""
    return _packed(spark, sf_dir)


@query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their used and unused tokens, and the fewest containers that could hold the tokens."""
    c = _packed(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used")).filter("used > 0")
    total = F.sum("used")
    return c.agg(F.count("*").alias("n_containers"), total.alias("n_tokens"), (F.count("*") * packing.CAPACITY - total).alias("n_unused"), F.max("used").alias("most_used"), F.ceil(total / packing.CAPACITY).alias("fewest"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.estimate_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "read_labels"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose estimated level rounds to 4 or 5."""
    return _levels(spark, sf_dir).filter("level >= 3.5").select("doc_id")


@query
def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and spoken words by source and level; documents without spoken prose have no level."""
    level = F.greatest(F.lit(1), F.least(F.lit(5), F.round("level"))).cast("int").alias("level")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(_levels(spark, sf_dir), "doc_id", "left").groupBy("source", level).agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))
