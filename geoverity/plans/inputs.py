"""Stand-in inputs in the schemas the operators expect, built from the driver's
tables (see ``sources.fixtures``). They re-shape rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import view


def centres(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "centres")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Fixture candidates with their raw provider record as JSON text."""
    c = view(spark, sf, "candidates")
    raw = F.when(F.col("raw_type") == "", F.lit("{}")).otherwise(
        F.to_json(F.struct(F.col("raw_type").alias("type"))))
    return c.withColumn("raw", raw)


def existing(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "existing")


def cache_log(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "cache_log")


def landed_files(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "landed_files")
