"""Writers for the engine's outputs (K1-K6). All are distributed writes: JSON
lines or CSV part files written by every task, never one array or one file
assembled in a single task. Reports always overwrite and carry a header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .merge import value_text


def save_centres(centres: DataFrame, path: str) -> None:
    """K1: normalised centres as JSON lines (UTF-8, non-ASCII kept as is)."""
    centres.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_dataset_envelope(centres: DataFrame, path: str, generated_at: str) -> DataFrame:
    """K2: ``metadata`` (generated_at, total_centres, version) as a one-line
    sidecar next to the centres written as JSON lines; returns the metadata."""
    meta = centres.agg(F.count(F.lit(1)).alias("total_centres")).select(
        F.lit(generated_at).alias("generated_at"), "total_centres", F.lit(K.DATASET_VERSION).alias("version"))
    centres.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/centres")
    meta.write.mode("overwrite").json(f"{path}/metadata")
    return meta


def failed_report(failed: DataFrame, path: str) -> None:
    """K3: id, name, city, state, country, latitude, longitude,
    failure_reasons ("; "-joined), failed_at."""
    reasons = F.col("failure_reasons")
    if failed.schema["failure_reasons"].dataType.typeName() == "array":
        reasons = F.array_join(reasons, "; ")
    out = failed.select("id", "name", "city", "state", "country", value_text(F.col("latitude"), True).alias("latitude"),
                        value_text(F.col("longitude"), True).alias("longitude"), reasons.alias("failure_reasons"),
                        "failed_at")
    out.write.mode("overwrite").option("header", True).csv(path)


def changes_report(changes: DataFrame, path: str) -> None:
    """K4: id, name, field, old_value, new_value."""
    changes.select("id", "name", "field", "old_value", "new_value").write.mode("overwrite") \
        .option("header", True).csv(path)


def duplicates_report(duplicates: DataFrame, path: str) -> None:
    """K5: all rows of duplicate coordinate groups."""
    duplicates.select("id", "name", "city", "state", "country",
                      value_text(F.col("latitude"), True).alias("latitude"),
                      value_text(F.col("longitude"), True).alias("longitude")) \
        .write.mode("overwrite").option("header", True).csv(path)


def save_transformed(records: DataFrame, path: str) -> None:
    """K6: reshaped records (``record`` struct) as JSON lines."""
    records.select("record.*").write.mode("overwrite").json(path)
