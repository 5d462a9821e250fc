"""Report-shaped outputs: map layer (K8) and run metrics (K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_duration, py_fixed


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def map_layer(centres: DataFrame) -> DataFrame:
    """K8: markers for rows with coordinates (``latitude``/``lat`` and
    ``longitude``/``lng`` aliases), popup detail text and 5-dp coordinates."""
    lat = F.coalesce(_opt(centres, "latitude"), _opt(centres, "lat"))
    lon = F.coalesce(_opt(centres, "longitude"), _opt(centres, "lng"))

    def part(col, sep):
        c = F.coalesce(F.col(col), F.lit(""))
        return F.when(c != "", F.concat(F.lit(sep), c)).otherwise(F.lit(""))
    detail = F.concat(F.coalesce(F.col("address"), F.lit("")), part("city", ", "), part("state", ", "),
                      part("country", " · "))
    return (centres.withColumn("_lat", lat).withColumn("_lon", lon)
                   .filter(F.col("_lat").isNotNull() & F.col("_lon").isNotNull())
                   .select("pos", "id", "name", detail.alias("popup_detail"),
                           F.concat(py_fixed(F.col("_lat"), 5), F.lit(", "), py_fixed(F.col("_lon"), 5))
                           .alias("popup_coord")))


def map_bounds(centres: DataFrame) -> DataFrame:
    """K8: marker count and bounding box."""
    lat = F.coalesce(_opt(centres, "latitude"), _opt(centres, "lat"))
    lon = F.coalesce(_opt(centres, "longitude"), _opt(centres, "lng"))
    d = centres.select(lat.alias("la"), lon.alias("lo")).filter(F.col("la").isNotNull() & F.col("lo").isNotNull())
    return d.agg(F.count(F.lit(1)).alias("markers"), F.min("la").alias("min_lat"), F.max("la").alias("max_lat"),
                 F.min("lo").alias("min_lon"), F.max("lo").alias("max_lon"))


def pipeline_stats(centres: DataFrame, outcome: DataFrame, validation: DataFrame, update: DataFrame,
                   usage: DataFrame) -> DataFrame:
    """K7 metrics: one row built from single-row aggregates (each input is
    aggregated map-side first) placed side by side without a join."""
    from .merge import side_by_side
    a = (centres.agg(F.count(F.lit(1)).alias("total_centres")))
    b = (outcome.agg(F.sum(F.when(F.col("geocoded"), 1).otherwise(0)).cast("long").alias("geocoded_centres")))
    c = (validation.agg(F.sum(F.when(~F.col("is_valid"), 1).otherwise(0)).cast("long").alias("failed_centres"),
                            *[F.sum(F.when(F.coalesce(F.col("reason"), F.lit("")).startswith(p), 1).otherwise(0))
                              .cast("long").alias(f"check_{p}") for p in
                              ["missing_coordinates", "ocean_coordinates", "wrong_country", "duplicate_id",
                               "duplicate_coords", "low_confidence"]]))
    d = update.select("new_centres", "updated_centres", "removed_centres")
    e = (usage.agg(F.coalesce(F.sum("calls"), F.lit(0)).cast("long").alias("api_calls"),
                       F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "calls"))))
                       .alias("provider_usage")))
    return side_by_side(a, b, c, d, e).withColumn("cache_hits", F.lit(0).cast("long"))


def summary_report_md(stats: DataFrame, generated: str, runtime_sec: float, download_status: int = 0,
                      download_format: str = "unknown", download_size: int = 0, raw_file: str = "") -> DataFrame:
    """K7 text: the Markdown summary for one metrics row (thousands separators,
    runtime ``12.3s`` / ``2m 3.4s``, provider lines only for providers with calls)."""
    prov = F.filter(F.map_entries("provider_usage"), lambda e: e["value"] > 0)
    prov_lines = F.when(F.size(prov) > 0, F.array_join(F.transform(prov, lambda e: F.format_string(
        "  - **%s**: %d calls", e["key"], e["value"])), "\n")).otherwise(F.lit("  - No provider calls"))
    checks = ["missing_coordinates", "ocean_coordinates", "wrong_country", "duplicate_id", "duplicate_coords",
              "low_confidence"]
    check_lines = F.concat(*[F.format_string(f"| {c} | %d |\n", F.col(f"check_{c}")) for c in checks])
    text = F.concat(
        F.lit(f"# Centre Update Report\n\nGenerated: {generated}\n\n## Pipeline Summary\n\n"
              "| Metric | Value |\n|--------|-------|\n| Runtime | "), format_duration(F.lit(float(runtime_sec))),
        F.lit(f" |\n| Download Status | HTTP {download_status} |\n| Response Format | {download_format} |\n"
              "| Download Size | "), F.format_number(F.lit(download_size), 0),
        F.lit(f" bytes |\n| Raw File | {raw_file} |\n\n## Centre Statistics\n\n| Metric | Count |\n"
              "|--------|-------|\n| Total Centres | "), F.col("total_centres").cast("string"),
        F.lit(" |\n| New Centres | "), F.col("new_centres").cast("string"),
        F.lit(" |\n| Updated Centres | "), F.col("updated_centres").cast("string"),
        F.lit(" |\n| Removed Centres | "), F.col("removed_centres").cast("string"),
        F.lit(" |\n| Failed Centres | "), F.col("failed_centres").cast("string"),
        F.lit(" |\n| Geocoded Centres | "), F.col("geocoded_centres").cast("string"),
        F.lit(" |\n\n## API Usage\n\n| Metric | Count |\n|--------|-------|\n| Cache Hits | "),
        F.col("cache_hits").cast("string"), F.lit(" |\n| API Calls | "), F.col("api_calls").cast("string"),
        F.lit(" |\n\n### Provider Usage\n\n"), prov_lines,
        F.lit("\n\n## Validation\n\n| Check | Result |\n|-------|--------|\n"), check_lines)
    return stats.select(text.alias("markdown"))
