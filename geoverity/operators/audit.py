"""Audit trail (F17-F19): per-candidate entries, per-centre report and its
text rendering. Per-centre lists are bounded by the candidate limit (at most 5
per provider and query), so collecting a centre's entries is safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import py_fixed
from .fusion import category_scores

RULE = "=" * 60


def audit_entries(decided: DataFrame) -> DataFrame:
    """one entry per candidate: decision, confidence rounded to 4 dp,
    signals, category scores and the raw fused score."""
    return decided.select(
        "pos", "cand_pos", "candidate_id", "provider", "latitude", "longitude",
        F.col("state").alias("decision"), py_fixed("calibrated_confidence", 4).cast("double").alias("confidence"),
        "positive_signals", "negative_signals", category_scores().alias("category_scores"),
        F.col("total_score").alias("raw_score"))


def _pct1(x: Column) -> Column:
    return F.concat(py_fixed(x * 100.0, 1), F.lit("%"))


def summary_text(e: Column) -> Column:
    """``Accepted <provider> candidate (lat, lon) with x% confidence[ based on
    n positive signals].``"""
    n = F.size(e["positive_signals"])
    return F.concat(
        F.lit("Accepted "), e["provider"], F.lit(" candidate ("), py_fixed(e["latitude"], 4), F.lit(", "),
        py_fixed(e["longitude"], 4), F.lit(") with "), _pct1(e["confidence"]), F.lit(" confidence"),
        F.when(n > 0, F.concat(F.lit(" based on "), n.cast("string"), F.lit(" positive signals")))
         .otherwise(F.lit("")), F.lit("."))


def audit_report(entries: DataFrame, best_ids: DataFrame, refs: DataFrame,
                 timestamp: str) -> DataFrame:
    """per centre the ordered entries, the verifier's best candidate id and
    a summary of the first non-Rejected entry (else the first)."""
    fields = [c for c in entries.columns if c != "pos"]
    grouped = entries.groupBy("pos").agg(
        F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(
            a["cand_pos"] < b["cand_pos"], -1).when(a["cand_pos"] > b["cand_pos"], 1).otherwise(0))
        .alias("entries"))
    first_ok = F.coalesce(F.try_element_at(F.filter("entries", lambda e: e["decision"] != K.REJECTED), F.lit(1)),
                          F.try_element_at("entries", F.lit(1)))
    return (grouped.join(best_ids, "pos", "left").join(refs, "pos", "left")
                   .select("pos", "reference_id", "reference_name", F.lit(timestamp).alias("timestamp"),
                           "entries", "best_candidate_id", summary_text(first_ok).alias("summary")))


def _entry_text(e: Column, i: Column, best: Column) -> Column:
    scores = F.transform(F.array(*[F.lit(c) for c in K.CATEGORY_WEIGHTS]), lambda c: F.concat(
        F.lit("    "), F.rpad(c, 12, " "), F.lit(" ["),
        F.repeat(F.lit("█"), F.floor(F.element_at(e["category_scores"], c) * 20).cast("int")),
        F.repeat(F.lit("░"), 20 - F.floor(F.element_at(e["category_scores"], c) * 20).cast("int")),
        F.lit("] "), py_fixed(F.element_at(e["category_scores"], c), 3)))
    pos = F.when(F.size(e["positive_signals"]) > 0, F.array_join(F.concat(
        F.array(F.lit("\n  ✓ Positive Signals:")),
        F.transform(e["positive_signals"], lambda s: F.concat(F.lit("    + "), s))), "\n"))
    neg = F.when(F.size(e["negative_signals"]) > 0, F.array_join(F.concat(
        F.array(F.lit("\n  ✗ Negative Signals:")),
        F.transform(e["negative_signals"], lambda s: F.concat(F.lit("    - "), s))), "\n"))
    head = F.concat(
        F.lit("\n--- Candidate "), i.cast("string"),
        F.when(e["candidate_id"] == best, F.lit(" ★ BEST")).otherwise(F.lit("")), F.lit(" ---\n"),
        F.lit("  Provider: "), e["provider"], F.lit("\n"),
        F.lit("  Location: ("), py_fixed(e["latitude"], 6), F.lit(", "), py_fixed(e["longitude"], 6),
        F.lit(")\n"),
        F.lit("  Decision: "), e["decision"], F.lit("\n"),
        F.lit("  Confidence: "), _pct1(e["confidence"]), F.lit("\n"),
        F.lit("  Raw Score: "), py_fixed(e["raw_score"], 4), F.lit("\n"),
        F.lit("\n  Evidence Breakdown:\n"), F.array_join(scores, "\n"))
    return F.concat_ws("\n", head, pos, neg)


def audit_text(report: DataFrame) -> DataFrame:
    """the report rendered as text (20-cell bars per category)."""
    body = F.transform("entries", lambda e, i: _entry_text(e, i + 1, F.col("best_candidate_id")))
    lines = F.concat(
        F.array(F.lit(RULE), F.concat(F.lit("AUDIT REPORT: "), F.col("reference_name")),
                F.concat(F.lit("Reference ID: "), F.col("reference_id")),
                F.concat(F.lit("Timestamp: "), F.col("timestamp")), F.lit(RULE)),
        body,
        F.array(F.concat(F.lit("\n"), F.lit(RULE))),
        F.when(F.coalesce(F.col("summary"), F.lit("")) != "",
               F.array(F.concat(F.lit("SUMMARY: "), F.col("summary")))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit(RULE)))
    return report.select("pos", F.array_join(lines, "\n").alias("text"))
