"""Registered queries: the flagship job and the stages that depend on string
similarity (no SQL oracle; covered by tests against brute-force models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import inputs
from .geocode import geocode_centres, geocode_stats, state_breakdown, verify_candidates
from .registry import r6, register


@register("geocode_centres")
def q_geocode(spark, sf):
    """F15 with ``force``: every centre is verified against its candidates."""
    return r6(geocode_centres(inputs.centres(spark, sf), inputs.candidates(spark, sf), force=True))


@register("geocode_pending")
def q_geocode_pending(spark, sf):
    """F15 default mode: centres with both coordinates are skipped as cached."""
    return r6(geocode_centres(inputs.centres(spark, sf), inputs.candidates(spark, sf), force=False))


@register("geocode_stats")
def q_geocode_stats(spark, sf):
    return geocode_stats(geocode_centres(inputs.centres(spark, sf), inputs.candidates(spark, sf)))


@register("state_breakdown")
def q_state_breakdown(spark, sf):
    return state_breakdown(geocode_centres(inputs.centres(spark, sf), inputs.candidates(spark, sf), force=True))


@register("decide_all")
def q_decide_all(spark, sf):
    d = verify_candidates(inputs.centres(spark, sf), inputs.candidates(spark, sf), force=True)
    return r6(d.filter(F.col("cand_pos").isNotNull()).select(
        "pos", "cand_pos", "provider", "state", "is_accepted", "calibrated_confidence", "raw_score",
        "uncertainty", "rejection_reasons"))


def _stats(spark, sf):
    from ..operators import candidates as C
    from ..operators import merge as U
    from ..operators import validate as V
    from ..operators.reports import pipeline_stats
    cen = inputs.centres(spark, sf)
    outcome = geocode_centres(cen, inputs.candidates(spark, sf))
    return pipeline_stats(cen, outcome, V.validate_centres(cen),
                          U.update_summary(inputs.existing(spark, sf), cen),
                          C.provider_usage(inputs.candidates(spark, sf)))


@register("summary_metrics")
def q_k7_metrics(spark, sf):
    return _stats(spark, sf)


@register("summary_report_md")
def q_k7_text(spark, sf):
    from ..operators.reports import summary_report_md
    return summary_report_md(_stats(spark, sf), "2024-01-10 00:00:00", 83.4, 200, "json", 1234567,
                             "landing/raw.json")
