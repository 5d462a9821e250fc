"""State classification, hard rejections and best-candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import kept_texts


def classify_state(conf, thresholds: list[tuple[str, float]] | None = None) -> Column:
    """first threshold reached, else Rejected."""
    c = F.col(conf) if isinstance(conf, str) else conf
    out = None
    for state, t in (thresholds or K.STATE_THRESHOLDS):
        out = F.when(c >= t, F.lit(state)) if out is None else out.when(c >= t, F.lit(state))
    return out.otherwise(F.lit(K.REJECTED))


def hard_rejections() -> Column:
    """ordered reasons that force Rejected."""
    g, t, pt, h = F.col("geography"), F.col("text"), F.col("place_type"), F.col("historical")
    return kept_texts([
        (~g["on_land"], F.lit("Coordinates in ocean")),
        (t["name_similarity"] < 0.15, F.lit("Extremely low name similarity")),
        (pt["is_negative_type"], F.concat(F.lit("Inappropriate place type: "), pt["negative_type_detail"])),
        (h["large_movement"] & ~h["has_previous_data"], F.lit("Large unexplained movement from previous location")),
    ])


def decide_all(df: DataFrame, thresholds: list[tuple[str, float]] | None = None) -> DataFrame:
    """per candidate state, confidence, raw score, accepted, reasons."""
    out = df.withColumn("rejection_reasons", hard_rejections())
    state = F.when(F.size("rejection_reasons") > 0, F.lit(K.REJECTED)).otherwise(
        classify_state("calibrated_confidence", thresholds))
    out = out.withColumn("state", state)
    return out.withColumn("is_accepted", ~F.col("state").isin(*K.NOT_ACCEPTED_STATES))


def decide_best(df: DataFrame, key: str = "pos") -> DataFrame:
    """per centre the accepted candidate with the highest confidence; the
    earliest in list order wins ties. Centres without one are absent.

    A partial ``max_by`` aggregate (rows of non-accepted candidates have a NULL
    ordering value and are skipped): one row per centre and task is shuffled,
    and the acceptance filter stays above the aggregate instead of being pushed
    into the evidence stage."""
    cols = [c for c in df.columns if c != key]
    order = F.when(F.col("is_accepted"), F.struct(F.col("calibrated_confidence"), -F.col("cand_pos")))
    return (df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_b"))
              .filter(F.col("_b").isNotNull()).select(key, "_b.*"))


def state_label(state) -> Column:
    """display label per state."""
    kv = [x for s, lab in K.STATE_LABELS.items() for x in (F.lit(s), F.lit(lab))]
    s = F.col(state) if isinstance(state, str) else state
    return F.coalesce(F.element_at(F.create_map(*kv), s), s)
