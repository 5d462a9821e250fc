"""Evidence fusion and calibrated confidence (F1-F9): pure column arithmetic
over the evidence structs, so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import py_fixed


def _clip1(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def score_text(t: Column) -> Column:
    """F1: weighted text similarities + 0.05 alias + 0.03 transliteration, each capped at 1."""
    s = (t["name_similarity"] * K.TEXT_FIELD_WEIGHTS["name"]
         + t["city_similarity"] * K.TEXT_FIELD_WEIGHTS["city"]
         + t["country_similarity"] * K.TEXT_FIELD_WEIGHTS["country"]
         + t["state_similarity"] * K.TEXT_FIELD_WEIGHTS["state"]
         + t["address_similarity"] * K.TEXT_FIELD_WEIGHTS["address"]
         + t["postal_similarity"] * K.TEXT_FIELD_WEIGHTS["postal"])
    s = F.when(t["alias_detected"], _clip1(s + 0.05)).otherwise(s)
    return F.when(t["transliteration_match"], _clip1(s + 0.03)).otherwise(s)


def score_geography(g: Column) -> Column:
    """F2: ocean -> 0; city-centre distance bands; reverse/admin/urban/edu/roads; precision."""
    d = g["distance_from_city_center"]
    band = (F.when(d.isNull(), 0.0).when(d <= 1.0, 0.30).when(d <= 5.0, 0.25)
             .when(d <= 20.0, 0.15).when(d <= 50.0, 0.05).otherwise(0.0))
    s = (band
         + F.when(g["reverse_geocode_match"], 0.25).otherwise(0.0)
         + F.when(g["admin_hierarchy_valid"], 0.15).otherwise(0.0)
         + F.when(F.coalesce(g["urban_area"], F.lit(False)), 0.05).otherwise(0.0)
         + F.when(g["nearby_educational"], 0.10).otherwise(0.0)
         + F.when(g["nearby_roads"], 0.05).otherwise(0.0)
         + g["coordinate_precision"] * 0.10)
    return F.when(~g["on_land"], F.lit(0.0)).otherwise(_clip1(s))


def score_provider(p: Column) -> Column:
    """consensus ratio, agreeing-count bonus, mean reliability, penalties."""
    agree = p["providers_agreeing"]
    s = (p["consensus_ratio"] * 0.6
         + F.when(agree >= 3, 0.3).when(agree >= 2, 0.2).when(agree >= 1, 0.1).otherwise(0.0)
         + F.coalesce(p["mean_provider_weight"], F.lit(0.0)) * 0.1)
    s = F.when(p["disagreement"], s * 0.5).otherwise(s)
    v = p["coordinate_variance"]
    s = F.when(v > 0.1, s * 0.7).when(v > 0.01, s * 0.9).otherwise(s)
    return F.when(p["providers_total"] == 0, F.lit(0.0)).otherwise(_clip1(s))


def score_place_type(pt: Column) -> Column:
    """negative -> 0; educational -> its confidence; else 0.3."""
    return (F.when(pt["is_negative_type"], F.lit(0.0))
             .when(pt["is_educational"], pt["confidence"]).otherwise(F.lit(0.3)))


def score_historical(h: Column) -> Column:
    """0.5 without history; else match/distance bands minus change penalties, clamped."""
    d = h["distance_from_previous"]
    s = (F.when(h["matches_previous"], 0.5).otherwise(0.0)
         + F.when(d.isNull(), 0.0).when(d <= 1.0, 0.3).when(d <= 5.0, 0.2).when(d <= 20.0, 0.1)
            .when(d > K.LARGE_MOVEMENT_KM, -0.2).otherwise(0.0)
         - F.when(h["name_changed"], 0.1).otherwise(0.0)
         - F.when(h["address_changed"], 0.05).otherwise(0.0)
         - F.when(h["large_movement"], 0.3).otherwise(0.0))
    return F.when(~h["has_previous_data"], F.lit(0.5)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def _weights(category_weights: dict | None) -> dict:
    w = dict(category_weights or K.CATEGORY_WEIGHTS)
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else w


def fuse_evidence(df: DataFrame, category_weights: dict | None = None) -> DataFrame:
    """per-category scores, weighted total (rounded to 4 dp), signal counts
    and evidence strength (share of categories scoring > 0)."""
    w = _weights(category_weights)
    cats = {
        "text": score_text(F.col("text")),
        "geography": score_geography(F.col("geography")),
        "provider": score_provider(F.col("provider_evidence")),
        "place_type": score_place_type(F.col("place_type")),
        "historical": score_historical(F.col("historical")),
    }
    out = df
    for name, expr in cats.items():
        out = out.withColumn(f"score_{name}", expr)
    total = None
    strength = None
    for name, weight in w.items():
        sc = F.col(f"score_{name}") if name in cats else F.lit(0.0)
        term = sc * F.lit(weight)
        total = term if total is None else total + term
        has = F.when(sc > 0, 1).otherwise(0)
        strength = has if strength is None else strength + has
    return (out.withColumn("total_score", py_fixed(total, 4).cast("double"))
               .withColumn("positive_count", F.size("positive_signals"))
               .withColumn("negative_count", F.size("negative_signals"))
               .withColumn("evidence_strength", (strength / F.lit(float(len(w)))) if w else F.lit(0.0)))


def uncertainty() -> Column:
    """F8: sparse evidence, contradictory signals, weak consensus, large move."""
    pos, neg = F.col("positive_count"), F.col("negative_count")
    contra = F.when((pos > 0) & (neg > 0), F.least(pos, neg) / F.greatest(pos, neg) * 0.3).otherwise(0.0)
    u = ((1.0 - F.col("evidence_strength")) * 0.4 + contra
         + F.when(F.col("score_provider") < 0.3, 0.2).otherwise(0.0)
         + F.when(F.col("historical")["large_movement"], 0.1).otherwise(0.0))
    return F.least(F.lit(1.0), u)


def calibrate_confidence(df: DataFrame, steepness: float | None = None,
                         midpoint: float | None = None) -> DataFrame:
    """sigmoid(steepness * (x - midpoint)) with z clamped to +-500, pulled
    towards 0.5 by 0.3 * uncertainty, clamped to [0, 1]. Zero/None overrides
    fall back to the defaults."""
    k = steepness or K.SIGMOID_STEEPNESS
    m = midpoint or K.SIGMOID_MIDPOINT
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(k) * (F.col("total_score") - F.lit(m))))
    sig = 1.0 / (1.0 + F.exp(-z))
    out = df.withColumn("uncertainty", uncertainty()).withColumn("_sig", sig)
    pen = F.col("uncertainty") * 0.3
    adj = F.when(F.col("_sig") > 0.5, F.col("_sig") - pen).otherwise(F.col("_sig") + pen)
    return (out.withColumn("calibrated_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), adj)))
               .withColumn("raw_score", F.col("total_score"))
               .withColumn("evidence_quality", F.col("evidence_strength"))
               .drop("_sig"))


def category_scores() -> Column:
    """Category -> score map in the fixed category order."""
    return F.create_map(*[x for n in K.CATEGORY_WEIGHTS for x in (F.lit(n), F.col(f"score_{n}"))])
