"""Legacy weighted candidate scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import similarity as sim
from ..functions.text import normalize_country, py_fixed, py_strip


def _s(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def score_fuzzy_field(q, t) -> Column:
    """0..100; empty side -> 0; token-set ratio of the lower-cased strings."""
    q, t = _s(q), _s(t)
    empty = (q == "") | (t == "")
    return F.when(empty, F.lit(0.0)).otherwise(
        sim.token_set_ratio_udf(F.when(~empty, F.lower(q)), F.when(~empty, F.lower(t))))


def score_country(q, t) -> Column:
    """T4: 0..1; equal canonical forms -> 1; else Indel ratio of the stripped,
    lower-cased names, below 50 -> 0, else / 100."""
    q, t = _s(q), _s(t)
    empty = (q == "") | (t == "")
    same = normalize_country(q) == normalize_country(t)
    need = ~empty & ~same
    r = sim.indel_ratio_udf(F.when(need, F.lower(py_strip(q))), F.when(need, F.lower(py_strip(t))))
    return (F.when(empty, F.lit(0.0)).when(same, F.lit(1.0))
             .when(r < 50, F.lit(0.0)).otherwise(r / 100.0))


def score_candidates(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """T5: breakdown map and weighted total rounded to 4 dp. Reference fields
    are ``ref_*``; ``raw_distance_km`` (default 0) drives the distance penalty."""
    w = weights or K.SCORER_WEIGHTS
    dist = F.coalesce(F.col("raw_distance_km"), F.lit(0.0)) if "raw_distance_km" in df.columns else F.lit(0.0)
    parts = {
        "name": score_fuzzy_field("ref_name", "name") / 100.0,
        "address": score_fuzzy_field("ref_address", "address") / 100.0,
        "city": score_fuzzy_field("ref_city", "city") / 100.0,
        "state": score_fuzzy_field("ref_state", "state") / 100.0,
        "country": score_country("ref_country", "country"),
        "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)),
        "distance_penalty": F.greatest(F.lit(0.0), 1.0 - F.least(dist / 100.0, F.lit(1.0))),
    }
    out = df
    for k, v in parts.items():
        out = out.withColumn(f"b_{k}", v)
    total = None
    for k, weight in w.items():
        term = (F.col(f"b_{k}") if k in parts else F.lit(0.0)) * F.lit(weight)
        total = term if total is None else total + term
    bd = F.create_map(*[x for k in parts for x in (F.lit(k), F.col(f"b_{k}"))])
    return (out.withColumn("score", py_fixed(total, 4).cast("double")).withColumn("breakdown", bd)
               .drop(*[f"b_{k}" for k in parts]))


def rank_candidates(scored: DataFrame, key: str = "pos") -> DataFrame:
    """Stable rank by score (ties keep list order)."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("cand_pos"))
    return scored.withColumn("rank", F.row_number().over(w))


def best_candidate(scored: DataFrame, key: str = "pos",
                   threshold: float = K.CONFIDENCE_THRESHOLD) -> DataFrame:
    """The top-ranked candidate per centre if its score reaches the threshold."""
    return rank_candidates(scored, key).filter((F.col("rank") == 1) & (F.col("score") >= threshold))
