"""Flagship job: verify candidate locations for every centre and pick the best.

Plan shape (one logical plan, Catalyst picks the physical strategy):

1. candidates: top-5 per (centre, query, provider) -- a window-group limit that
   Spark also runs map-side, so even a centre holding a third of all raw rows
   ships at most 5 rows per group from each task;
2. centres LEFT JOIN candidates ON pos (shuffle on ``pos``; every later window
   is partitioned by ``pos`` or a superset, so it reuses that distribution);
3. keep the first query rank with results (C3), number the list;
4. evidence, fusion, calibrated confidence, state (all column arithmetic, plus
   Arrow UDFs only for the string pairs that need them);
5. one row per centre: the accepted candidate with the highest confidence, or
   the reason it has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spread_id, strip_column
from ..operators import candidates as C
from ..operators import decide as D
from ..operators import evidence as E
from ..operators import fusion as FU
from ..operators.retrieval import candidates_of, retrieve
from ..operators.search_terms import generate_queries
from ..session import written

REF_FIELDS = ["id", "name", "address", "city", "state", "country", "postal_code"]
CAND_FIELDS = ["name", "address", "city", "state", "country", "postal_code", "street"]


def with_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df


def verify_candidates(centres: DataFrame, cands: DataFrame, force: bool = False,
                      previous: DataFrame | None = None, category_weights: dict | None = None,
                      thresholds: list | None = None, limit: int = 5) -> DataFrame:
    """All candidates of the first successful query of each pending centre with
    evidence, fusion scores, confidence and state; centres without candidates
    keep one row with NULL candidate columns (``cand_pos`` NULL)."""
    cands = with_missing(cands, CAND_FIELDS)
    top = C.candidates_all_providers(cands, limit)
    pending = (F.lit(True) if force else
               (F.col("latitude").isNull() | F.col("longitude").isNull()))
    texts = ["name", "city", "state", "country", "address"]  # stripped once for all search texts
    ref = centres.withColumns({f"_q_{f}": strip_column(F.coalesce(F.col(f), F.lit(""))) for f in texts}).select(
        "pos", *[F.coalesce(F.col(f), F.lit("")).alias(f"ref_{f}") for f in REF_FIELDS],
        F.col("latitude").alias("ref_latitude"), F.col("longitude").alias("ref_longitude"),
        pending.alias("pending"), F.size(generate_queries(*[f"_q_{f}" for f in texts], stripped=True)).alias("n_queries"))
    has_prev = None
    if previous is not None:  # met once for each centre, not for each of its candidates
        prev = latest_by_id(previous).select(
            F.col("id").alias("p_id"), F.lit(True).alias("has_prev"),
            F.col("latitude").alias("prev_latitude"), F.col("longitude").alias("prev_longitude"),
            F.col("name").alias("prev_name"), F.col("address").alias("prev_address"))
        ref = ref.join(prev, spread_id("ref_id", "pos") == F.col("p_id"), "left").drop("p_id")
        has_prev = "has_prev"
    cand_cols = top.select(
        F.col("pos").alias("c_pos"), "query_rank", "provider", "provider_rank",
        F.col("cand_pos").alias("src_pos"), *CAND_FIELDS, "latitude", "longitude",
        F.col("confidence").alias("provider_confidence"),
        *[c for c in ("raw", "rawf", "raw_nonempty", "raw_faults") if c in cands.columns])
    joined = ref.join(cand_cols, (F.col("pos") == F.col("c_pos")) & F.col("pending")
                      & (F.col("query_rank") < F.col("n_queries")), "left").drop("c_pos")
    # C3 and list numbering, both per centre
    w = Window.partitionBy("pos")
    joined = (joined.withColumn("_q", F.min("query_rank").over(w))
                    .filter(F.col("query_rank").isNull() | (F.col("query_rank") == F.col("_q")))
                    .drop("_q"))
    listed = ["provider_rank", "src_pos"]
    w_list = Window.partitionBy("pos").orderBy(*listed)
    joined = joined.withColumn(
        "cand_pos", F.when(F.col("src_pos").isNotNull(), F.row_number().over(w_list)))
    ev = E.collect_evidence(joined, has_prev, listed)
    scored = FU.calibrate_confidence(FU.fuse_evidence(ev, category_weights))
    return D.decide_all(scored, thresholds)


def latest_by_id(df: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Last row per id (highest ``order``) via ``max_by`` -- a partial aggregate,
    so a hot id is combined map-side. Empty ids are dropped."""
    cols = [c for c in df.columns if c not in (key,)]
    agg = F.max_by(F.struct(*cols), F.col(order)).alias("_r")
    return df.filter(F.col(key) != "").groupBy(key).agg(agg).select(key, "_r.*")


def geocode_centres(centres: DataFrame, cands: DataFrame, force: bool = False,
                    previous: DataFrame | None = None, **kw) -> DataFrame:
    """one row per centre with the outcome and, when geocoded, the new
    coordinates and verification metadata."""
    decided = verify_candidates(centres, cands, force, previous, **kw)
    # one row per centre: a partial (map-side) max_by aggregate, so only one
    # row per centre and task is shuffled
    ok = F.coalesce(F.col("is_accepted"), F.lit(False))
    rank_key = F.struct(ok.alias("a"), F.coalesce(F.col("calibrated_confidence"), F.lit(-1.0)).alias("c"),
                        (-F.coalesce(F.col("cand_pos"), F.lit(0))).alias("p"))
    keep = ["pending", "n_queries", "ref_latitude", "ref_longitude", "is_accepted", "latitude",
            "longitude", "calibrated_confidence", "state", "provider", "positive_signals",
            "negative_signals"] + [f"ref_{f}" for f in REF_FIELDS]
    per = (decided.groupBy("pos")
                  .agg(F.max_by(F.struct(*keep), rank_key).alias("b"),
                       F.count("cand_pos").alias("_n"))
                  .select("pos", "b.*", "_n"))
    ok = F.coalesce(F.col("is_accepted"), F.lit(False))
    status = (F.when(~F.col("pending"), F.lit("cached: already has coordinates"))
               .when(F.col("n_queries") == 0, F.lit("no_queries_generated"))
               .when(F.col("_n") == 0, F.lit("no_candidates_found"))
               .when(~ok, F.lit("below_confidence_threshold")))
    return per.select(
        "pos", *[F.col(f"ref_{f}").alias(f) for f in REF_FIELDS],
        ok.alias("geocoded"), status.alias("error"),
        F.when(ok, F.col("latitude")).otherwise(F.col("ref_latitude")).alias("latitude"),
        F.when(ok, F.col("longitude")).otherwise(F.col("ref_longitude")).alias("longitude"),
        F.when(ok, F.col("calibrated_confidence")).alias("confidence"),
        F.when(ok, F.col("state")).alias("verification_state"),
        F.when(ok, F.col("provider")).alias("geocode_provider"),
        F.when(ok, F.col("positive_signals")).alias("positive_signals"),
        F.when(ok, F.col("negative_signals")).alias("negative_signals"),
        F.col("_n").cast("int").alias("n_candidates"))


def geocode_by_query(centres: DataFrame, cache: DataFrame, responses: DataFrame, as_of, force: bool = False,
                     **kw) -> tuple[DataFrame, DataFrame]:
    """F15 in fallback mode, from landed responses: (outcome, cache writes). Each centre's query texts meet the cache
    and the responses (``operators.retrieval``); the candidates found are verified as in ``geocode_centres``."""
    answers, writes = retrieve(centres, cache, responses, as_of, force)
    return geocode_centres(centres, candidates_of(written(answers)), force=force, **kw), writes


def state_breakdown(outcome: DataFrame) -> DataFrame:
    """F16: geocoded centres by verification state."""
    return (outcome.where("geocoded").groupBy(F.col("verification_state").alias("state"))
                   .agg(F.count(F.lit(1)).alias("centres")))


def geocode_stats(outcome: DataFrame) -> DataFrame:
    """F16: total / geocoded / cached / failed (needs_review stays 0)."""
    return outcome.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("geocoded"), 1).otherwise(0)).alias("geocoded"),
        F.sum(F.when(~F.col("geocoded") & F.col("error").contains("cached"), 1).otherwise(0)).alias("cached"),
        F.sum(F.when(~F.col("geocoded") & ~F.coalesce(F.col("error").contains("cached"), F.lit(False)),
                     1).otherwise(0)).alias("failed"),
        F.lit(0).cast("long").alias("needs_review"))
