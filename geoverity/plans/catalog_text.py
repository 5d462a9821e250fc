"""Registered queries that depend on string similarity (LCS / token-set /
Unicode folding). No SQL oracle exists for those metrics; they are checked
against textbook implementations in ``tests/``. The purely set-based text
checks (alias groups, character overlap, postal prefixes) do have oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import similarity as sim
from ..functions.text import alias_detected, lower_words, transliteration_match
from ..operators import audit as AU
from ..operators import decide as D
from ..operators import evidence as E
from ..operators import fusion as FU
from ..operators import scoring as SC
from ..session import written
from ..sources.tables import read_table
from . import inputs
from .geocode import latest_by_id, verify_candidates
from .registry import r6, register

AUDIT_TIMESTAMP = "2024-01-10T00:00:00"


def _name_pairs(spark, sf):
    """Each centre's name/address against the previous dataset's row at the same position."""
    c = inputs.centres(spark, sf).select("pos", F.col("name").alias("a"), F.col("address").alias("a_addr"))
    e = inputs.existing(spark, sf).select("pos", F.col("name").alias("b"), F.col("address").alias("b_addr"))
    return c.join(e, "pos", "left").fillna("", ["b", "b_addr"])


def _decided(spark, sf):
    d = verify_candidates(inputs.centres(spark, sf), inputs.candidates(spark, sf), force=True)
    return d.filter(F.col("cand_pos").isNotNull())


# N12 -------------------------------------------------------------------------
@register("unicode_fold")
def q_fold(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", sim.fold("text").alias("folded"))


# T1 / T2 ---------------------------------------------------------------------
@register("indel_ratio")
def q_indel(spark, sf):
    p = _name_pairs(spark, sf)
    return r6(p.select("pos", sim.indel_ratio_udf(F.lower("a"), F.lower("b")).alias("ratio")))


@register("token_set_ratio")
def q_tsr(spark, sf):
    p = _name_pairs(spark, sf)
    return r6(p.select("pos", sim.token_set(F.lower("a"), F.lower("b")).alias("ratio")))


# E4 / E5 (set-based, with oracles) ------------------------------------------------
def _fold_sql(x: str) -> str:
    return f"regexp_replace(trim(lower({x})), '\\s+', ' ', 'g')"


def _words_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_fold_sql(x)}, ' '), lambda w: w <> ''))"


_ALIAS_SQL = " OR ".join(
    f"(len(list_intersect(wa, [{', '.join(repr(a) for a in g)}])) > 0 AND "
    f"len(list_intersect(wb, [{', '.join(repr(a) for a in g)}])) > 0 AND "
    f"list_sort(list_intersect(wa, [{', '.join(repr(a) for a in g)}])) <> "
    f"list_sort(list_intersect(wb, [{', '.join(repr(a) for a in g)}])))"
    for g in K.SCHOOL_ALIASES.values())


@register("alias_detect", f"""
WITH p AS (SELECT c.pos, {_words_sql('c.name')} AS wa, {_words_sql("coalesce(e.name, '')")} AS wb
           FROM centres c LEFT JOIN existing e ON e.pos = c.pos)
SELECT pos, ({_ALIAS_SQL}) AS alias_detected FROM p""", ("centres", "existing"))
def q_alias(spark, sf):
    p = _name_pairs(spark, sf)
    wa, wb = lower_words(sim.ascii_fold("a")), lower_words(sim.ascii_fold("b"))
    return p.select("pos", alias_detected(wa, wb).alias("alias_detected"))


@register("transliteration_detect", f"""
WITH p AS (SELECT c.pos, {_fold_sql('c.name')} AS fa, {_fold_sql("coalesce(e.name, '')")} AS fb
           FROM centres c LEFT JOIN existing e ON e.pos = c.pos),
q AS (SELECT pos, fa, fb, list_distinct(string_split(fa, '')) AS ca, list_distinct(string_split(fb, '')) AS cb FROM p)
SELECT pos, CASE WHEN fa = '' OR fb = '' THEN false
  ELSE CAST(len(list_intersect(ca, cb)) AS DOUBLE) / greatest(len(ca), len(cb)) > 0.7 END AS transliteration_match
FROM q""", ("centres", "existing"))
def q_translit(spark, sf):
    p = _name_pairs(spark, sf)
    return p.select("pos", transliteration_match(sim.ascii_fold("a"), sim.ascii_fold("b"))
                    .alias("transliteration_match"))


# E3 ----------------------------------------------------------------------------
@register("postal_similarity", """
WITH p AS (SELECT pos, postal_code AS a, substr(postal_code, 1, 4 + CAST(pos % 3 AS INTEGER)) AS b FROM centres)
SELECT pos, CASE WHEN a = '' OR b = '' THEN CAST(0 AS DOUBLE) WHEN trim(a) = trim(b) THEN CAST(1 AS DOUBLE)
  WHEN starts_with(trim(a), trim(b)) OR starts_with(trim(b), trim(a)) THEN CAST(0.5 AS DOUBLE) END
  AS postal_similarity FROM p""", ("centres",))
def q_postal(spark, sf):
    c = inputs.centres(spark, sf)
    b = F.expr("substring(postal_code, 1, 4 + CAST(pos % 3 AS INT))")
    return c.select("pos", E.postal_similarity(F.col("postal_code"), b).alias("postal_similarity"))


# E1 / E2 ---------------------------------------------------------------------------
@register("text_evidence")
def q_text(spark, sf):
    d = _decided(spark, sf)
    return r6(d.select("pos", "cand_pos", "text.*"))


@register("country_similarity")
def q_country_sim(spark, sf):
    """Each centre's country against its city's country name."""
    from ..sources.fixtures import view
    c = inputs.centres(spark, sf)
    k = view(spark, sf, "cities").select("city", "ctry")
    return r6(c.join(k, "city").select("pos", E.country_similarity(F.col("country"), F.col("ctry"))
                                       .alias("country_similarity")))


# E10 / E11 ----------------------------------------------------------------------
def _reverse_pairs(spark, sf):
    """Each centre against the reverse record of the next centre in the list."""
    c = inputs.centres(spark, sf)
    nxt = c.select((F.col("pos") - 1).alias("pos"), F.col("city").alias("rev_city"),
                   F.col("state").alias("rev_state"), F.col("country").alias("rev_country"))
    return c.join(nxt, "pos", "left").fillna("", ["rev_city", "rev_state", "rev_country"])


@register("reverse_match")
def q_reverse(spark, sf):
    p = _reverse_pairs(spark, sf)
    return p.select("pos", E.reverse_match("city", "country", "rev_city", "rev_country").alias("reverse_match"))


@register("admin_hierarchy_valid")
def q_admin(spark, sf):
    p = _reverse_pairs(spark, sf)
    return p.select("pos", E.admin_hierarchy_valid("state", "country", "rev_state", "rev_country")
                    .alias("admin_hierarchy_valid"))


# E19 ----------------------------------------------------------------------------
@register("historical_evidence")
def q_history(spark, sf):
    d = verify_candidates(inputs.centres(spark, sf), inputs.candidates(spark, sf), force=True,
                          previous=inputs.existing(spark, sf))
    return r6(d.filter(F.col("cand_pos").isNotNull()).select("pos", "cand_pos", "historical.*"))


# E20-E22 -------------------------------------------------------------------------
@register("collect_evidence")
def q_collect(spark, sf):
    d = _decided(spark, sf)
    return r6(d.select("pos", "cand_pos", "candidate_id", "provider",
                       F.col("geography.on_land").alias("on_land"),
                       F.col("geography.coordinate_precision").alias("coordinate_precision"),
                       F.col("provider_evidence.providers_agreeing").alias("providers_agreeing"),
                       F.col("place_type.category").alias("place_category"),
                       F.col("text.name_similarity").alias("name_similarity"),
                       F.col("historical.has_previous_data").alias("has_previous_data")))


@register("evidence_signals")
def q_signals(spark, sf):
    d = _decided(spark, sf)
    return d.select("pos", "cand_pos", "positive_signals", "negative_signals")


@register("verifier_best")
def q_verifier_best(spark, sf):
    d = E.verifier_best(_decided(spark, sf))
    return d.select("pos", "cand_pos", "candidate_id")


# F1, F5-F14 --------------------------------------------------------------------------
@register("fusion_text")
def q_fusion_text(spark, sf):
    return r6(_decided(spark, sf).select("pos", "cand_pos", F.col("score_text").alias("text_score")))


@register("fusion_historical")
def q_fusion_hist(spark, sf):
    d = verify_candidates(inputs.centres(spark, sf), inputs.candidates(spark, sf), force=True,
                          previous=inputs.existing(spark, sf))
    return r6(d.filter(F.col("cand_pos").isNotNull()).select(
        "pos", "cand_pos", F.col("score_historical").alias("historical_score")))


@register("fuse_evidence")
def q_fuse(spark, sf):
    return r6(_decided(spark, sf).select("pos", "cand_pos", "total_score", "positive_count", "negative_count",
                                         "evidence_strength"))


@register("rank_by_fusion")
def q_rank_fusion(spark, sf):
    from pyspark.sql import Window
    d = _decided(spark, sf)
    w = Window.partitionBy("pos").orderBy(F.desc("total_score"), F.asc("cand_pos"))
    return r6(d.select("pos", "cand_pos", "total_score", F.row_number().over(w).alias("rank")))


@register("uncertainty")
def q_uncertainty(spark, sf):
    return r6(_decided(spark, sf).select("pos", "cand_pos", "uncertainty"))


@register("calibrate_confidence")
def q_calibrate(spark, sf):
    return r6(_decided(spark, sf).select("pos", "cand_pos", "raw_score", "calibrated_confidence",
                                         "evidence_quality", "uncertainty"))


@register("classify_state")
def q_classify_state(spark, sf):
    d = _decided(spark, sf)
    return d.select("pos", "cand_pos", D.classify_state("calibrated_confidence").alias("confidence_state"))


@register("hard_rejections")
def q_hard(spark, sf):
    return _decided(spark, sf).select("pos", "cand_pos", "rejection_reasons")


@register("decide_best")
def q_decide_best(spark, sf):
    # its aggregate holds whole rows, so they are cut to what is asked for
    b = D.decide_best(_decided(spark, sf).select("pos", "cand_pos", "state", "calibrated_confidence", "is_accepted"))
    return r6(b.select("pos", "cand_pos", "state", "calibrated_confidence"))


@register("state_labels")
def q_state_labels(spark, sf):
    return _decided(spark, sf).select("pos", "cand_pos", D.state_label("state").alias("label"))


# F17-F19 ---------------------------------------------------------------------------
def _report(spark, sf):
    # entries and best candidates are read from one table of decisions, so that these are made once
    d = written(_decided(spark, sf).select(
        "pos", "cand_pos", "candidate_id", "provider", "latitude", "longitude", "state", "calibrated_confidence",
        "positive_signals", "negative_signals", "total_score", *[f"score_{c}" for c in K.CATEGORY_WEIGHTS]))
    entries = AU.audit_entries(d)
    best = E.verifier_best(d).select("pos", F.col("candidate_id").alias("best_candidate_id"))
    refs = inputs.centres(spark, sf).select("pos", F.col("id").alias("reference_id"),
                                           F.col("name").alias("reference_name"))
    return AU.audit_report(entries, best, refs, AUDIT_TIMESTAMP)


@register("audit_entries")
def q_audit_entries(spark, sf):
    """whole entries; the category scores, a map, as a column each."""
    e = AU.audit_entries(_decided(spark, sf))
    scores = [F.element_at("category_scores", c).alias(f"score_{c}") for c in K.CATEGORY_WEIGHTS]
    return r6(e.select("*", *scores).drop("category_scores"))


@register("audit_report")
def q_audit_report(spark, sf):
    return _report(spark, sf).select("pos", "reference_id", "best_candidate_id", "summary",
                                     F.size("entries").alias("n_entries"))


@register("audit_text")
def q_audit_text(spark, sf):
    return AU.audit_text(_report(spark, sf))


# T3-T7 -----------------------------------------------------------------------------
def _scored(spark, sf):
    c = inputs.candidates(spark, sf)
    cen = inputs.centres(spark, sf).select(
        "pos", *[F.coalesce(F.col(f), F.lit("")).alias(f"ref_{f}")
                 for f in ["name", "address", "city", "state", "country"]])
    c = c.join(cen, "pos").withColumn("address", F.lit("")).withColumn("state", F.lit(""))
    return SC.score_candidates(c)


@register("score_fuzzy_field")
def q_t3(spark, sf):
    p = _name_pairs(spark, sf)
    return r6(p.select("pos", SC.score_fuzzy_field("a", "b").alias("score")))


@register("score_country")
def q_t4(spark, sf):
    from ..sources.fixtures import view
    c = inputs.centres(spark, sf).join(view(spark, sf, "cities").select("city", "ctry"), "city")
    return r6(c.select("pos", SC.score_country("country", "ctry").alias("score")))


@register("score_candidates")
def q_t5(spark, sf):
    return r6(_scored(spark, sf).select("pos", "cand_pos", "score"))


@register("rank_candidates")
def q_t6(spark, sf):
    return r6(SC.rank_candidates(_scored(spark, sf)).select("pos", "cand_pos", "score", "rank"))


@register("best_candidate")
def q_t7(spark, sf):
    return r6(SC.best_candidate(_scored(spark, sf)).select("pos", "cand_pos", "score"))
