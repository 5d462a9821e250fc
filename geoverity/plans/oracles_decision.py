"""DuckDB oracles of the verification chain, from candidates to decisions.

One chain of CTEs restates the rules step by step: top five per provider, the
first successful query, evidence of each category, fused and calibrated scores,
state. The stand-in candidates carry their centre's own name, city and country
and no state, address or postal code, so the text similarities are 1 or 0 there
and need no string metric (the metrics have their own oracles and tests).
"""

from __future__ import annotations

from .. import constants as K
from ..sources.fixtures import with_views
from .catalog_evidence import _CONSENSUS_CTE, _EDU, _KW, _NEG, _POS, D
from .catalog_relational import _merge_cte
from .geocode import REF_FIELDS
from .oracles_sources import GEN_ID  # noqa: F401  (registers the source oracles first)
from .registry import ORACLE, hav_sql, on_land_sql, precision_sql

_T = K.TEXT_FIELD_WEIGHTS
_TOTAL = sum(K.CATEGORY_WEIGHTS.values())
_W = {k: v / _TOTAL for k, v in K.CATEGORY_WEIGHTS.items()}
_STATE = " ".join(f"WHEN calibrated_confidence >= {D(t)} THEN '{s}'" for s, t in K.STATE_THRESHOLDS)
_NOT_OK = ", ".join(f"'{s}'" for s in K.NOT_ACCEPTED_STATES)

_CONSENSUS = _CONSENSUS_CTE.strip()[len("WITH "):].replace("FROM candidates GROUP BY", "FROM cand GROUP BY") \
    .replace("FROM candidates k JOIN", "FROM cand k JOIN")


def chain(pending: str = "true") -> str:
    """CTEs up to ``decided``: one row per candidate of the centres for which ``pending`` holds."""
    return f"""
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos, query_rank, provider ORDER BY cand_pos) AS rn5
  FROM candidates) x WHERE rn5 <= 5),
tried AS (SELECT k.* FROM (SELECT *, min(query_rank) OVER (PARTITION BY pos) AS q0 FROM top5) k
  JOIN centres c ON c.pos = k.pos WHERE query_rank = q0 AND ({pending})),
cand AS (SELECT pos, provider, name, city, country, latitude, longitude, raw_type,
  row_number() OVER (PARTITION BY pos ORDER BY provider_rank, cand_pos) AS cand_pos FROM tried),
{_CONSENSUS},
ev AS (SELECT k.pos, k.cand_pos, k.provider, k.latitude, k.longitude, k.raw_type <> '' AS ne, lower(k.raw_type) AS ptype,
  CASE lower(k.raw_type) {_NEG} END AS neg_label, lower(k.name) AS lname,
  {hav_sql('k.latitude', 'k.longitude', 'y.city_lat', 'y.city_lon')} AS dcc, {on_land_sql('k.latitude', 'k.longitude')} AS land,
  {precision_sql('k.latitude', 'k.longitude')} AS prec, pe.* EXCLUDE (pos)
  FROM cand k JOIN centres c ON c.pos = k.pos JOIN pe ON pe.pos = k.pos LEFT JOIN cities y ON y.city = lower(c.city)),
typed AS (SELECT *, ptype IN ({_POS}) AS is_pos, ptype NOT IN ({_POS}) AND neg_label IS NOT NULL AS is_neg,
  {_KW.replace('lower(name)', 'lname')} AS kw FROM ev),
cat AS (SELECT *, is_pos OR (NOT is_neg AND kw) AS is_edu,
  CASE WHEN is_pos OR is_neg THEN ptype WHEN kw THEN 'educational_keyword_match' ELSE 'unknown' END AS category,
  ne AND ptype IN ({_EDU}) AS nearby_edu FROM typed),
scored AS (SELECT *,
  least({D(1)}, {D(_T['name'])} + {D(_T['city'])} + {D(_T['country'])} + {D(0.03)}) AS score_text,
  CASE WHEN NOT land THEN {D(0)} ELSE least({D(1)},
   CASE WHEN dcc IS NULL THEN {D(0)} WHEN dcc <= 1.0 THEN {D(0.30)} WHEN dcc <= 5.0 THEN {D(0.25)}
        WHEN dcc <= 20.0 THEN {D(0.15)} WHEN dcc <= 50.0 THEN {D(0.05)} ELSE {D(0)} END
   + CASE WHEN ne THEN {D(0.15)} ELSE {D(0)} END + CASE WHEN nearby_edu THEN {D(0.10)} ELSE {D(0)} END + prec * {D(0.10)}) END
   AS score_geography,
  (consensus_ratio * {D(0.6)} + CASE WHEN providers_agreeing >= 3 THEN {D(0.3)} WHEN providers_agreeing >= 2 THEN {D(0.2)}
     WHEN providers_agreeing >= 1 THEN {D(0.1)} ELSE {D(0)} END + mean_provider_weight * {D(0.1)})
   * CASE WHEN disagreement THEN {D(0.5)} ELSE {D(1)} END
   * CASE WHEN coordinate_variance > 0.1 THEN {D(0.7)} WHEN coordinate_variance > 0.01 THEN {D(0.9)} ELSE {D(1)} END AS sp,
  CASE WHEN is_neg THEN {D(0)} WHEN is_pos THEN {D(0.9)} WHEN kw THEN {D(0.7)} ELSE {D(0.3)} END AS score_place_type,
  {D(0.5)} AS score_historical FROM cat),
fused AS (SELECT * EXCLUDE (sp), least({D(1)}, sp) AS score_provider,
  list_filter(['Name similarity: 100%', 'City matched', 'Country matched', CASE WHEN land THEN 'On land' END,
    CASE WHEN nearby_edu THEN 'Nearby educational institutions' END,
    CASE WHEN providers_agreeing >= 2 THEN CAST(providers_agreeing AS VARCHAR) || ' providers agreed' END,
    CASE WHEN is_edu THEN 'Educational institution (' || category || ')' END], lambda x: x IS NOT NULL) AS positive_signals,
  list_filter([CASE WHEN NOT land THEN 'Coordinates in ocean' END,
    CASE WHEN dcc > 50 THEN CAST(CAST(round_even(dcc, 0) AS BIGINT) AS VARCHAR) || ' km from expected city' END,
    CASE WHEN disagreement THEN 'Provider disagreement' END,
    CASE WHEN is_neg THEN 'Inappropriate place type: ' || neg_label END], lambda x: x IS NOT NULL) AS negative_signals FROM scored),
total AS (SELECT *, CAST(printf('%.4f', score_text * {D(_W['text'])} + score_geography * {D(_W['geography'])}
    + score_provider * {D(_W['provider'])} + score_place_type * {D(_W['place_type'])}
    + score_historical * {D(_W['historical'])}) AS DOUBLE) AS total_score,
  CAST(len(positive_signals) AS INTEGER) AS positive_count, CAST(len(negative_signals) AS INTEGER) AS negative_count,
  CAST((score_text > 0)::INT + (score_geography > 0)::INT + (score_provider > 0)::INT + (score_place_type > 0)::INT
    + (score_historical > 0)::INT AS DOUBLE) / 5 AS evidence_strength FROM fused),
unsure AS (SELECT *, least({D(1)}, (1 - evidence_strength) * {D(0.4)}
  + CASE WHEN positive_count > 0 AND negative_count > 0 THEN CAST(least(positive_count, negative_count) AS DOUBLE)
      / greatest(positive_count, negative_count) * {D(0.3)} ELSE {D(0)} END
  + CASE WHEN score_provider < 0.3 THEN {D(0.2)} ELSE {D(0)} END) AS uncertainty,
  1 / (1 + exp(-({D(K.SIGMOID_STEEPNESS)} * (total_score - {D(K.SIGMOID_MIDPOINT)})))) AS sig FROM total),
calibrated AS (SELECT *, greatest({D(0)}, least({D(1)},
  CASE WHEN sig > 0.5 THEN sig - uncertainty * {D(0.3)} ELSE sig + uncertainty * {D(0.3)} END)) AS calibrated_confidence FROM unsure),
reasons AS (SELECT *, CASE {_STATE} ELSE 'Rejected' END AS confidence_state,
  list_filter([CASE WHEN NOT land THEN 'Coordinates in ocean' END,
    CASE WHEN is_neg THEN 'Inappropriate place type: ' || neg_label END], lambda x: x IS NOT NULL) AS rejection_reasons FROM calibrated),
stated AS (SELECT *, CASE WHEN len(rejection_reasons) > 0 THEN 'Rejected' ELSE confidence_state END AS state,
  'candidate_' || CAST(cand_pos - 1 AS VARCHAR) || '_' || provider AS candidate_id FROM reasons),
decided AS (SELECT *, state NOT IN ({_NOT_OK}) AS is_accepted FROM stated),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY calibrated_confidence DESC, cand_pos) AS rb
  FROM decided WHERE is_accepted) x WHERE rb = 1)"""


_LABEL = " ".join(f"WHEN '{s}' THEN '{label}'" for s, label in K.STATE_LABELS.items())
_KEY = "pos, CAST(cand_pos AS INTEGER) AS cand_pos"
_R = lambda c: f"round({c}, 6) AS {c}"

_DECIDED = {
    "text_evidence": f"""{_KEY}, {D(1)} AS name_similarity, {D(0)} AS address_similarity, {D(1)} AS city_similarity,
      {D(0)} AS state_similarity, {D(1)} AS country_similarity, {D(0)} AS postal_similarity, {D(0)} AS street_similarity,
      {D(1)} AS admin_area_similarity, false AS alias_detected, true AS transliteration_match""",
    "collect_evidence": f"""{_KEY}, candidate_id, provider, land AS on_land, round(prec, 6) AS coordinate_precision,
      CAST(providers_agreeing AS INTEGER) AS providers_agreeing, category AS place_category, {D(1)} AS name_similarity,
      false AS has_previous_data""",
    "evidence_signals": f"{_KEY}, positive_signals, negative_signals",
    "fusion_text": f"{_KEY}, round(score_text, 6) AS text_score",
    "fuse_evidence": f"{_KEY}, {_R('total_score')}, positive_count, negative_count, {_R('evidence_strength')}",
    "rank_by_fusion": f"""{_KEY}, {_R('total_score')},
      CAST(row_number() OVER (PARTITION BY pos ORDER BY total_score DESC, cand_pos) AS INTEGER) AS rank""",
    "uncertainty": f"{_KEY}, {_R('uncertainty')}",
    "calibrate_confidence": f"""{_KEY}, round(total_score, 6) AS raw_score, {_R('calibrated_confidence')},
      round(evidence_strength, 6) AS evidence_quality, {_R('uncertainty')}""",
    "classify_state": f"{_KEY}, confidence_state",
    "hard_rejections": f"{_KEY}, rejection_reasons",
    "state_labels": f"{_KEY}, CASE state {_LABEL} END AS label",
    "audit_entries": f"""{_KEY}, candidate_id, provider, {_R('latitude')}, {_R('longitude')}, state AS decision,
      CAST(printf('%.4f', calibrated_confidence) AS DOUBLE) AS confidence, positive_signals, negative_signals,
      round(total_score, 6) AS raw_score, {', '.join(_R(f'score_{c}') for c in K.CATEGORY_WEIGHTS)}""",
    "decide_all": f"""{_KEY}, provider, state, is_accepted, {_R('calibrated_confidence')}, round(total_score, 6) AS raw_score,
      {_R('uncertainty')}, rejection_reasons""",
}

_OUTCOME = f"""
SELECT c.pos, {', '.join(f"coalesce(c.{f}, '') AS {f}" for f in REF_FIELDS)}, b.pos IS NOT NULL AS geocoded,
 CASE WHEN NOT (__PENDING__) THEN 'cached: already has coordinates' WHEN n.n IS NULL THEN 'no_candidates_found'
      WHEN b.pos IS NULL THEN 'below_confidence_threshold' END AS error,
 round(coalesce(b.latitude, c.latitude), 6) AS latitude, round(coalesce(b.longitude, c.longitude), 6) AS longitude,
 round(b.calibrated_confidence, 6) AS confidence, b.state AS verification_state, b.provider AS geocode_provider,
 b.positive_signals, b.negative_signals, CAST(coalesce(n.n, 0) AS INTEGER) AS n_candidates
FROM centres c LEFT JOIN best b ON b.pos = c.pos
LEFT JOIN (SELECT pos, count(*) AS n FROM decided GROUP BY pos) n ON n.pos = c.pos"""

_VIEWS = ("centres", "candidates", "cities")
_MISSING = "c.latitude IS NULL OR c.longitude IS NULL"

for _key, _cols in _DECIDED.items():
    ORACLE[_key] = with_views(f"WITH {chain().strip()}\nSELECT {_cols} FROM decided", *_VIEWS)
ORACLE["verifier_best"] = with_views(f"""WITH {chain().strip()}
SELECT {_KEY}, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY pos
  ORDER BY positive_count - negative_count DESC, cand_pos) AS rv FROM decided) x WHERE rv = 1""", *_VIEWS)
ORACLE["decide_best"] = with_views(
    f"WITH {chain().strip()}\nSELECT {_KEY}, state, {_R('calibrated_confidence')} FROM best", *_VIEWS)
ORACLE["state_breakdown"] = with_views(
    f"WITH {chain().strip()}\nSELECT state, count(*) AS centres FROM best GROUP BY state", *_VIEWS)
ORACLE["geocode_centres"] = with_views(f"WITH {chain().strip()}{_OUTCOME.replace('__PENDING__', 'true')}", *_VIEWS)
ORACLE["geocode_pending"] = with_views(f"WITH {chain(_MISSING).strip()}{_OUTCOME.replace('__PENDING__', _MISSING)}", *_VIEWS)
ORACLE["geocode_stats"] = with_views(f"""WITH {chain(_MISSING).strip()},
o AS ({_OUTCOME.replace('__PENDING__', _MISSING)})
SELECT count(*) AS total, CAST(sum(geocoded::INT) AS BIGINT) AS geocoded,
 CAST(sum((NOT geocoded AND coalesce(contains(error, 'cached'), false))::INT) AS BIGINT) AS cached,
 CAST(sum((NOT geocoded AND NOT coalesce(contains(error, 'cached'), false))::INT) AS BIGINT) AS failed,
 CAST(0 AS BIGINT) AS needs_review FROM o""", *_VIEWS)

# Both snapshots get their ids (an empty one is hashed from name, city, state, country), then U1 merges them
_HASHED = """CASE WHEN id <> '' THEN id ELSE substr(sha256(concat_ws('|', nullif(lower(trim(name)), ''), nullif(lower(trim(city)), ''),
  nullif(lower(trim(state)), ''), nullif(lower(trim(country)), ''))), 1, 16) END AS id"""
_FIELDS = K.LOCATION_FIELDS
_merge = _merge_cte().strip()[len("WITH "):].replace("FROM existing", "FROM e2").replace("FROM centres", "FROM c2")
ORACLE["stream_ingest_landed"] = with_views(f"""WITH c2 AS (SELECT * EXCLUDE (id), {_HASHED} FROM centres), e2 AS (SELECT * EXCLUDE (id), {_HASHED} FROM existing),
{_merge},
merged AS (SELECT pos, id, CASE WHEN changed THEN name ELSE ex_name END AS name,
  {', '.join(f'CASE WHEN changed THEN {f} ELSE fin_{f} END AS {f}' for f in _FIELDS)} FROM mm
  UNION ALL SELECT pos, id, name, {', '.join(_FIELDS)} FROM un)
SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, name, address, city, state, country, postal_code, '' AS phone,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM merged""", "centres", "existing")
ORACLE["stream_ingest_changes"] = with_views(f"""WITH c2 AS (SELECT * EXCLUDE (id), {_HASHED} FROM centres WHERE pos % 10 = 0),
e2 AS (SELECT * EXCLUDE (id, pos), row_number() OVER (ORDER BY pos) - 1 AS pos, {_HASHED} FROM existing),
{_merge},
merged AS (SELECT pos, id, CASE WHEN changed THEN name ELSE ex_name END AS name,
  {', '.join(f'CASE WHEN changed THEN {f} ELSE fin_{f} END AS {f}' for f in _FIELDS)} FROM mm
  UNION ALL SELECT pos, id, name, {', '.join(_FIELDS)} FROM un),
every AS (SELECT row_number() OVER (ORDER BY pos) - 1 + {1 << 40} AS pos, id, name, {', '.join(_FIELDS)} FROM merged
  UNION ALL SELECT pos, id, name, {', '.join(_FIELDS)} FROM e2 WHERE id NOT IN (SELECT id FROM c2))
SELECT pos, id, name, address, city, state, country, postal_code, '' AS phone,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM every""", "centres", "existing")
