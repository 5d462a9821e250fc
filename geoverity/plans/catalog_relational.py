"""Registered queries: candidate retrieval, validation and dataset update."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import candidates as C
from ..operators import merge as U
from ..operators import validate as V
from . import inputs
from .registry import on_land_sql, r6, register

# ---------------------------------------------------------------------------
# C1-C4, C10, C11
# ---------------------------------------------------------------------------
_TOP5 = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos, query_rank, provider ORDER BY cand_pos) AS rn5
                FROM candidates) x WHERE rn5 <= 5)"""


@register("candidates_all_providers", f"""
SELECT pos, query_rank, provider, cand_pos FROM {_TOP5} t""", ("candidates",))
def q_c1(spark, sf):
    return C.candidates_all_providers(inputs.candidates(spark, sf)).select(
        "pos", "query_rank", "provider", "cand_pos")


@register("candidates_fallback", """
SELECT pos, query_rank, provider, cand_pos FROM (
  SELECT *, min(provider_rank) OVER (PARTITION BY pos, query_rank) AS fp FROM candidates) x
WHERE provider_rank = fp""", ("candidates",))
def q_c2(spark, sf):
    return C.candidates_fallback(inputs.candidates(spark, sf)).select("pos", "query_rank", "provider", "cand_pos")


@register("first_successful_query", """
SELECT pos, query_rank, provider, cand_pos FROM (
  SELECT *, min(query_rank) OVER (PARTITION BY pos) AS fq FROM candidates) x
WHERE query_rank = fq""", ("candidates",))
def q_c3(spark, sf):
    return C.first_successful_query(inputs.candidates(spark, sf)).select("pos", "query_rank", "provider", "cand_pos")


@register("candidates_batch", f"""
WITH t AS {_TOP5},
f AS (SELECT *, min(provider_rank) OVER (PARTITION BY pos, query_rank) AS fp FROM t),
g AS (SELECT * FROM f WHERE provider_rank = fp),
h AS (SELECT *, min(query_rank) OVER (PARTITION BY pos) AS fq FROM g)
SELECT c.id, h.pos, h.query_rank, h.provider, h.cand_pos FROM h JOIN centres c ON c.pos = h.pos
WHERE h.query_rank = h.fq""", ("candidates", "centres"))
def q_c4(spark, sf):
    b = C.candidates_batch(inputs.candidates(spark, sf))
    cen = inputs.centres(spark, sf).select("pos", "id")
    return b.join(cen, "pos").select("id", "pos", "query_rank", "provider", "cand_pos")


@register("pending_centres", """
SELECT pos, id FROM centres WHERE latitude IS NULL OR longitude IS NULL""", ("centres",))
def q_c10(spark, sf):
    return C.pending_centres(inputs.centres(spark, sf)).select("pos", "id")


@register("provider_usage", """
WITH calls AS (SELECT DISTINCT pos, query_rank, provider FROM candidates),
t AS (SELECT *, min(query_rank) OVER (PARTITION BY pos) AS fq FROM calls)
SELECT provider, count(*) AS calls FROM t WHERE query_rank = fq GROUP BY provider""", ("candidates",))
def q_c11(spark, sf):
    return C.provider_usage(inputs.candidates(spark, sf))


# ---------------------------------------------------------------------------
# V1-V4
# ---------------------------------------------------------------------------
_CANON_SQL = "CASE lower(trim(country)) " + " ".join(
    f"WHEN '{v}' THEN '{c}'" for c, vs in K.COUNTRY_ALIASES.items() for v in dict.fromkeys(vs + [c.lower()])
) + " ELSE upper(trim(country)) END"
_VALID = ", ".join(f"'{c}'" for c in K.VALID_COUNTRIES)
_V1 = f"""
CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_coordinates'
     WHEN NOT {on_land_sql('latitude', 'longitude')} THEN 'ocean_coordinates'
     WHEN country <> '' AND ({_CANON_SQL}) NOT IN ({_VALID}) THEN 'wrong_country: ' || country END"""
_V1_AT = f"""
CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'coordination_check'
     WHEN NOT {on_land_sql('latitude', 'longitude')} THEN 'ocean_check'
     WHEN country <> '' AND ({_CANON_SQL}) NOT IN ({_VALID}) THEN 'country_check' END"""


@register("validate_stateless", f"""
SELECT pos, {_V1} AS reason, {_V1_AT} AS failed_at, ({_V1}) IS NULL AS passes FROM centres""", ("centres",))
def q_v1(spark, sf):
    return V.validate_stateless(inputs.centres(spark, sf))


@register("confidence_filter", """
SELECT pos, id, round(confidence, 6) AS confidence, 'low_confidence: ' || printf('%.2f', confidence) AS reason
FROM centres WHERE confidence IS NOT NULL AND confidence < 0.6""", ("centres",))
def q_v4(spark, sf):
    return r6(V.confidence_filter(inputs.centres(spark, sf)))


@register("validate_centres")
def q_v2(spark, sf):
    return V.validate_centres(inputs.centres(spark, sf))


@register("validation_summary")
def q_v3(spark, sf):
    return V.validation_summary(V.validate_centres(inputs.centres(spark, sf)))


@register("failed_report")
def q_k3(spark, sf):
    """K3: id, name, city, state, country, coordinates, reasons, failed_at of failed rows."""
    res = V.validate_centres(inputs.centres(spark, sf)).filter(~F.col("is_valid"))
    cen = inputs.centres(spark, sf)
    return r6(res.join(cen, "pos").select("pos", "id", "name", "city", "state", "country", "latitude",
                                           "longitude", F.col("reason").alias("failure_reasons"), "failed_at"))


# ---------------------------------------------------------------------------
# U1-U6
# ---------------------------------------------------------------------------
_FIELDS = K.LOCATION_FIELDS


def _merge_cte() -> str:
    cmp_cols = ",\n".join(
        f"  coalesce(last_value(n.{f} IGNORE NULLS) OVER (PARTITION BY n.id ORDER BY n.pos ROWS BETWEEN UNBOUNDED "
        f"PRECEDING AND 1 PRECEDING), ex.{f}) AS cmp_{f},\n"
        f"  coalesce(last_value(n.{f} IGNORE NULLS) OVER (PARTITION BY n.id ORDER BY n.pos ROWS BETWEEN UNBOUNDED "
        f"PRECEDING AND UNBOUNDED FOLLOWING), ex.{f}) AS fin_{f}" for f in _FIELDS)
    sel = ", ".join(f"n.{f}" for f in _FIELDS)
    changed = " OR ".join(f"(m.{f} IS NOT NULL AND m.{f} IS DISTINCT FROM m.cmp_{f})" for f in _FIELDS)
    return f"""
WITH ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS rn
                           FROM existing WHERE id <> '') x WHERE rn = 1),
n AS (SELECT pos, id, name, {', '.join(_FIELDS)} FROM centres),
m AS (SELECT n.pos, n.id, n.name, ex.name AS ex_name, {sel},
{cmp_cols}
  FROM n JOIN ex ON ex.id = n.id),
mm AS (SELECT m.*, ({changed}) AS changed FROM m),
un AS (SELECT n.* FROM n WHERE n.id NOT IN (SELECT id FROM ex))"""


@register("merge_dataset", _merge_cte() + f"""
SELECT pos, id, CASE WHEN changed THEN name ELSE ex_name END AS name,
  {', '.join(f'CASE WHEN changed THEN {f} ELSE fin_{f} END AS {f}' for f in _FIELDS)},
  CASE WHEN changed THEN 'updated' ELSE 'unchanged' END AS status FROM mm
UNION ALL
SELECT pos, id, name, {', '.join(_FIELDS)}, 'new' AS status FROM un""", ("centres", "existing"))
def q_u1(spark, sf):
    return U.merge_dataset(inputs.existing(spark, sf), inputs.centres(spark, sf))


@register("update_summary", _merge_cte() + """
SELECT (SELECT count(*) FROM centres) AS total,
       (SELECT count(*) FROM un) AS new_centres,
       (SELECT count(*) FROM mm WHERE changed) AS updated_centres,
       (SELECT count(*) FROM (SELECT DISTINCT id FROM existing WHERE id <> ''
                              EXCEPT SELECT DISTINCT id FROM centres WHERE id <> '') r) AS removed_centres,
       (SELECT count(*) FROM mm WHERE NOT changed) AS unchanged_centres""", ("centres", "existing"))
def q_u3(spark, sf):
    return U.update_summary(inputs.existing(spark, sf), inputs.centres(spark, sf))


@register("removed_centres", """
SELECT DISTINCT id FROM existing WHERE id <> '' AND id NOT IN (SELECT id FROM centres WHERE id <> '')""",
          ("centres", "existing"))
def q_u4(spark, sf):
    return U.removed_centres(inputs.existing(spark, sf), inputs.centres(spark, sf))


def _txt(f: str, col: str) -> str:
    if f in ("latitude", "longitude"):
        return f"coalesce(CAST({col} AS VARCHAR), '')"
    return f"coalesce({col}, '')"


@register("change_log", _merge_cte() + "\n" + "\nUNION ALL\n".join(
    f"SELECT pos, id, coalesce(ex_name, '') AS name, '{f}' AS field, {_txt(f, 'cmp_' + f)} AS old_value, "
    f"{_txt(f, f)} AS new_value FROM mm WHERE changed AND {f} IS NOT NULL AND {f} IS DISTINCT FROM cmp_{f}"
    for f in _FIELDS), ("centres", "existing"))
def q_u5(spark, sf):
    return U.change_log(inputs.existing(spark, sf), inputs.centres(spark, sf))


@register("duplicate_coords", """
WITH k AS (SELECT *, coalesce(CAST(latitude AS VARCHAR), 'None') || '_' || coalesce(CAST(longitude AS VARCHAR), 'None') AS key
           FROM centres)
SELECT pos, id, name, city, state, country, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)""", ("centres",))
def q_u6(spark, sf):
    return r6(U.duplicate_coords(inputs.centres(spark, sf)).select(
        "pos", "id", "name", "city", "state", "country", "latitude", "longitude"))
