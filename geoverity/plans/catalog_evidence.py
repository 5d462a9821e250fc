"""Registered queries: geography, consensus, place type and the fusion arms
that need no string similarity (all with DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from ..operators import evidence as E
from ..operators import fusion as FU
from ..operators.candidates import candidates_all_providers
from ..operators.consensus import provider_consensus, ungrouped_evidence
from . import inputs
from .geocode import CAND_FIELDS, REF_FIELDS, latest_by_id, with_missing
from .registry import hav_sql, on_land_sql, precision_sql, r6, register


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _cand_geo(spark, sf):
    """Candidates with the parsed raw record and their centre's reference fields."""
    c = E.with_raw_features(inputs.candidates(spark, sf))
    cen = inputs.centres(spark, sf).select(
        "pos", *[F.coalesce(F.col(f), F.lit("")).alias(f"ref_{f}")
                 for f in ["id", "name", "address", "city", "state", "country", "postal_code"]],
        F.col("latitude").alias("ref_latitude"), F.col("longitude").alias("ref_longitude"))
    return c.join(cen, "pos")


# E6 ------------------------------------------------------------------------
@register("haversine_km", f"""
SELECT k.pos, k.cand_pos, round({hav_sql('k.latitude', 'k.longitude', 'c.latitude', 'c.longitude')}, 6) AS distance_km
FROM candidates k JOIN centres c ON c.pos = k.pos""", ("candidates", "centres"))
def q_haversine(spark, sf):
    c = _cand_geo(spark, sf)
    return r6(c.select("pos", "cand_pos", geo.haversine_km(
        "latitude", "longitude", "ref_latitude", "ref_longitude").alias("distance_km")))


# E7 ------------------------------------------------------------------------
@register("on_land", f"""
SELECT pos, {on_land_sql('latitude', 'longitude')} AS on_land FROM centres""", ("centres",))
def q_on_land(spark, sf):
    return inputs.centres(spark, sf).select("pos", geo.on_land("latitude", "longitude").alias("on_land"))


# E8 ------------------------------------------------------------------------
@register("coordinate_precision", f"""
SELECT pos, cand_pos, round({precision_sql('latitude', 'longitude')}, 6) AS coordinate_precision
FROM candidates""", ("candidates",))
def q_precision(spark, sf):
    c = inputs.candidates(spark, sf)
    return r6(c.select("pos", "cand_pos",
                       geo.coordinate_precision("latitude", "longitude").alias("coordinate_precision")))


# E9 ------------------------------------------------------------------------
@register("city_center_distance", f"""
SELECT k.pos, k.cand_pos,
  round({hav_sql('k.latitude', 'k.longitude', 'y.city_lat', 'y.city_lon')}, 6) AS distance_from_city_center
FROM candidates k LEFT JOIN cities y ON y.city = lower(k.city)""", ("candidates", "cities"))
def q_city_distance(spark, sf):
    c = inputs.candidates(spark, sf)
    return r6(c.select("pos", "cand_pos", geo.distance_from_city_centre(
        F.col("city"), F.col("latitude"), F.col("longitude")).alias("distance_from_city_center")))


# E12 -----------------------------------------------------------------------
_EDU = ", ".join(f"'{x}'" for x in K.NEARBY_EDUCATIONAL_TYPES)
_NONLM = ", ".join(f"'{x}'" for x in K.NON_LANDMARK_TYPES)


@register("reverse_flags", f"""
SELECT pos, cand_pos,
  CASE WHEN raw_type <> '' THEN false END AS urban_area,
  (raw_type <> '' AND lower(raw_type) IN ({_EDU})) AS nearby_educational,
  false AS nearby_roads,
  false AS nearby_landmarks
FROM candidates""", ("candidates",))
def q_reverse_flags(spark, sf):
    c = E.geography_evidence(_cand_geo(spark, sf))
    g = F.col("geography")
    return c.select("pos", "cand_pos", g["urban_area"].alias("urban_area"),
                    g["nearby_educational"].alias("nearby_educational"),
                    g["nearby_roads"].alias("nearby_roads"), g["nearby_landmarks"].alias("nearby_landmarks"))


# E13 -----------------------------------------------------------------------
@register("distance_from_previous", f"""
WITH prev AS (SELECT id, latitude AS plat, longitude AS plon FROM
                (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS rn
                 FROM existing WHERE id <> '') x WHERE rn = 1)
SELECT k.pos, k.cand_pos,
  round(CASE WHEN p.plat IS NOT NULL AND p.plon IS NOT NULL
        THEN {hav_sql('k.latitude', 'k.longitude', 'p.plat', 'p.plon')} END, 6) AS distance_from_previous
FROM candidates k JOIN centres c ON c.pos = k.pos LEFT JOIN prev p ON p.id = c.id""",
          ("candidates", "centres", "existing"))
def q_distance_prev(spark, sf):
    prev = latest_by_id(inputs.existing(spark, sf)).select(
        F.col("id").alias("p_id"), F.col("latitude").alias("prev_latitude"),
        F.col("longitude").alias("prev_longitude"))
    c = _cand_geo(spark, sf).join(prev, F.col("ref_id") == F.col("p_id"), "left")
    c = E.geography_evidence(c, "prev_latitude", "prev_longitude")
    return r6(c.select("pos", "cand_pos",
                       F.col("geography")["distance_from_previous"].alias("distance_from_previous")))


# E14 / E15 -----------------------------------------------------------------
_PW = " ".join(f"WHEN '{p}' THEN {D(w)}" for p, w in K.PROVIDER_WEIGHTS.items())
_CONSENSUS_CTE = f"""
WITH r AS (SELECT pos, arg_min(latitude, cand_pos) AS rlat, arg_min(longitude, cand_pos) AS rlon
           FROM candidates GROUP BY pos),
d AS (SELECT k.pos, k.provider, k.cand_pos, k.latitude, k.longitude,
             {hav_sql('k.latitude', 'k.longitude', 'r.rlat', 'r.rlon')} <= 5.0 AS agree
      FROM candidates k JOIN r ON r.pos = k.pos),
fa AS (SELECT pos, provider, min(CASE WHEN agree THEN cand_pos END) AS first_agree FROM d GROUP BY pos, provider),
pts AS (SELECT d.* FROM d JOIN fa ON fa.pos = d.pos AND fa.provider = d.provider
        WHERE fa.first_agree IS NULL OR d.cand_pos <= fa.first_agree),
pv AS (SELECT pos, CASE WHEN count(*) < 2 THEN {D(0)} ELSE sqrt(var_pop(latitude) + var_pop(longitude)) END
              AS coordinate_variance FROM pts GROUP BY pos),
pc AS (SELECT pos, count(DISTINCT provider) AS providers_total,
              count(DISTINCT CASE WHEN agree THEN provider END) AS providers_agreeing FROM d GROUP BY pos),
w AS (SELECT pos, avg(wt) AS mean_provider_weight FROM
        (SELECT DISTINCT pos, provider, CASE provider {_PW} ELSE {D(0.5)} END AS wt FROM d) x GROUP BY pos),
pe AS (SELECT pc.pos, pc.providers_total, pc.providers_agreeing,
              {D('pc.providers_agreeing')} / pc.providers_total AS consensus_ratio,
              (pc.providers_total >= 2 AND {D('pc.providers_agreeing')} / pc.providers_total < 0.5) AS disagreement,
              w.mean_provider_weight, pv.coordinate_variance
       FROM pc JOIN pv ON pv.pos = pc.pos JOIN w ON w.pos = pc.pos)"""


def _consensus(spark, sf):
    return provider_consensus(inputs.candidates(spark, sf))


@register("provider_consensus", _CONSENSUS_CTE + """
SELECT pos, providers_total, providers_agreeing, round(consensus_ratio, 6) AS consensus_ratio,
       disagreement, round(mean_provider_weight, 6) AS mean_provider_weight FROM pe""", ("candidates",))
def q_consensus(spark, sf):
    p = F.col("provider_evidence")
    return r6(_consensus(spark, sf).select(
        "pos", p["providers_total"].cast("long").alias("providers_total"),
        p["providers_agreeing"].cast("long").alias("providers_agreeing"),
        p["consensus_ratio"].alias("consensus_ratio"), p["disagreement"].alias("disagreement"),
        p["mean_provider_weight"].alias("mean_provider_weight")))


@register("coordinate_variance", _CONSENSUS_CTE + """
SELECT pos, round(coordinate_variance, 6) AS coordinate_variance FROM pe""", ("candidates",))
def q_variance(spark, sf):
    p = F.col("provider_evidence")
    return r6(_consensus(spark, sf).select(
        "pos", p["coordinate_variance"].alias("coordinate_variance")))


# E16 -----------------------------------------------------------------------
@register("cluster_center", f"""
WITH n AS (
  SELECT a.pos, a.cand_pos, a.latitude, a.longitude,
         sum(CASE WHEN b.cand_pos IS NOT NULL AND
                  {hav_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 5.0 THEN 1 ELSE 0 END) AS nn
  FROM candidates a LEFT JOIN candidates b ON b.pos = a.pos AND b.cand_pos <> a.cand_pos
  GROUP BY a.pos, a.cand_pos, a.latitude, a.longitude),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY nn DESC, cand_pos) AS rn FROM n)
SELECT pos, round(latitude, 6) AS center_lat, round(longitude, 6) AS center_lon, CAST(nn AS INTEGER) AS neighbours
FROM r WHERE rn = 1""", ("candidates",))
def q_cluster(spark, sf):
    c = inputs.candidates(spark, sf).select("pos", "cand_pos", "latitude", "longitude")
    return r6(E.cluster_centre(c))


# E17 / E18 -----------------------------------------------------------------
_POS = ", ".join(f"'{x}'" for x in K.POSITIVE_TYPES)
_NEG = " ".join(f"WHEN '{t}' THEN '{lab}'" for t, lab in K.NEGATIVE_TYPES.items())
_KW = " OR ".join(f"contains(lower(name), '{k}')" for k in K.EDUCATIONAL_KEYWORDS)
_PT_CTE = f"""
WITH t AS (SELECT pos, cand_pos, name, lower(raw_type) AS ptype,
                  CASE lower(raw_type) {_NEG} END AS neg_label FROM candidates)"""


@register("extract_place_type", """
SELECT pos, cand_pos, lower(raw_type) AS place_type FROM candidates""", ("candidates",))
def q_extract_type(spark, sf):
    c = E.with_raw_features(inputs.candidates(spark, sf))
    return c.select("pos", "cand_pos",
                    E.extract_place_type(F.col("rawf"), F.col("raw_nonempty")).alias("place_type"))


@register("place_type", _PT_CTE + f"""
SELECT pos, cand_pos,
  CASE WHEN ptype IN ({_POS}) THEN ptype WHEN neg_label IS NOT NULL THEN ptype
       WHEN {_KW} THEN 'educational_keyword_match' ELSE 'unknown' END AS category,
  CASE WHEN ptype IN ({_POS}) THEN {D(0.9)} WHEN neg_label IS NOT NULL THEN {D(0.8)}
       WHEN {_KW} THEN {D(0.7)} ELSE {D(0.3)} END AS confidence,
  (ptype IN ({_POS}) OR (neg_label IS NULL AND ({_KW}))) AS is_educational,
  (ptype NOT IN ({_POS}) AND neg_label IS NOT NULL) AS is_negative_type,
  CASE WHEN ptype NOT IN ({_POS}) AND neg_label IS NOT NULL THEN neg_label ELSE '' END AS negative_type_detail
FROM t""", ("candidates",))
def q_place_type(spark, sf):
    c = E.place_type_evidence(E.with_raw_features(inputs.candidates(spark, sf)))
    return c.select("pos", "cand_pos", "place_type.*")


@register("fusion_place_type", _PT_CTE + f"""
SELECT pos, cand_pos,
  round(CASE WHEN ptype IN ({_POS}) THEN {D(0.9)} WHEN neg_label IS NOT NULL THEN {D(0)}
       WHEN {_KW} THEN {D(0.7)} ELSE {D(0.3)} END, 6) AS place_type_score
FROM t""", ("candidates",))
def q_fusion_place_type(spark, sf):
    c = E.place_type_evidence(E.with_raw_features(inputs.candidates(spark, sf)))
    return r6(c.select("pos", "cand_pos", FU.score_place_type(F.col("place_type")).alias("place_type_score")))


# F2 ------------------------------------------------------------------------
@register("fusion_geography", f"""
WITH g AS (
  SELECT k.pos, k.cand_pos, k.raw_type <> '' AS ne, lower(k.raw_type) AS rtype,
    {hav_sql('k.latitude', 'k.longitude', 'y.city_lat', 'y.city_lon')} AS dcc,
    {on_land_sql('k.latitude', 'k.longitude')} AS land,
    {precision_sql('k.latitude', 'k.longitude')} AS prec
  FROM candidates k JOIN centres c ON c.pos = k.pos LEFT JOIN cities y ON y.city = lower(c.city))
SELECT pos, cand_pos, round(CASE WHEN NOT land THEN {D(0)} ELSE least({D(1)},
   CASE WHEN dcc IS NULL THEN {D(0)} WHEN dcc <= 1.0 THEN {D(0.30)} WHEN dcc <= 5.0 THEN {D(0.25)}
        WHEN dcc <= 20.0 THEN {D(0.15)} WHEN dcc <= 50.0 THEN {D(0.05)} ELSE {D(0)} END
   + CASE WHEN ne THEN {D(0.15)} ELSE {D(0)} END
   + CASE WHEN ne AND rtype IN ({_EDU}) THEN {D(0.10)} ELSE {D(0)} END
   + prec * {D(0.10)}) END, 6) AS geography_score
FROM g""", ("candidates", "centres", "cities"))
def q_fusion_geo(spark, sf):
    c = E.geography_evidence(_cand_geo(spark, sf))
    return r6(c.select("pos", "cand_pos", FU.score_geography(F.col("geography")).alias("geography_score")))


# F3 ------------------------------------------------------------------------
@register("fusion_provider", _CONSENSUS_CTE + f""",
s AS (SELECT pos, providers_total, coordinate_variance, disagreement,
        {D('providers_agreeing')} / providers_total * {D(0.6)}
        + CASE WHEN providers_agreeing >= 3 THEN {D(0.3)} WHEN providers_agreeing >= 2 THEN {D(0.2)}
               WHEN providers_agreeing >= 1 THEN {D(0.1)} ELSE {D(0)} END
        + mean_provider_weight * {D(0.1)} AS s0 FROM pe),
s2 AS (SELECT pos, providers_total, coordinate_variance,
        CASE WHEN disagreement THEN s0 * {D(0.5)} ELSE s0 END AS s1 FROM s)
SELECT pos, round(CASE WHEN providers_total = 0 THEN {D(0)} ELSE least({D(1)},
   CASE WHEN coordinate_variance > 0.1 THEN s1 * {D(0.7)} WHEN coordinate_variance > 0.01 THEN s1 * {D(0.9)}
        ELSE s1 END) END, 6) AS provider_score FROM s2""", ("candidates",))
def q_fusion_provider(spark, sf):
    return r6(_consensus(spark, sf).select("pos", FU.score_provider(F.col("provider_evidence")).alias("provider_score")))


# C1-based consensus used by the pipeline: top-5 per provider first ---------
@register("consensus_top5", _CONSENSUS_CTE.replace(
    "FROM candidates GROUP BY pos", "FROM top5 GROUP BY pos").replace(
    "FROM candidates k JOIN r", "FROM top5 k JOIN r").replace(
    "WITH r AS", """WITH top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos, query_rank, provider
       ORDER BY cand_pos) AS rn5 FROM candidates) x WHERE rn5 <= 5),
r AS""") + """
SELECT pos, providers_total, providers_agreeing, round(coordinate_variance, 6) AS coordinate_variance FROM pe""",
          ("candidates",))
def q_consensus_top5(spark, sf):
    c = provider_consensus(candidates_all_providers(inputs.candidates(spark, sf)))
    p = F.col("provider_evidence")
    return r6(c.select(
        "pos", p["providers_total"].cast("long").alias("providers_total"),
        p["providers_agreeing"].cast("long").alias("providers_agreeing"),
        p["coordinate_variance"].alias("coordinate_variance")))


# E14 without results by provider ---------------------------------------------
@register("consensus_ungrouped", f"""
SELECT pos, cand_pos, 1 AS providers_agreeing, 1 AS providers_total, {D(1)} AS consensus_ratio,
  {D(0)} AS coordinate_variance, CASE provider {_PW} ELSE {D(0.5)} END AS weight, false AS disagreement
FROM candidates""", ("candidates",))
def q_ungrouped(spark, sf):
    p = F.col("provider_evidence")
    return r6(ungrouped_evidence(inputs.candidates(spark, sf)).select(
        "pos", "cand_pos", *[p[f].alias(f) for f in ("providers_agreeing", "providers_total", "consensus_ratio",
                                                     "coordinate_variance", "disagreement")],
        F.element_at("provider_weights", F.col("provider")).alias("weight")))


# E20 skipped collectors ------------------------------------------------------
#: Raw records that some collector cannot read, planted by (pos * 7 + cand_pos) mod 12; at 5 the longitude overflows.
ODD_RAW = {1: "[1]", 2: '{"type":"school","city":null}', 3: '{"type":7}', 4: '{"tags":5}'}


@register("skipped_collectors", f"""
WITH k AS (SELECT k.pos, k.cand_pos, k.provider, k.latitude, k.longitude, k.name, (k.pos * 7 + k.cand_pos) % 12 AS m,
    CASE (k.pos * 7 + k.cand_pos) % 12 WHEN 2 THEN 'school' WHEN 4 THEN '' ELSE lower(k.raw_type) END AS ptype,
    y.city IS NOT NULL AS known
  FROM candidates k JOIN centres c ON c.pos = k.pos LEFT JOIN cities y ON y.city = lower(c.city)),
r AS (SELECT pos, arg_min(latitude, cand_pos) AS rlat, arg_min(longitude, cand_pos) AS rlon,
    arg_min(m, cand_pos) AS rm, count(DISTINCT provider) AS total FROM k GROUP BY pos),
d AS (SELECT k.*, r.total, CASE WHEN k.m <> 5 AND r.rm <> 5 THEN
    {hav_sql('k.latitude', 'k.longitude', 'r.rlat', 'r.rlon')} <= 5.0 END AS agree FROM k JOIN r ON r.pos = k.pos),
fa AS (SELECT pos, provider, min(CASE WHEN agree THEN cand_pos END) AS first_agree FROM d GROUP BY pos, provider),
bad AS (SELECT d.pos, bool_or(d.m = 5) AS failed FROM d JOIN fa ON fa.pos = d.pos AND fa.provider = d.provider
  WHERE fa.first_agree IS NULL OR d.cand_pos <= fa.first_agree GROUP BY d.pos),
t AS (SELECT d.*, bad.failed, {_KW} AS kw, ptype IN ({_POS}) AS is_pos, CASE ptype {_NEG} END IS NOT NULL AS is_neg
  FROM d JOIN bad ON bad.pos = d.pos),
s AS (SELECT *, m IN (1, 2, 3, 4) OR (m = 5 AND known) AS no_geo, m IN (1, 3) OR (m = 4 AND NOT kw) AS no_type FROM t)
SELECT pos, cand_pos, concat_ws(',', CASE WHEN no_geo THEN 'geography' END, CASE WHEN failed THEN 'provider' END,
    CASE WHEN no_type THEN 'place_type' END) AS skipped_collectors,
  CASE WHEN no_geo THEN true WHEN m = 5 THEN false ELSE {on_land_sql('latitude', 'longitude')} END AS on_land,
  CASE WHEN failed THEN 0 ELSE CAST(total AS INTEGER) END AS providers_total,
  CASE WHEN no_type THEN {D(0)} WHEN is_pos THEN {D(0.9)} WHEN is_neg THEN {D(0.8)} WHEN kw THEN {D(0.7)}
    ELSE {D(0.3)} END AS place_confidence FROM s""", ("candidates", "centres", "cities"))
def q_skipped(spark, sf):
    m = (F.col("pos") * 7 + F.col("cand_pos")) % 12
    raw = F.col("raw")
    for k, text in ODD_RAW.items():
        raw = F.when(m == k, F.lit(text)).otherwise(raw)
    c = inputs.candidates(spark, sf).withColumn("raw", raw).withColumn(
        "longitude", F.when(m == 5, F.lit(float("inf"))).otherwise(F.col("longitude")))
    ref = inputs.centres(spark, sf).select("pos", *[F.coalesce(F.col(f), F.lit("")).alias(f"ref_{f}") for f in REF_FIELDS])
    ev = E.collect_evidence(E.with_raw_features(with_missing(c, CAND_FIELDS)).join(ref, "pos"))
    return ev.select("pos", "cand_pos", F.array_join("skipped_collectors", ",").alias("skipped_collectors"),
                     F.col("geography.on_land").alias("on_land"),
                     F.col("provider_evidence.providers_total").alias("providers_total"),
                     F.col("place_type.confidence").alias("place_confidence"))
