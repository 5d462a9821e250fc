"""Evidence collectors (text, geography, provider consensus, place type, history).

Input relation: one row per candidate, already joined to its reference centre
(``ref_*`` columns) and carrying ``pos`` (centre key) and ``cand_pos`` (position
in the centre's candidate list). Everything is column arithmetic except the
provider consensus, which is a per-centre aggregate computed with windows over
``pos`` -- the same partitioning as the join that built the relation, so no
extra shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo, similarity as sim
from .cluster import neighbours
from ..functions.text import (alias_detected, bound, kept_texts, lower_words, normalize_country, py_fixed, strip_column,
                              transliteration_match)

# Fields of a candidate's raw provider record that the collectors read.
RAW_SCHEMA = (
    "type string, category string, class string, city string, state string, country string, "
    "road string, street string, name string, distance_km double, "
    "tags struct<amenity:string, building:string, landuse:string>, "
    "properties struct<category:string, type:string>"
)


def _s(x) -> Column:
    """String column with NULL -> ""."""
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def with_raw_faults(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds ``raw_faults``, what a raw record holds that a collector cannot read, as a struct of flags: ``geography`` and
    ``place_type`` (a value of the wrong type that the collector always reads), ``tags`` (tags that are no
    object, read only where nothing else has told the place type).

    An empty or unreadable record has no fault, as collectors leave it alone. The parsed record and the types of its
    values are columns, so that each is found once and all of it is compiled."""
    raw = F.col(raw_col)
    plain = ("city", "state", "country", "type", "category", "class", "tags", "properties")
    nested = {"tags": ("amenity", "building", "landuse"), "properties": ("category", "type")}
    blank = raw.rlike(r'^\s*(\{\s*\}|\[\s*\]|""|null|false|-?0+(\.0+)?)\s*$')
    out = df.withColumn("_raw", F.when(raw.isNotNull() & ~blank, F.try_parse_json(raw)))

    def fields(value: str, names: tuple[str, ...]) -> Column:
        """The fields of an object in one pass, as they are; NULL where they are absent or the value is no object."""
        return F.try_variant_get(value, "$", f"struct<{', '.join(f'`{n}`: variant' for n in names)}>")
    out = out.withColumn("_whole", fields("_raw", plain)).withColumns(
        {f"_{f}": fields(f"_whole.{f}", names) for f, names in nested.items()})
    # the type of each value that a collector may read; NULL where it is absent (null is a value like any other)
    read = {**{f: f"_whole.{f}" for f in plain}, **{f: f"_tags.{f}" for f in nested["tags"]},
            **{f"p_{f}": f"_properties.{f}" for f in nested["properties"]}}
    out = out.withColumns({f"_type_{f}": F.schema_of_variant(c) for f, c in read.items()})

    def there(f: str) -> Column:
        return F.col(f"_type_{f}").isNotNull()

    def unreadable(f: str) -> Column:
        return F.coalesce(F.col(f"_type_{f}") != "STRING", F.lit(False))

    def no_object(f: str) -> Column:
        return F.coalesce(~F.col(f"_type_{f}").startswith("OBJECT"), F.lit(False))

    def told(field: str) -> Column:
        return F.lower(F.coalesce(F.try_variant_get(f"_whole.{field}", "$", "string"), F.lit(""))).isin(*K.NEARBY_EDUCATIONAL_TYPES)
    odd_tags = no_object("tags")
    geography = reduce(lambda a, b: a | b, [unreadable(f) for f in ("city", "state", "country", "type", "category")])
    tag = (F.when(there("amenity"), unreadable("amenity")).when(there("building"), unreadable("building"))
            .otherwise(unreadable("landuse")))
    place = (F.when(no_object("properties"), F.lit(True))
              .when(there("properties"), F.when(there("p_category"), unreadable("p_category")).otherwise(unreadable("p_type")))
              .when(there("type"), unreadable("type")).when(there("class"), unreadable("class"))
              .when(odd_tags, F.lit(False)).otherwise(tag))
    # a record that was parsed is an object if it begins like one
    parsed, whole = F.col("_raw").isNotNull(), raw.rlike(r"^\s*\{")
    faults = F.struct(
        (parsed & (~whole | geography | (odd_tags & ~(told("type") | told("category"))))).alias("geography"),
        (parsed & (~whole | place)).alias("place_type"),
        (parsed & whole & odd_tags).alias("tags"))
    return out.withColumn("raw_faults", faults).drop("_raw", "_whole", "_tags", "_properties", *[f"_type_{f}" for f in read])


def with_raw_features(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Parse the raw JSON record into a narrow struct ``rawf``, a non-empty flag and
    ``raw_faults``, so later stages never carry the payload."""
    raw = F.col(raw_col)
    # a JSON object with at least one key (no second parse: ``{}`` is the empty one)
    nonempty = raw.isNotNull() & raw.rlike(r"^\s*\{") & ~raw.rlike(r"^\s*\{\s*\}\s*$")
    return with_raw_faults(df.withColumn("raw_nonempty", F.coalesce(nonempty, F.lit(False)))
                             .withColumn("rawf", F.from_json(raw, RAW_SCHEMA)), raw_col)


# ---------------------------------------------------------------------------
# E1-E5 text evidence
# ---------------------------------------------------------------------------
def country_similarity(q, t) -> Column:
    """Empty -> 0; equal canonical forms -> 1; else fuzzy."""
    q, t = _s(q), _s(t)
    return (F.when((q == "") | (t == ""), F.lit(0.0))
             .when(normalize_country(q) == normalize_country(t), F.lit(1.0))
             .otherwise(sim.fuzzy_score(q, t)))


def postal_similarity(q, t) -> Column:
    """Empty -> 0; equal (stripped) -> 1; one a prefix of the other -> 0.5; else fuzzy."""
    q, t = _s(q), _s(t)
    qs, ts = strip_column(q), strip_column(t)
    return (F.when((q == "") | (t == ""), F.lit(0.0))
             .when(qs == ts, F.lit(1.0))
             .when(qs.startswith(ts) | ts.startswith(qs), F.lit(0.5))
             .otherwise(sim.fuzzy_score(qs, ts)))


def text_evidence(df: DataFrame) -> DataFrame:
    """Adds struct ``text`` (8 similarities + alias + transliteration)."""
    out = df.withColumn("_admin_ref", F.trim(F.concat_ws(" ", _s("ref_state"), _s("ref_country")))) \
            .withColumn("_admin_cand", F.trim(F.concat_ws(" ", _s("state"), _s("country"))))
    for col, (a, b) in {"_s_name": ("ref_name", "name"), "_s_addr": ("ref_address", "address"),
                        "_s_city": ("ref_city", "city"), "_s_state": ("ref_state", "state"),
                        "_s_street": ("ref_address", "street"),
                        "_s_admin": ("_admin_ref", "_admin_cand")}.items():
        out = sim.with_fuzzy(out, col, a, b)
    same = sim.same_text("ref_name", "name")  # then the folds are equal and not empty, and need not be formed
    out = (out.withColumn("_fref", sim.fold(F.when(~same, _s("ref_name")))).withColumn("_fcand", sim.fold(F.when(~same, _s("name"))))
              .withColumn("_wref", lower_words("_fref")).withColumn("_wcand", lower_words("_fcand")))
    text = F.struct(
        F.col("_s_name").alias("name_similarity"),
        F.col("_s_addr").alias("address_similarity"),
        F.col("_s_city").alias("city_similarity"),
        F.col("_s_state").alias("state_similarity"),
        country_similarity("ref_country", "country").alias("country_similarity"),
        postal_similarity("ref_postal_code", "postal_code").alias("postal_similarity"),
        F.col("_s_street").alias("street_similarity"),
        F.col("_s_admin").alias("admin_area_similarity"),
        F.when(same, F.lit(False)).otherwise(alias_detected("_wref", "_wcand")).alias("alias_detected"),
        F.when(same, F.lit(True)).otherwise(transliteration_match("_fref", "_fcand")).alias("transliteration_match"),
    )
    return out.withColumn("text", text).drop(
        "_fref", "_fcand", "_wref", "_wcand", "_admin_ref", "_admin_cand", "_s_name", "_s_addr",
        "_s_city", "_s_state", "_s_street", "_s_admin")


# ---------------------------------------------------------------------------
# E6-E13 geography evidence
# ---------------------------------------------------------------------------
def reverse_match(ref_city, ref_country, rev_city, rev_country) -> Column:
    """City containment either way or Indel ratio > 70; else country containment."""
    rc, vc = F.lower(_s(ref_city)), F.lower(_s(rev_city))
    rn, vn = F.lower(_s(ref_country)), F.lower(_s(rev_country))
    both_city = (rc != "") & (vc != "")
    city_hit = both_city & (F.contains(vc, rc) | F.contains(rc, vc) | sim.ratio_holds(
        F.when(both_city, rc), F.when(both_city, vc), lambda r: r > 70))
    country_hit = (rn != "") & (vn != "") & (F.contains(vn, rn) | F.contains(rn, vn))
    return F.coalesce(city_hit, F.lit(False)) | country_hit


def admin_hierarchy_valid(ref_state, ref_country, rev_state, rev_country) -> Column:
    rs, vs = F.lower(_s(ref_state)), F.lower(_s(rev_state))
    rn, vn = F.lower(_s(ref_country)), F.lower(_s(rev_country))
    country_bad = (rn != "") & (vn != "") & ~F.contains(vn, rn) & ~F.contains(rn, vn)
    state_cmp = (rs != "") & (vs != "") & ~F.contains(vs, rs) & ~F.contains(rs, vs)
    state_bad = state_cmp & ~sim.ratio_holds(F.when(state_cmp, rs), F.when(state_cmp, vs), lambda r: r >= 60)
    return ~(country_bad | F.coalesce(state_bad, F.lit(False)))


def extract_place_type(rawf: Column, nonempty: Column) -> Column:
    """properties.category -> properties.type; type; class; tags amenity ->
    building -> landuse; lower-cased; "" when nothing (or raw empty)."""
    props = rawf["properties"]
    tags = rawf["tags"]
    return (F.when(~nonempty, F.lit(""))
             .when(props.isNotNull(), F.lower(F.coalesce(props["category"], props["type"], F.lit(""))))
             .when(rawf["type"].isNotNull(), F.lower(rawf["type"]))
             .when(rawf["class"].isNotNull(), F.lower(rawf["class"]))
             .otherwise(F.lower(F.coalesce(tags["amenity"], tags["building"], tags["landuse"],
                                           F.lit("")))))


def geography_evidence(df: DataFrame, prev_lat: str | None = None,
                       prev_lon: str | None = None) -> DataFrame:
    """Adds struct ``geography``. Reverse-record checks read ``rawf`` and only
    apply when the raw record is non-empty."""
    lat, lon = F.col("latitude"), F.col("longitude")
    rawf, ne = F.col("rawf"), F.col("raw_nonempty")
    rev_type = F.lower(_s(rawf["type"]))
    rev_cat = F.lower(_s(rawf["category"]))
    edu = F.array(*[F.lit(x) for x in K.NEARBY_EDUCATIONAL_TYPES])
    edu_amen = F.array(*[F.lit(x) for x in K.NEARBY_EDUCATIONAL_AMENITIES])
    non_landmark = F.array(*[F.lit(x) for x in K.NON_LANDMARK_TYPES])
    nearby_edu = (F.array_contains(edu, rev_type) | F.array_contains(edu, rev_cat)
                  | F.coalesce(F.array_contains(edu_amen, rawf["tags"]["amenity"]), F.lit(False)))
    has_prev = (F.col(prev_lat).isNotNull() & F.col(prev_lon).isNotNull()) if prev_lat else F.lit(False)
    dist_prev = (F.when(has_prev, geo.haversine_km(lat, lon, prev_lat, prev_lon))
                 if prev_lat else F.lit(None).cast("double"))
    g = F.struct(
        geo.distance_from_city_centre(F.col("ref_city"), lat, lon).alias("distance_from_city_center"),
        F.lit(None).cast("double").alias("distance_from_admin_boundary"),
        dist_prev.alias("distance_from_previous"),
        (ne & reverse_match("ref_city", "ref_country", rawf["city"], rawf["country"])).alias(
            "reverse_geocode_match"),
        (ne & admin_hierarchy_valid("ref_state", "ref_country", rawf["state"], rawf["country"])).alias(
            "admin_hierarchy_valid"),
        geo.coordinate_precision(lat, lon).alias("coordinate_precision"),
        geo.on_land(lat, lon).alias("on_land"),
        F.when(ne, _s(rawf["city"]) != "").alias("urban_area"),
        (ne & ((_s(rawf["road"]) != "") | (_s(rawf["street"]) != ""))).alias("nearby_roads"),
        (ne & nearby_edu).alias("nearby_educational"),
        (ne & (_s(rawf["name"]) != "") & ~F.array_contains(non_landmark, rev_type)).alias(
            "nearby_landmarks"),
    )
    return df.withColumn("geography", g)


# ---------------------------------------------------------------------------
# E14-E16 provider consensus (per centre, joined back through windows)
# ---------------------------------------------------------------------------
def provider_weight(provider) -> Column:
    kv = []
    for name, w in K.PROVIDER_WEIGHTS.items():
        kv += [F.lit(name), F.lit(w)]
    return F.coalesce(F.element_at(F.create_map(*kv), F.col(provider) if isinstance(provider, str)
                                    else provider), F.lit(K.UNKNOWN_PROVIDER_WEIGHT))


def provider_evidence(df: DataFrame, key: str = "pos", order: str = "cand_pos",
                      agree_km: float = K.PROVIDER_AGREEMENT_KM, with_failed: bool = False,
                      sorted_by: list[str] | None = None) -> DataFrame:
    """Adds struct ``provider_evidence`` (and, if asked, ``consensus_failed``: a point that it compares has an
    infinite coordinate); the same values for all candidates of a
    centre. Reference point = the first candidate of the centre; a provider
    agrees if any of its candidates is within ``agree_km``; variance is over
    each provider's points up to and including its first agreeing one.
    ``sorted_by``: columns of the same order as ``order``, if a centre's rows are sorted by them already."""
    w_centre = Window.partitionBy(key)
    earlier = Window.partitionBy(key).orderBy(*(sorted_by or [order])).rowsBetween(Window.unboundedPreceding, -1)
    named = F.coalesce(F.concat(F.lit("="), "provider"), F.lit(""))  # NULL is a provider like any other
    # the least of an order needs no sort by it
    ref = F.min_by(F.struct("latitude", "longitude"), order).over(w_centre)
    d = (df.withColumn("_ref0", ref)
           .withColumn("_dist0", geo.haversine_km("latitude", "longitude", F.col("_ref0.latitude"), F.col("_ref0.longitude")))
           .withColumn("_agree", F.col("_dist0") <= agree_km)
           # up to a provider's first agreeing point: none before it agrees (a second sort, by provider, would tell the same)
           .withColumn("_agreed", F.collect_list(F.when(F.col("_agree"), named)).over(earlier))
           .withColumn("_in_var", ~F.array_contains("_agreed", named))
           .withColumn("_pw", provider_weight("provider")))
    inlat = F.when(F.col("_in_var"), F.col("latitude"))
    inlon = F.when(F.col("_in_var"), F.col("longitude"))
    # all that a centre's candidates have in common, in one window
    odd = (F.abs("latitude") == float("inf")) | (F.abs("longitude") == float("inf"))
    d = d.withColumns({
        "_total": F.size(F.collect_set("provider").over(w_centre)),
        "_agreeing": F.size(F.collect_set(F.when(F.col("_agree"), F.col("provider"))).over(w_centre)),
        "_n_in": F.count(inlat).over(w_centre),
        # population variance over the included points of the centre
        "_var": F.var_pop(inlat).over(w_centre) + F.var_pop(inlon).over(w_centre),
        "_pws": F.collect_set(F.when(F.col("provider").isNotNull(), F.struct("provider", "_pw"))).over(w_centre),
        "consensus_failed": F.coalesce(F.max(F.col("_in_var") & odd).over(w_centre), F.lit(False))})
    # mean of the distinct providers' weights
    mean_w = F.try_divide(F.aggregate("_pws", F.lit(0.0), lambda acc, x: acc + x["_pw"]), F.size("_pws"))
    d = (d.withColumn("_var", F.when(F.col("_n_in") < 2, F.lit(0.0)).otherwise(F.sqrt("_var")))
          .withColumn("_meanw", mean_w)
          .withColumn("_pwmap", F.map_from_entries(F.array_sort("_pws"))))
    if not with_failed:
        d = d.drop("consensus_failed")
    ratio = F.when(F.col("_total") > 0, F.col("_agreeing") / F.col("_total")).otherwise(F.lit(0.0))
    pe = F.struct(
        F.col("_agreeing").cast("int").alias("providers_agreeing"),
        F.col("_total").cast("int").alias("providers_total"),
        ratio.cast("double").alias("consensus_ratio"),
        F.col("_var").alias("coordinate_variance"),
        F.col("_meanw").alias("mean_provider_weight"),
        ((F.col("_total") >= 2) & (ratio < 0.5)).alias("disagreement"),
    )
    return (d.withColumn("provider_evidence", pe)
             .withColumn("provider_weights", F.col("_pwmap"))
             .drop("_ref0", "_dist0", "_agree", "_agreed", "_in_var", "_pw", "_total", "_agreeing",
                   "_var", "_meanw", "_pwmap", "_n_in", "_pws"))


def cluster_centre(df: DataFrame, key: str = "pos", order: str = "cand_pos",
                   threshold_km: float = K.PROVIDER_AGREEMENT_KM) -> DataFrame:
    """Per centre: the point with the most other points within ``threshold_km`` (first wins; no neighbours at all ->
    first point). Neighbours are counted over cells (``operators.cluster``)."""
    best = neighbours(df, key, order, threshold_km).groupBy("k").agg(
        F.max_by(F.struct("la", "lo", "n_near"), F.struct(F.col("n_near"), -F.col("i"))).alias("b"))
    return best.select(F.col("k").alias(key), F.col("b.la").alias("center_lat"), F.col("b.lo").alias("center_lon"),
                       F.col("b.n_near").cast("int").alias("neighbours"))


# ---------------------------------------------------------------------------
# E17-E18 place type
# ---------------------------------------------------------------------------
def negative_label_map() -> Column:
    kv = []
    for t, label in K.NEGATIVE_TYPES.items():
        kv += [F.lit(t), F.lit(label)]
    return F.create_map(*kv)


def place_type_evidence(df: DataFrame) -> DataFrame:
    """Adds struct ``place_type`` (category, confidence, is_educational,
    is_negative_type, negative_type_detail)."""
    rawf, ne = F.col("rawf"), F.col("raw_nonempty")
    ptype = extract_place_type(rawf, ne)
    pos_types = F.array(*[F.lit(x) for x in K.POSITIVE_TYPES])
    neg_label = F.element_at(negative_label_map(), ptype)
    kw_hit = reduce(lambda a, b: a | b, [F.contains(F.lower(_s("name")), F.lit(k)) for k in K.EDUCATIONAL_KEYWORDS])
    amen = _s(rawf["tags"]["amenity"])
    bld = _s(rawf["tags"]["building"])
    amen_ok = ne & F.array_contains(F.array(*[F.lit(x) for x in K.EDUCATIONAL_AMENITIES]), amen)
    bld_ok = ne & F.array_contains(F.array(*[F.lit(x) for x in K.EDUCATIONAL_BUILDINGS]), bld)
    is_pos = F.array_contains(pos_types, ptype)
    is_neg = ~is_pos & neg_label.isNotNull()
    category = (F.when(is_pos | is_neg, ptype).when(kw_hit, F.lit("educational_keyword_match"))
                 .when(amen_ok, amen).when(bld_ok, F.concat(F.lit("building:"), bld))
                 .otherwise(F.lit("unknown")))
    conf = (F.when(is_pos, 0.9).when(is_neg, 0.8).when(kw_hit, 0.7).when(amen_ok, 0.85)
             .when(bld_ok, 0.8).otherwise(0.3))
    educ = is_pos | (~is_neg & (kw_hit | amen_ok | bld_ok))
    pt = F.struct(category.alias("category"), conf.cast("double").alias("confidence"),
                  educ.alias("is_educational"), is_neg.alias("is_negative_type"),
                  F.when(is_neg, neg_label).otherwise(F.lit("")).alias("negative_type_detail"))
    return df.withColumn("place_type", pt)


# ---------------------------------------------------------------------------
# E19 history
# ---------------------------------------------------------------------------
def historical_evidence(df: DataFrame, has_prev: str | None = None) -> DataFrame:
    """Adds struct ``historical``. Previous values come from columns
    ``prev_latitude, prev_longitude, prev_name, prev_address`` (NULL = none);
    ``has_prev`` names the boolean column saying a previous record exists."""
    if has_prev is None:
        h = F.struct(F.lit(False).alias("has_previous_data"), F.lit(False).alias("matches_previous"),
                     F.lit(None).cast("double").alias("distance_from_previous"),
                     F.lit(False).alias("address_changed"), F.lit(False).alias("name_changed"),
                     F.lit(False).alias("large_movement"))
        return df.withColumn("historical", h)
    hp = F.coalesce(F.col(has_prev), F.lit(False))
    coords = hp & F.col("prev_latitude").isNotNull() & F.col("prev_longitude").isNotNull()
    dist = F.when(coords, geo.haversine_km("latitude", "longitude", "prev_latitude", "prev_longitude"))
    pname, paddr = _s("prev_name"), _s("prev_address")
    name_cmp = hp & (pname != "")
    addr_cmp = hp & (paddr != "")
    name_changed = name_cmp & ~sim.ratio_holds(F.when(name_cmp, F.lower(_s("name"))), F.when(name_cmp, F.lower(pname)),
                                               lambda r: r >= 70)
    addr_changed = addr_cmp & ~sim.ratio_holds(F.when(addr_cmp, F.lower(_s("address"))), F.when(addr_cmp, F.lower(paddr)),
                                               lambda r: r >= 60)
    h = F.struct(hp.alias("has_previous_data"),
                 F.coalesce(dist <= 1.0, F.lit(False)).alias("matches_previous"),
                 dist.alias("distance_from_previous"),
                 F.coalesce(addr_changed, F.lit(False)).alias("address_changed"),
                 F.coalesce(name_changed, F.lit(False)).alias("name_changed"),
                 F.coalesce(dist > K.LARGE_MOVEMENT_KM, F.lit(False)).alias("large_movement"))
    return df.withColumn("historical", h)


# ---------------------------------------------------------------------------
# E21 signals
# ---------------------------------------------------------------------------
def _pct0(x: Column) -> Column:
    # bound: the number is formed once, and a projection with a bound variable is compiled by itself, in short methods.
    # As one piece with the projections above it, it is a method too long for the JIT compiler
    return F.concat(bound(x * 100.0, lambda v: py_fixed(v, 0)), F.lit("%"))


def positive_signals() -> Column:
    t, g, p, pt, h = (F.col("text"), F.col("geography"), F.col("provider_evidence"),
                      F.col("place_type"), F.col("historical"))
    d = h["distance_from_previous"]
    items = [
        (t["name_similarity"] >= 0.8, F.concat(F.lit("Name similarity: "), _pct0(t["name_similarity"]))),
        (t["city_similarity"] >= 0.8, F.lit("City matched")),
        (t["country_similarity"] >= 0.9, F.lit("Country matched")),
        (t["state_similarity"] >= 0.8, F.lit("State matched")),
        (g["reverse_geocode_match"], F.lit("Reverse geocode matched")),
        (g["on_land"], F.lit("On land")),
        (g["nearby_educational"], F.lit("Nearby educational institutions")),
        (p["providers_agreeing"] >= 2, F.concat(p["providers_agreeing"].cast("string"), F.lit(" providers agreed"))),
        (pt["is_educational"], F.concat(F.lit("Educational institution ("), pt["category"], F.lit(")"))),
        (h["matches_previous"], F.lit("Historical location matched")),
        (d.isNotNull() & (d < 1.0), F.concat(py_fixed(d * 1000, 0), F.lit("m from previous location"))),
    ]
    return kept_texts(items)


def negative_signals() -> Column:
    t, g, p, pt, h = (F.col("text"), F.col("geography"), F.col("provider_evidence"),
                      F.col("place_type"), F.col("historical"))
    dcc = g["distance_from_city_center"]
    items = [
        (t["name_similarity"] < 0.4, F.concat(F.lit("Low name similarity: "), _pct0(t["name_similarity"]))),
        (t["country_similarity"] < 0.5, F.lit("Country mismatch")),
        (t["city_similarity"] < 0.5, F.lit("City mismatch")),
        (~g["on_land"], F.lit("Coordinates in ocean")),
        (~g["reverse_geocode_match"] & dcc.isNotNull() & (dcc > 50),
               F.concat(py_fixed(dcc, 0), F.lit(" km from expected city"))),
        (p["disagreement"], F.lit("Provider disagreement")),
        (pt["is_negative_type"], F.concat(F.lit("Inappropriate place type: "), pt["negative_type_detail"])),
        (h["large_movement"], F.lit("Large unexpected movement from previous location")),
        (~t["alias_detected"] & (t["name_similarity"] < 0.3), F.lit("No external evidence")),
    ]
    return kept_texts(items)


def with_signals(df: DataFrame) -> DataFrame:
    return df.withColumn("positive_signals", positive_signals()).withColumn(
        "negative_signals", negative_signals())


# Evidence of a collector that failed.
DEFAULTS = {
    "geography": {"coordinate_precision": 0.0, "on_land": True, "reverse_geocode_match": False, "admin_hierarchy_valid": False,
                  "nearby_roads": False, "nearby_educational": False, "nearby_landmarks": False},
    "provider_evidence": {"providers_agreeing": 0, "providers_total": 0, "consensus_ratio": 0.0, "coordinate_variance": 0.0,
                          "disagreement": False},
    "place_type": {"category": "unknown", "confidence": 0.0, "is_educational": False, "is_negative_type": False,
                   "negative_type_detail": ""},
    "historical": {"has_previous_data": False, "matches_previous": False, "address_changed": False, "name_changed": False,
                   "large_movement": False},
}


def skip_failed(df: DataFrame, has_prev: str | None = None) -> DataFrame:
    """Adds ``skipped_collectors``, the collectors that cannot read a candidate, and gives these the evidence of
    an empty record:

    - geography, history: an infinite coordinate of the candidate, or of the previous record, where a distance is asked;
    - geography, place_type: a raw record that is no object or holds a value of the wrong type (``raw_faults``);
    - provider: an infinite coordinate among the points that its consensus compares (all candidates of the centre).

    Text evidence reads string columns and cannot fail. A row without a candidate skips nothing."""
    def infinite(*names: str) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(n)) == float("inf"), F.lit(False)) for n in names])
    place, previous = infinite("latitude", "longitude"), F.lit(False)
    if has_prev:
        asked = (F.coalesce(F.col(has_prev), F.lit(False)) & F.col("prev_latitude").isNotNull()
                 & F.col("prev_longitude").isNotNull())
        previous = asked & (place | infinite("prev_latitude", "prev_longitude"))
    near_city = geo.city_centre(F.col("ref_city")).isNotNull()
    name_told = (F.col("place_type.is_educational") | F.col("place_type.is_negative_type"))
    faults = F.col("raw_faults")
    failed = {
        "geography": faults["geography"] | (place & near_city) | previous,
        "provider": F.col("consensus_failed"),
        "place_type": faults["place_type"] | (faults["tags"] & ~name_told),
        "history": previous,
    }
    there = F.col("cand_pos").isNotNull()
    failed = {k: there & F.coalesce(c, F.lit(False)) for k, c in failed.items()}
    df = df.withColumn("skipped_collectors", kept_texts([(c, F.lit(k)) for k, c in failed.items()]))
    for column, name in (("geography", "geography"), ("provider_evidence", "provider"), ("place_type", "place_type"),
                         ("historical", "history")):
        kinds = df.schema[column].dataType
        empty = F.struct(*[F.lit(DEFAULTS[column].get(f.name)).cast(f.dataType).alias(f.name) for f in kinds.fields])
        # on the collector's own flag, so that its evidence needs no other; whole, as fields would be copied into all readers
        df = df.withColumn(column, F.when(failed[name], empty).otherwise(F.col(column)))
    return df.drop("consensus_failed")


def collect_evidence(df: DataFrame, has_prev: str | None = None, sorted_by: list[str] | None = None) -> DataFrame:
    """All five collectors for every candidate plus signals, the collectors
    skipped (``skip_failed``) and the candidate id (``id`` if present else
    ``candidate_{i}_{provider}`` with the 0-based list index)."""
    # window-based evidence first: it reuses the input's partitioning on the
    # centre key; the Arrow UDF stage of the text evidence comes after it
    out = provider_evidence(df, with_failed=True, sorted_by=sorted_by)
    if "raw_nonempty" not in out.columns:
        # only now are raw records read: those of other queries are gone, and no window has to carry what they hold
        there = F.col("cand_pos").isNotNull()
        out = with_raw_features(out).drop("raw").withColumns({
            f: F.when(there, F.col(f)) for f in ("rawf", "raw_nonempty", "raw_faults")})
    out = text_evidence(out)
    out = geography_evidence(out, "prev_latitude" if has_prev else None,
                             "prev_longitude" if has_prev else None)
    out = place_type_evidence(out)
    out = historical_evidence(out, has_prev)
    out = skip_failed(out, has_prev)
    cid = F.format_string("candidate_%d_%s", (F.col("cand_pos") - 1).cast("int"), _s("provider"))
    if "cand_id" in df.columns:
        cid = F.coalesce(F.col("cand_id"), cid)
    return with_signals(out).withColumn("candidate_id", cid)


def verifier_best(df: DataFrame, key: str = "pos") -> DataFrame:
    """Per centre the candidate with the most (positive - negative)
    signals; the first in list order wins ties."""
    w = Window.partitionBy(key).orderBy(
        F.desc(F.size("positive_signals") - F.size("negative_signals")), F.asc("cand_pos"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
