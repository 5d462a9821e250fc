"""Provider payload parsers (S9-S12): landed responses -> candidate rows.

Input: a table ``(query, provider, payload)`` of raw JSON responses. Each
parser explodes the payload's result list (order kept as ``cand_rank``) and
maps fields with the provider's rules; ``raw`` keeps the item's original JSON
text. "a -> b" fallbacks test *key presence* (a present-but-empty key wins),
as dictionary lookups with defaults do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

SMAP = "map<string,string>"


def _get(m: Column, *keys: str, default: str = "") -> Column:
    """``m.get(k1, m.get(k2, ... default))`` by key presence."""
    out = F.lit(default)
    for k in reversed(keys):
        out = F.when(F.map_contains_key(m, F.lit(k)), F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))) \
            .otherwise(out)
    return out


def _join_parts(*parts: Column) -> Column:
    """``", ".join(p for p in parts if p).strip(", ")``."""
    kept = F.filter(F.array(*parts), lambda p: p != "")
    return F.regexp_replace(F.array_join(kept, ", "), r"^[, ]+|[, ]+$", "")


def _explode(df: DataFrame, items: Column) -> DataFrame:
    return df.select("query", "provider", F.posexplode(items).alias("cand_rank", "item"))


def _float(x: Column, default: float) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def parse_nominatim(df: DataFrame) -> DataFrame:
    """name = display_name before the first comma; address from
    house_number, road, suburb->neighbourhood; city->town->village;
    confidence = min(1, importance (0.5) + 0.2)."""
    d = _explode(df, F.from_json("payload", "array<string>"))
    item = F.from_json("item", SMAP)
    addr = F.from_json(F.try_element_at(item, F.lit("address")), SMAP)
    addr = F.coalesce(addr, F.create_map().cast(SMAP))
    return d.select(
        "query", "provider", "cand_rank",
        F.trim(F.substring_index(F.coalesce(F.try_element_at(item, F.lit("display_name")), F.lit("")), ",", 1))
        .alias("name"),
        _join_parts(_get(addr, "house_number"), _get(addr, "road"), _get(addr, "suburb", "neighbourhood"))
        .alias("address"),
        _get(addr, "city", "town", "village").alias("city"), _get(addr, "state").alias("state"),
        _get(addr, "country").alias("country"),
        _float(F.try_element_at(item, F.lit("lat")), 0.0).alias("latitude"),
        _float(F.try_element_at(item, F.lit("lon")), 0.0).alias("longitude"),
        F.least(F.lit(1.0), _float(F.try_element_at(item, F.lit("importance")), 0.5) + 0.2).alias("confidence"),
        F.col("item").alias("raw"))


def _geojson(df: DataFrame) -> DataFrame:
    feats = F.from_json(F.try_element_at(F.from_json("payload", SMAP), F.lit("features")), "array<string>")
    d = _explode(df, feats)
    f = F.from_json("item", SMAP)
    props = F.coalesce(F.from_json(F.try_element_at(f, F.lit("properties")), SMAP), F.create_map().cast(SMAP))
    geom = F.from_json(F.try_element_at(f, F.lit("geometry")), "struct<coordinates:array<double>>")
    coords = F.coalesce(geom["coordinates"], F.array(F.lit(0.0), F.lit(0.0)))
    return d.select("*", props.alias("props"), F.try_element_at(f, F.lit("properties")).alias("props_text"),
                    F.when(F.size(coords) > 1, F.element_at(coords, 2)).otherwise(F.lit(0.0)).alias("latitude"),
                    F.when(F.size(coords) > 0, F.element_at(coords, 1)).otherwise(F.lit(0.0)).alias("longitude"))


def parse_photon(df: DataFrame) -> DataFrame:
    """GeoJSON features ([lon, lat]); address from housenumber, street,
    district->suburb; confidence = min(1, score (0.5)); raw = properties."""
    d = _geojson(df)
    p = F.col("props")
    return d.select(
        "query", "provider", "cand_rank", _get(p, "name").alias("name"),
        _join_parts(_get(p, "housenumber"), _get(p, "street"), _get(p, "district", "suburb")).alias("address"),
        _get(p, "city", "town", "village").alias("city"), _get(p, "state").alias("state"),
        _get(p, "country").alias("country"), "latitude", "longitude",
        F.least(F.lit(1.0), _float(F.try_element_at(p, F.lit("score")), 0.5)).alias("confidence"),
        F.col("props_text").alias("raw"))


def parse_geoapify(df: DataFrame, api_key_present: bool = True) -> DataFrame:
    """address = formatted; confidence = min(1, rank.confidence (0.5));
    no API key -> no rows."""
    d = _geojson(df)
    if not api_key_present:
        d = d.limit(0)
    p = F.col("props")
    rank = F.from_json(F.try_element_at(p, F.lit("rank")), SMAP)
    return d.select(
        "query", "provider", "cand_rank", _get(p, "name").alias("name"), _get(p, "formatted").alias("address"),
        _get(p, "city", "town", "village").alias("city"), _get(p, "state").alias("state"),
        _get(p, "country").alias("country"), "latitude", "longitude",
        F.least(F.lit(1.0), _float(F.try_element_at(rank, F.lit("confidence")), 0.5)).alias("confidence"),
        F.col("props_text").alias("raw"))


def country_from_code(code: Column) -> Column:
    kv = [x for c, n in K.ISO_COUNTRY.items() for x in (F.lit(c), F.lit(n))]
    return F.coalesce(F.try_element_at(F.create_map(*kv), F.upper(code)), code)


def parse_overpass(df: DataFrame, limit: int = K.CANDIDATES_PER_PROVIDER) -> DataFrame:
    """The first ``limit`` elements; lat = lat or center.lat (0 falls
    through); addr:* tags; ISO country code -> name (unknown codes pass
    through); confidence 0.4."""
    els = F.from_json(F.try_element_at(F.from_json("payload", SMAP), F.lit("elements")), "array<string>")
    d = _explode(df, F.slice(els, 1, limit))
    e = F.from_json("item", SMAP)
    tags = F.coalesce(F.from_json(F.try_element_at(e, F.lit("tags")), SMAP), F.create_map().cast(SMAP))
    center = F.from_json(F.try_element_at(e, F.lit("center")), SMAP)

    def coord(k):
        own = F.try_element_at(e, F.lit(k)).try_cast("double")
        return F.when(F.coalesce(own, F.lit(0.0)) != 0, own).otherwise(
            _float(F.try_element_at(center, F.lit(k)), 0.0))
    return d.select(
        "query", "provider", "cand_rank", _get(tags, "name").alias("name"),
        _join_parts(_get(tags, "addr:housenumber"), _get(tags, "addr:street"),
                    _get(tags, "addr:suburb", "addr:neighbourhood")).alias("address"),
        _get(tags, "addr:city").alias("city"), _get(tags, "addr:state").alias("state"),
        country_from_code(_get(tags, "addr:country")).alias("country"),
        coord("lat").alias("latitude"), coord("lon").alias("longitude"),
        F.lit(0.4).alias("confidence"), F.col("item").alias("raw"))


PARSERS = {"nominatim": parse_nominatim, "photon": parse_photon, "geoapify": parse_geoapify,
           "overpass": parse_overpass}


def parse_payloads(df: DataFrame) -> DataFrame:
    """All providers: each payload goes through its provider's parser."""
    out = None
    for name, fn in PARSERS.items():
        part = fn(df.filter(F.col("provider") == name))
        out = part if out is None else out.unionByName(part)
    return out
