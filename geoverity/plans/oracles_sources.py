"""DuckDB oracles of the source, normalisation and payload queries.

Each statement derives the expected rows straight from the stand-in views: which
key of a raw document feeds which field, when a value is falsy, and how an id is
hashed, written out by document layout (``pos % 3``).
"""

from __future__ import annotations

from .registry import ORACLE
from ..sources.fixtures import with_views


def _pair(key: str, value: str, text: bool = True) -> str:
    """JSON member, absent when NULL (as the writer does)."""
    shown = f"""'"' || {value} || '"'""" if text else f"CAST({value} AS VARCHAR)"
    return f"""CASE WHEN {value} IS NULL THEN NULL ELSE '"{key}":' || {shown} END"""


def _object(*members: str) -> str:
    return f"""'{{' || concat_ws(',', {', '.join(members)}) || '}}'"""


LAT_V = "CASE WHEN pos % 10 = 3 THEN CAST(0 AS DOUBLE) ELSE latitude END"
_VENDOR = _object(
    _pair("TestCenterCode", "id"), _pair("TestCenterName", "name"), _pair("Address1", "address"), _pair("City", "city"),
    _pair("State", "state"), _pair("Country", "country"), _pair("ZipCode", "postal_code"),
    _pair("Latitude", f"({LAT_V})", False), _pair("Longitude", "CAST(longitude AS VARCHAR)"))
_GENERIC = _object(
    _pair("School Name", "('  ' || name || '   ')"), _pair("town", "city"), _pair("province", "state"),
    _pair("nation", "country"), _pair("lat", "latitude", False), _pair("lng", "longitude", False))
_TABLE = _object(_pair("code", "id"), _pair("name", "name"), _pair("city", "city"), _pair("country", "country"),
                 _pair("zip", "postal_code"))
RECORD = f"CASE pos % 3 WHEN 0 THEN {_VENDOR} WHEN 1 THEN {_GENERIC} ELSE {_TABLE} END"

_PARTS = """CASE pos % 3
  WHEN 0 THEN concat_ws('|', nullif(lower(trim(city)), ''), nullif(lower(trim(state)), ''), nullif(lower(trim(country)), ''))
  WHEN 1 THEN '' ELSE concat_ws('|', nullif(lower(trim(name)), ''), nullif(lower(trim(city)), ''), nullif(lower(trim(country)), '')) END"""
GEN_ID = f"substr(sha256(CASE WHEN ({_PARTS}) <> '' THEN ({_PARTS}) ELSE ({RECORD}) END), 1, 16)"
CENTRE_ID = f"CASE WHEN pos % 3 <> 1 AND id <> '' THEN id ELSE {GEN_ID} END"

_NOTE = r"""'"note":"line one\nsays \"hi\", ' || CAST(pos AS VARCHAR) || '"'"""

_SOURCE = {
    "scan_json_records": f"SELECT pos AS doc_id, CAST(0 AS BIGINT) AS rec_pos, {RECORD} AS record FROM centres",
    "scan_json_files": f"""
WITH numbered AS (SELECT *, pos % 4 AS file_no, row_number() OVER (PARTITION BY pos % 4 ORDER BY pos) AS place FROM centres)
SELECT file_no, CASE WHEN file_no = 1 THEN place ELSE place - 1 END AS rec_pos,
 {_object(_pair('id', 'id'), _pair('name', 'name'), _pair('city', 'city'))} AS record FROM numbered
UNION ALL SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), '{{"name":"first"}}'""",
    "scan_csv_files": f"""
SELECT pos % 4 AS file_no, row_number() OVER (PARTITION BY pos % 4 ORDER BY pos) - 1 AS rec_pos,
 {_object(_pair('name', 'name'), _pair('city', 'city'), _NOTE)} AS record FROM centres""",
    "scan_csv_records": f"""SELECT pos AS doc_id, CAST(0 AS BIGINT) AS rec_pos,
 {_object(_pair('name', 'name'), _pair('city', 'city'), _pair('country', 'country'))} AS record FROM centres""",
    "normalize_records": f"""
SELECT pos AS doc_id, CAST(0 AS BIGINT) AS rec_pos, {CENTRE_ID} AS id, name,
 CASE WHEN pos % 3 = 0 THEN address ELSE '' END AS address, city, CASE WHEN pos % 3 = 2 THEN '' ELSE state END AS state,
 country, CASE WHEN pos % 3 = 1 THEN '' ELSE postal_code END AS postal_code, '' AS phone,
 round(CASE pos % 3 WHEN 0 THEN nullif({LAT_V}, 0) WHEN 1 THEN nullif(latitude, 0) END, 6) AS latitude,
 round(CASE pos % 3 WHEN 0 THEN longitude WHEN 1 THEN nullif(longitude, 0) END, 6) AS longitude FROM centres""",
    "name_fallback": "SELECT pos AS doc_id, CAST(0 AS BIGINT) AS rec_pos, trim(name) AS fallback_name FROM centres",
    "generate_id": f"SELECT pos AS doc_id, CAST(0 AS BIGINT) AS rec_pos, {GEN_ID} AS gen_id FROM centres",
    "map_fields": f"""
SELECT pos AS doc_id, CAST(0 AS BIGINT) AS rec_pos, CASE WHEN pos % 3 <> 1 THEN nullif(id, '') END AS id,
 CASE WHEN pos % 3 <> 1 THEN nullif(name, '') END AS name, CASE WHEN pos % 3 = 0 THEN nullif(address, '') END AS address,
 nullif(city, '') AS city, CASE WHEN pos % 3 <> 2 THEN nullif(state, '') END AS state, nullif(country, '') AS country,
 CASE WHEN pos % 3 <> 1 THEN nullif(postal_code, '') END AS postal_code, CAST(NULL AS VARCHAR) AS phone,
 CASE pos % 3 WHEN 0 THEN CAST(nullif({LAT_V}, 0) AS VARCHAR) WHEN 1 THEN CAST(nullif(latitude, 0) AS VARCHAR) END AS latitude,
 CASE pos % 3 WHEN 0 THEN CAST(longitude AS VARCHAR) WHEN 1 THEN CAST(nullif(longitude, 0) AS VARCHAR) END AS longitude
FROM centres""",
    "load_dataset_envelope": f"""SELECT pos AS doc_id, CAST(0 AS BIGINT) AS rec_pos,
 {_object(_pair('id', 'id'), _pair('name', 'name'), _pair('city', 'city'), _pair('latitude', 'latitude', False),
          _pair('longitude', 'longitude', False))} AS record FROM centres""",
    "load_centres": """SELECT pos AS doc_id, CAST(0 AS INTEGER) AS rec_pos, id, name, '' AS address, city, '' AS state, country,
 '' AS postal_code, '' AS phone, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM centres""",
}

_QUERY = "'q' || CAST(pos AS VARCHAR) || '_' || CAST(query_rank AS VARCHAR) AS query, provider, CAST(0 AS INTEGER) AS cand_rank"
_PLACE = "round(latitude, 6) AS latitude, round(longitude, 6) AS longitude"
_PAYLOAD = {
    "parse_nominatim": f"""SELECT {_QUERY}, name, '12, Main Road' AS address, city, '' AS state, country, {_PLACE},
 round(least(1.0, CAST(confidence AS DOUBLE) / 2 + 0.2), 6) AS confidence FROM candidates WHERE provider = 'nominatim'""",
    "parse_photon": f"""SELECT {_QUERY}, name, 'Main Road' AS address, city, '' AS state, country, {_PLACE},
 round(least(1.0, CAST(confidence AS DOUBLE)), 6) AS confidence FROM candidates WHERE provider = 'photon'""",
    "parse_geoapify": f"""SELECT {_QUERY}, name, name || ', ' || city AS address, city, '' AS state, country, {_PLACE},
 round(least(1.0, CAST(confidence AS DOUBLE) * 2), 6) AS confidence FROM candidates WHERE provider = 'geoapify'""",
    "parse_overpass": f"""SELECT {_QUERY}, name, '' AS address, city, '' AS state,
 CASE WHEN country = 'India' THEN 'India' ELSE 'XX' END AS country, {_PLACE}, CAST(0.4 AS DOUBLE) AS confidence
FROM candidates WHERE provider = 'overpass'""",
}

_REQUEST = r"""
WITH p AS (SELECT page_id, page_id % 4 AS k, url,
  list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: contains(x, '=')) AS parts FROM pages)
SELECT page_id, CASE WHEN k = 1 THEN 'POST' ELSE 'GET' END AS method, url,
 CAST(CASE WHEN k = 2 THEN 0 ELSE 1 END AS INTEGER) AS n_headers,
 CASE k WHEN 0 THEN 'text/html' WHEN 3 THEN '*/*' END AS accept, CASE WHEN k = 1 THEN 'application/json' END AS content_type,
 CAST(CASE WHEN k = 2 THEN 2 ELSE 0 END AS INTEGER) AS n_cookies,
 CASE WHEN k = 1 THEN '{"page": ' || CAST(page_id AS VARCHAR) || '}' END AS data,
 CASE WHEN k = 1 THEN '{"page": ' || CAST(page_id AS VARCHAR) || '}' END AS json_data,
 CASE WHEN k = 2 THEN 'user' END AS user, k = 0 AS compressed, k = 2 AS insecure,
 CASE WHEN contains(url, '?') THEN CAST(len(list_distinct(list_transform(parts, lambda x: split_part(x, '=', 1)))) AS INTEGER) END AS n_params,
 CAST(NULL AS VARCHAR) AS error FROM p"""

for _key, _sql in _SOURCE.items():
    ORACLE[_key] = with_views(_sql, "centres")
for _key, _sql in _PAYLOAD.items():
    ORACLE[_key] = with_views(_sql, "candidates")
ORACLE["parse_request_log"] = _REQUEST
