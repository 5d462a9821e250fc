"""Registered queries: string/number scalars, search strings, cache table,
landed files, gazetteer search, map layer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from ..operators import cache as CA
from ..operators import landed as LD
from ..operators.gazetteer import gazetteer_search
from ..operators.search_terms import generate_queries, generate_queries_batch
from ..sources.tables import read_table
from . import inputs
from .registry import r6, register

CACHE_AS_OF = dt.datetime(2024, 1, 10, 0, 0, 0)
_AS_OF_SQL = "TIMESTAMP '2024-01-10 00:00:00'"

# Python str.isspace() set, written out for RE2 (DuckDB)
_WS_RE2 = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# N5 ----------------------------------------------------------------------------
@register("clean_string", f"""
SELECT doc_id, replace(regexp_replace(regexp_replace(text, '{_WS_RE2}+', ' ', 'g'),
                       '^{_WS_RE2}+|{_WS_RE2}+$', '', 'g'), chr(0), '') AS cleaned FROM documents""")
def q_clean(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", TX.clean_string("text").alias("cleaned"))


# N6 ----------------------------------------------------------------------------
_SEG = "split_part(url, '/', -1)"


@register("parse_float", f"""
SELECT page_id, {_SEG} AS segment,
  CASE WHEN regexp_full_match(trim({_SEG}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
       THEN TRY_CAST(trim({_SEG}) AS DOUBLE) END AS value FROM pages""")
def q_parse_float(spark, sf):
    p = read_table(spark, sf, "pages")
    seg = F.element_at(F.split("url", "/"), -1)
    return r6(p.select("page_id", seg.alias("segment"), TX.parse_float(seg).alias("value")))


# N7 / N8 -------------------------------------------------------------------------
_CANON = "CASE lower(trim(country)) " + " ".join(
    f"WHEN '{v}' THEN '{c}'" for c, vs in K.COUNTRY_ALIASES.items() for v in dict.fromkeys(vs + [c.lower()])
) + " ELSE upper(trim(country)) END"
_VARIANTS = ", ".join(f"('{v}', '{c}')" for c, vs in K.COUNTRY_ALIASES.items()
                      for v in dict.fromkeys(vs + [c.lower()]))


@register("normalize_country", f"""
SELECT pos, country, CASE WHEN country = '' THEN '' ELSE {_CANON} END AS canonical FROM centres""",
          ("centres",))
def q_norm_country(spark, sf):
    c = inputs.centres(spark, sf)
    return c.select("pos", "country", TX.normalize_country("country").alias("canonical"))


@register("country_variants", f"""
WITH v(variant, canonical) AS (VALUES {_VARIANTS})
SELECT v.variant, v.canonical, count(c.pos) AS centres FROM v
LEFT JOIN centres c ON lower(trim(c.country)) = v.variant GROUP BY v.variant, v.canonical""", ("centres",))
def q_country_variants(spark, sf):
    """The alias relation, with how many centres use each variant."""
    rows = [(v, c) for c, vs in K.COUNTRY_ALIASES.items() for v in dict.fromkeys(vs + [c.lower()])]
    v = spark.createDataFrame(rows, "variant string, canonical string")
    c = inputs.centres(spark, sf).select("pos", F.lower(F.trim("country")).alias("variant"))
    counts = c.groupBy("variant").agg(F.count("pos").alias("centres"))
    return (v.join(counts, "variant", "left")
             .select("variant", "canonical", F.coalesce("centres", F.lit(0)).alias("centres")))


# N9-N11 --------------------------------------------------------------------------
_NOISE = ", ".join(f"'{w}'" for w in K.NOISE_WORDS)


@register("noise_word_strip", f"""
SELECT pos, array_to_string(list_filter(string_split_regex(trim(name), '\\s+'),
         lambda w: w <> '' AND lower(w) NOT IN ({_NOISE})), ' ') AS cleaned_name FROM centres""", ("centres",))
def q_noise(spark, sf):
    return inputs.centres(spark, sf).select("pos", TX.strip_noise_words("name").alias("cleaned_name"))


def _gen_sql(src: str) -> str:
    return f"""
t AS (SELECT pos, id, trim(name) n, trim(city) c, trim(state) s, trim(country) k, trim(address) a,
             array_to_string(list_filter(string_split_regex(trim(name), '\\s+'),
                 lambda w: w <> '' AND lower(w) NOT IN ({_NOISE})), ' ') AS cl FROM {src}),
u AS (
  SELECT pos, id, 1 AS k, trim(n || ' ' || c || ' ' || k) AS q FROM t WHERE n <> '' AND c <> '' AND k <> ''
  UNION ALL SELECT pos, id, 2, trim(n || ' ' || c || ' ' || s) FROM t WHERE n <> '' AND c <> '' AND s <> ''
  UNION ALL SELECT pos, id, 3, trim(n || ' ' || c) FROM t WHERE n <> '' AND c <> ''
  UNION ALL SELECT pos, id, 4, trim(n || ' ' || k) FROM t WHERE n <> '' AND k <> ''
  UNION ALL SELECT pos, id, 5, n FROM t WHERE n <> ''
  UNION ALL SELECT pos, id, 6, trim(cl || ' ' || c || ' ' || k) FROM t WHERE cl <> n AND cl <> '' AND c <> '' AND k <> ''
  UNION ALL SELECT pos, id, 7, trim(a || ' ' || c || ' ' || k) FROM t WHERE a <> '' AND c <> '' AND k <> ''
  UNION ALL SELECT pos, id, 8, trim(n || ' ' || s || ' ' || k) FROM t WHERE n <> '' AND s <> '' AND k <> ''),
d AS (SELECT pos, id, q, min(k) AS k FROM u WHERE q <> '' GROUP BY pos, id, q),
r AS (SELECT pos, id, q, row_number() OVER (PARTITION BY pos ORDER BY k) - 1 AS query_rank FROM d)"""


@register("generate_queries", "WITH " + _gen_sql("centres") + """
SELECT pos, query_rank, q AS query FROM r WHERE query_rank < 8""", ("centres",))
def q_gen(spark, sf):
    c = inputs.centres(spark, sf).withColumn("queries", generate_queries())
    return c.select("pos", F.posexplode("queries").alias("query_rank", "query")).select(
        "pos", F.col("query_rank").cast("long").alias("query_rank"), "query")


@register("generate_queries_batch", "WITH " + _gen_sql("centres") + """,
last AS (SELECT id, max(pos) AS pos FROM centres GROUP BY id)
SELECT r.id, r.query_rank, r.q AS query FROM r JOIN last ON last.pos = r.pos WHERE r.query_rank < 8""",
          ("centres",))
def q_gen_batch(spark, sf):
    b = generate_queries_batch(inputs.centres(spark, sf))
    return b.select("id", F.posexplode("queries").alias("query_rank", "query")).select(
        "id", F.col("query_rank").cast("long").alias("query_rank"), "query")


# N13 ---------------------------------------------------------------------------
def _fmt_bytes_sql(x: str) -> str:
    return (f"CASE WHEN {x} < 1024 THEN printf('%.1f B', {x}) "
            f"WHEN {x} / 1024.0 < 1024 THEN printf('%.1f KB', {x} / 1024.0) "
            f"WHEN {x} / 1048576.0 < 1024 THEN printf('%.1f MB', {x} / 1048576.0) "
            f"WHEN {x} / 1073741824.0 < 1024 THEN printf('%.1f GB', {x} / 1073741824.0) "
            f"ELSE printf('%.1f TB', {x} / 1099511627776.0) END")


@register("format_bytes", f"""
SELECT page_id, {_fmt_bytes_sql('CAST(length(html) * 37 AS DOUBLE)')} AS size_text FROM pages""")
def q_fmt_bytes(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", TX.format_bytes(F.length("html") * 37).alias("size_text"))


@register("format_duration", """
SELECT event_id, CASE WHEN value < 60 THEN printf('%.1fs', value)
  ELSE printf('%dm %.1fs', CAST(floor(value / 60) AS BIGINT), value - floor(value / 60) * 60) END AS duration
FROM events""")
def q_fmt_duration(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", TX.format_duration("value").alias("duration"))


# N14 ---------------------------------------------------------------------------
@register("safe_get", """
SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'missing') AS k FROM events""")
def q_safe_get(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("missing")).alias("k"))


# N15 ---------------------------------------------------------------------------
@register("url_query_params", """
WITH q AS (SELECT page_id, regexp_extract(url, '^[^?]*\\?([^#]*)', 1) AS qs FROM pages WHERE strpos(url, '?') > 0),
p AS (SELECT page_id, unnest(string_split(qs, '&')) AS part, generate_subscripts(string_split(qs, '&'), 1) AS i FROM q),
kv AS (SELECT page_id, i,
         url_decode(replace(split_part(part, '=', 1), '+', '%2B')) AS key,
         url_decode(replace(substr(part, strpos(part, '=') + 1), '+', '%2B')) AS value
       FROM p WHERE strpos(part, '=') > 0),
l AS (SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY i DESC) AS rn FROM kv)
SELECT page_id, key, value FROM l WHERE rn = 1""")
def q_url_params(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", TX.url_query_params("url").alias("m"))
    return p.select("page_id", F.explode("m").alias("key", "value"))


# X3 ----------------------------------------------------------------------------
_MAP_URLS = """
SELECT 'p' || CAST(page_id AS STRING) AS uid, url FROM pages
UNION ALL SELECT 'c' || CAST(pos AS STRING), CASE WHEN pos % 3 = 0
   THEN 'https://maps.example.com/place?q=' || CAST(latitude AS STRING) || ',' || CAST(longitude AS STRING)
   WHEN pos % 3 = 1 THEN 'https://maps.example.com/?lat=' || CAST(round(latitude, 4) AS STRING) || '&lon=' || CAST(round(longitude, 4) AS STRING) || '&z=3'
   ELSE 'http://x.example.com/?q=' || CAST(round(latitude, 4) AS STRING) || '%2C' || CAST(round(longitude, 4) AS STRING) END
FROM centres WHERE latitude IS NOT NULL"""


@register("detect_url_template", """
WITH u AS (""" + _MAP_URLS + """),
p1 AS (SELECT uid, url, regexp_extract(url, '-?\\d+\\.\\d{2,8}[,%]2?C?-?\\d+\\.\\d{2,8}', 0) AS whole,
              regexp_extract(url, '^(.*?)(-?\\d+\\.\\d{2,8})([,%]2?C?)(-?\\d+\\.\\d{2,8})(.*)$', 1) AS pre,
              regexp_extract(url, '^(.*?)(-?\\d+\\.\\d{2,8})([,%]2?C?)(-?\\d+\\.\\d{2,8})(.*)$', 2) AS la,
              regexp_extract(url, '^(.*?)(-?\\d+\\.\\d{2,8})([,%]2?C?)(-?\\d+\\.\\d{2,8})(.*)$', 4) AS lo,
              regexp_extract(url, '^(.*?)(-?\\d+\\.\\d{2,8})([,%]2?C?)(-?\\d+\\.\\d{2,8})(.*)$', 5) AS post FROM u),
p2 AS (SELECT *, regexp_extract(substr(whole, length(la) + 1), '[,%]2?C?', 0) AS sep,
              regexp_extract(url, '^(.*?[?&])((?i)lat|latitude)=(-?\\d+\\.\\d{2,8})(.*)$', 3) AS lat_v,
              regexp_extract(url, '^(.*?[?&])((?i)lng|lon|longitude)=(-?\\d+\\.\\d{2,8})(.*)$', 3) AS lng_v,
              regexp_extract(url, '^(.*?[?&])((?i)lat|latitude)=(-?\\d+\\.\\d{2,8})(.*)$', 1)
                || regexp_extract(url, '^(.*?[?&])((?i)lat|latitude)=(-?\\d+\\.\\d{2,8})(.*)$', 2) || '={lat}'
                || regexp_extract(url, '^(.*?[?&])((?i)lat|latitude)=(-?\\d+\\.\\d{2,8})(.*)$', 4) AS s1 FROM p1)
SELECT uid, CASE WHEN NOT (starts_with(url, 'http://') OR starts_with(url, 'https://')) THEN NULL
  WHEN whole <> '' AND CAST(la AS DOUBLE) BETWEEN -90 AND 90 AND CAST(lo AS DOUBLE) BETWEEN -180 AND 180
    THEN pre || '{lat}' || sep || '{lng}' || post
  WHEN lat_v <> '' AND lng_v <> '' AND CAST(lat_v AS DOUBLE) BETWEEN -90 AND 90 AND CAST(lng_v AS DOUBLE) BETWEEN -180 AND 180
    THEN regexp_extract(s1, '^(.*?[?&])((?i)lng|lon|longitude)=(-?\\d+\\.\\d{2,8})(.*)$', 1)
      || regexp_extract(s1, '^(.*?[?&])((?i)lng|lon|longitude)=(-?\\d+\\.\\d{2,8})(.*)$', 2) || '={lng}'
      || regexp_extract(s1, '^(.*?[?&])((?i)lng|lon|longitude)=(-?\\d+\\.\\d{2,8})(.*)$', 4)
  END AS template FROM p2""", ("centres",))
def q_url_template(spark, sf):
    u = spark.sql(_MAP_URLS.replace("FROM pages", "FROM {pages}").replace("FROM centres", "FROM {centres}"),
                  pages=read_table(spark, sf, "pages"), centres=inputs.centres(spark, sf))
    return u.select("uid", TX.detect_url_template("url").alias("template"))


# S3 / S4 / S6 --------------------------------------------------------------------
@register("detect_payload_format", """
SELECT file_id, CASE WHEN json_valid(payload) THEN 'json' ELSE 'csv' END AS format FROM landed_files""",
          ("landed_files",))
def q_payload_format(spark, sf):
    f = inputs.landed_files(spark, sf)
    return f.select("file_id", LD.detect_payload_format(F.encode("payload", "UTF-8")).alias("format"))


@register("classify_landed_file", """
SELECT file_id, CASE
  WHEN (trim(substr(payload, 1, 4096)) LIKE '{%' OR trim(substr(payload, 1, 4096)) LIKE '[%') AND json_valid(payload) THEN 'json'
  WHEN contains(lower(substr(payload, 1, 4096)), '<html') OR contains(lower(substr(payload, 1, 4096)), '<!doctype') THEN 'html'
  WHEN len(string_split(substr(payload, 1, 4096), chr(10))) > 1
       AND contains(string_split(substr(payload, 1, 4096), chr(10))[1], ',') THEN 'csv'
  ELSE 'unknown' END AS format FROM landed_files""", ("landed_files",))
def q_classify(spark, sf):
    f = inputs.landed_files(spark, sf)
    return f.select("file_id", LD.classify_landed_file(F.encode("payload", "UTF-8")).alias("format"))


def _archives(spark, sf):
    """Landed pages as they are, gzipped, or in a zip archive with a second member, by their number."""
    import gzip
    import io
    import zipfile

    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                if i % 3 == 1:
                    raw = gzip.compress(raw, mtime=0)
                elif i % 3 == 2:
                    held = io.BytesIO()
                    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("page.html", raw)
                        z.writestr("more/url.txt", str(i))
                    raw = held.getvalue()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["file_id", "payload"])

    files = inputs.landed_files(spark, sf).select("file_id", "payload").mapInArrow(pack, "file_id bigint, payload binary")
    return files.withColumn("format", LD.classify_landed_file("payload"))


@register("inflate_payloads", """
SELECT file_id, CAST(0 AS INTEGER) AS member, CASE WHEN file_id % 3 = 2 THEN 'page.html' END AS name,
 CAST(strlen(coalesce(payload, '')) AS BIGINT) AS n_bytes, sha256(coalesce(payload, '')) AS sha256 FROM landed_files
UNION ALL SELECT file_id, 1, 'more/url.txt', CAST(length(CAST(file_id AS VARCHAR)) AS BIGINT), sha256(CAST(file_id AS VARCHAR))
FROM landed_files WHERE file_id % 3 = 2""", ("landed_files",))
def q_s5(spark, sf):
    """All members of packed pages, inflated in parts of 1,000 bytes and put together by their hash."""
    parts = LD.inflated(_archives(spark, sf), size=1000)
    whole = F.array_sort(F.collect_list(F.struct("part", F.hex("data").alias("hex"))))
    return parts.groupBy("file_id", "member", "name").agg(
        F.sum(F.length("data")).alias("n_bytes"), F.sha2(F.unhex(F.array_join(whole["hex"], "")), 256).alias("sha256"))


@register("decompress_payloads", """
SELECT file_id, sha256(coalesce(payload, '')) AS sha256 FROM landed_files""", ("landed_files",))
def q_s5_first(spark, sf):
    return LD.decompress_payloads(_archives(spark, sf)).select("file_id", F.sha2("payload", 256).alias("sha256"))


@register("latest_landed_file", """
SELECT file_id, path, n FROM landed_files ORDER BY file_id DESC LIMIT 1""", ("landed_files",))
def q_latest(spark, sf):
    return LD.latest_landed_file(inputs.landed_files(spark, sf), order="file_id")


@register("list_landed_files", """
SELECT file_id, path, n FROM landed_files""", ("landed_files",))
def q_list_files(spark, sf):
    return LD.list_landed_files(inputs.landed_files(spark, sf), order="file_id")


# S13 ---------------------------------------------------------------------------
@register("gazetteer_search", """
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(p_name) AS phrase
           FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT p_partkey AS gid, p_name AS name FROM part),
ph AS (SELECT DISTINCT phrase FROM q),
hits AS (SELECT ph.phrase, g.gid, g.name, row_number() OVER (PARTITION BY ph.phrase ORDER BY g.gid) AS rank
         FROM ph JOIN g ON contains(lower(g.name), ph.phrase))
SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, hits.rank, hits.gid, hits.name
FROM q JOIN hits ON hits.phrase = q.phrase WHERE hits.rank <= 5""")
def q_gazetteer(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = read_table(spark, sf, "part")
    queries = (li.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
                 .select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("qid"),
                         F.col("p_name").alias("query")))
    gaz = part.select(F.col("p_partkey").alias("gid"), F.col("p_name").alias("name"))
    res = gazetteer_search(queries, gaz, k=5)
    return res.select("qid.*", F.col("rank").cast("long").alias("rank"), "gid", "name")


# C5-C9 ---------------------------------------------------------------------------
_TTL_SQL = " ".join(f"WHEN '{n}' THEN {t}" for n, t in K.CACHE_TTL.items())
_CACHE_TABLE = f"""
cache AS (SELECT namespace, key, value, created_at,
                 created_at + to_seconds(CASE namespace {_TTL_SQL} ELSE {K.CACHE_TTL_DEFAULT} END) AS expires_at
          FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY created_at DESC, seq DESC) AS rn
                FROM cache_log) x WHERE rn = 1)"""
_REQ = """
req AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'geocode' WHEN 'AUTOMOBILE' THEN 'http'
                 WHEN 'MACHINERY' THEN 'download' WHEN 'HOUSEHOLD' THEN 'manual' ELSE 'other' END AS namespace,
               CAST(c_custkey AS VARCHAR) AS key FROM customer)"""


def _table(spark, sf):
    return CA.cache_upsert(inputs.cache_log(spark, sf))


def _requests(spark, sf):
    c = read_table(spark, sf, "customer")
    ns = (F.when(F.col("c_mktsegment") == "BUILDING", "geocode")
           .when(F.col("c_mktsegment") == "AUTOMOBILE", "http")
           .when(F.col("c_mktsegment") == "MACHINERY", "download")
           .when(F.col("c_mktsegment") == "HOUSEHOLD", "manual").otherwise("other"))
    return c.select(ns.alias("namespace"), F.col("c_custkey").cast("string").alias("key"))


@register("cache_upsert", "WITH " + _CACHE_TABLE + """
SELECT namespace, key, value, created_at, expires_at FROM cache""", ("cache_log",))
def q_cache_upsert(spark, sf):
    return _table(spark, sf)


@register("cache_lookup", "WITH " + _CACHE_TABLE + "," + _REQ + f"""
SELECT r.namespace, r.key, (c.key IS NOT NULL) AS hit, c.value FROM req r
LEFT JOIN (SELECT * FROM cache WHERE expires_at >= {_AS_OF_SQL}) c ON c.namespace = r.namespace AND c.key = r.key""",
          ("cache_log",))
def q_cache_lookup(spark, sf):
    return CA.cache_lookup(_table(spark, sf), _requests(spark, sf), CACHE_AS_OF)


@register("cache_has", "WITH " + _CACHE_TABLE + "," + _REQ + f"""
SELECT r.namespace, r.key FROM req r WHERE EXISTS (SELECT 1 FROM cache c WHERE c.namespace = r.namespace
  AND c.key = r.key AND c.expires_at >= {_AS_OF_SQL} AND c.value IS NOT NULL AND trim(c.value) <> 'null')""",
          ("cache_log",))
def q_cache_has(spark, sf):
    return CA.cache_has(_table(spark, sf), _requests(spark, sf), CACHE_AS_OF)


@register("cache_cleanup_expired", "WITH " + _CACHE_TABLE + f"""
SELECT CAST(count(*) FILTER (WHERE expires_at < {_AS_OF_SQL}) AS BIGINT) AS removed FROM cache""",
          ("cache_log",))
def q_cache_cleanup(spark, sf):
    return CA.cache_cleanup_expired(_table(spark, sf), CACHE_AS_OF)[1]


@register("cache_stats", "WITH " + _CACHE_TABLE + """
SELECT namespace, count(*) AS entries FROM cache GROUP BY namespace""", ("cache_log",))
def q_cache_stats(spark, sf):
    return CA.cache_stats(_table(spark, sf))


@register("cache_delete", "WITH " + _CACHE_TABLE + "," + _REQ + """
SELECT c.namespace, c.key FROM cache c WHERE NOT EXISTS
  (SELECT 1 FROM req r WHERE r.namespace = c.namespace AND r.key = c.key)""", ("cache_log",))
def q_cache_delete(spark, sf):
    return CA.cache_delete(_table(spark, sf), _requests(spark, sf)).select("namespace", "key")


@register("cache_clear_namespace", "WITH " + _CACHE_TABLE + """
SELECT CAST(count(*) FILTER (WHERE namespace = 'http') AS BIGINT) AS removed FROM cache""", ("cache_log",))
def q_cache_clear_ns(spark, sf):
    return CA.cache_clear_namespace(_table(spark, sf), "http")[1]


@register("cache_clear_all", "WITH " + _CACHE_TABLE + """
SELECT count(*) AS removed FROM cache""", ("cache_log",))
def q_cache_clear_all(spark, sf):
    return CA.cache_clear_all(_table(spark, sf))


# K8 ----------------------------------------------------------------------------
@register("map_layer", """
SELECT pos, id, name,
  coalesce(address, '') || CASE WHEN city <> '' THEN ', ' || city ELSE '' END
    || CASE WHEN state <> '' THEN ', ' || state ELSE '' END
    || CASE WHEN country <> '' THEN ' · ' || country ELSE '' END AS popup_detail,
  printf('%.5f, %.5f', latitude, longitude) AS popup_coord
FROM centres WHERE latitude IS NOT NULL AND longitude IS NOT NULL""", ("centres",))
def q_map_layer(spark, sf):
    from ..operators.reports import map_layer
    return map_layer(inputs.centres(spark, sf))


@register("map_bounds", """
SELECT count(*) AS markers, round(min(latitude), 6) AS min_lat, round(max(latitude), 6) AS max_lat,
       round(min(longitude), 6) AS min_lon, round(max(longitude), 6) AS max_lon
FROM centres WHERE latitude IS NOT NULL AND longitude IS NOT NULL""", ("centres",))
def q_map_bounds(spark, sf):
    from ..operators.reports import map_bounds
    return r6(map_bounds(inputs.centres(spark, sf)))
