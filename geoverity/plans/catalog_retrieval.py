"""Registered queries: retrieval by query text through the cache (F15 in fallback mode).

Stand-in responses: per query text and provider one landed candidate, that of the first centre that asks the text.
Stand-in cache: of the keys asked, by the length of the key, some have a live list, some an expired one, some a live
empty list.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import retrieval as T
from ..operators.cache import cache_upsert
from . import inputs
from .catalog_scalars import _gen_sql
from .catalog_sources import landed_payloads
from .geocode import geocode_by_query
from .registry import r6, register

AS_OF = dt.datetime(2024, 3, 1)


def _responses(spark, sf):
    texts = T.query_requests(inputs.centres(spark, sf), force=True).select("pos", "query_rank", F.col("query").alias("text"), "key")
    found = inputs.candidates(spark, sf).select("pos", "query_rank", "provider", "cand_pos").join(texts, ["pos", "query_rank"])
    first = found.groupBy("key", "provider").agg(F.min(F.struct("text", "pos", "cand_pos")).alias("f"))
    return landed_payloads(spark, sf).drop("query").join(
        first.select(F.col("f.text").alias("query"), "provider", "f.pos", "f.cand_pos"), ["pos", "cand_pos", "provider"]) \
        .select("query", "provider", "payload")


def _cache(spark, sf):
    keys = T.query_requests(inputs.centres(spark, sf), force=True).select("key").distinct()
    kind = F.length("key") % 7
    value = F.when(kind == 2, F.lit("[]")).otherwise(F.concat(
        F.lit('[{"name":"'), F.col("key"), F.lit('","latitude":12.5,"longitude":77.5,"confidence":0.9,"provider":"photon"}]')))
    at = F.lit(AS_OF.isoformat(" ")).cast("timestamp")
    return cache_upsert(keys.where(kind < 3).select(
        F.lit("geocode").alias("namespace"), "key", value.alias("value"),
        F.when(kind == 1, at - F.expr("INTERVAL 4000 DAYS")).otherwise(at).alias("created_at"), F.lit(0).alias("seq")))


_FOUND = _gen_sql("centres").strip() + """,
asked AS MATERIALIZED (SELECT pos, query_rank, q AS query, 'geocode:' || lower(q) || ':5' AS key FROM r WHERE query_rank < 8),
landed AS (SELECT a.key, k.provider, k.provider_rank, arg_min({'name': k.name, 'lat': k.latitude, 'lon': k.longitude},
             (a.query, k.pos, k.cand_pos)) AS c
  FROM candidates k JOIN asked a ON a.pos = k.pos AND a.query_rank = k.query_rank GROUP BY a.key, k.provider, k.provider_rank),
fetched AS (SELECT key, arg_min(provider, provider_rank) AS provider, arg_min(c, provider_rank) AS c FROM landed GROUP BY key),
keys AS (SELECT DISTINCT key, length(key) % 7 AS kind FROM asked),
lists AS (SELECT key, true AS hit, 'photon' AS provider, key AS name, CAST(12.5 AS DOUBLE) AS lat, CAST(77.5 AS DOUBLE) AS lon
  FROM keys WHERE kind = 0
  UNION ALL SELECT f.key, false, f.provider, c.name, c.lat, c.lon FROM fetched f JOIN keys USING (key) WHERE kind NOT IN (0, 2)),
chosen AS (SELECT pos, arg_min({'rank': query_rank, 'query': query, 'key': key}, query_rank) AS q
  FROM asked WHERE key IN (SELECT key FROM lists) GROUP BY pos)"""


@register("retrieve_candidates", f"WITH {_FOUND}" + """
SELECT p.pos, CAST(q.rank AS INTEGER) AS query_rank, q.query AS query, coalesce(hit, false) AS hit, provider, name,
  round(lat, 6) AS latitude, round(lon, 6) AS longitude
FROM (SELECT DISTINCT pos FROM asked) p LEFT JOIN chosen c ON c.pos = p.pos LEFT JOIN lists l ON l.key = c.q.key""",
          ("centres", "candidates"))
def q_retrieve(spark, sf):
    answers, _ = T.retrieve(inputs.centres(spark, sf), _cache(spark, sf), _responses(spark, sf), AS_OF, force=True)
    first = F.try_element_at("found", F.lit(1))
    return r6(answers.select("pos", "query_rank", "query", "hit", first["provider"].alias("provider"), first["name"].alias("name"),
                             first["latitude"].alias("latitude"), first["longitude"].alias("longitude")))


@register("cache_write_back", f"WITH {_FOUND}" + """
SELECT 'geocode' AS namespace, key, name, CAST(TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 1 DAY AS VARCHAR) AS expires_at
FROM lists WHERE NOT hit AND key IN (SELECT q.key FROM chosen)""", ("centres", "candidates"))
def q_write_back(spark, sf):
    _, writes = T.retrieve(inputs.centres(spark, sf), _cache(spark, sf), _responses(spark, sf), AS_OF, force=True)
    return writes.select("namespace", "key", F.get_json_object("value", "$[0].name").alias("name"),
                         F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@register("geocode_by_query")
def q_geocode_by_query(spark, sf):
    """outcome per centre, its candidates found through the cache and the landed responses."""
    return r6(geocode_by_query(inputs.centres(spark, sf), _cache(spark, sf), _responses(spark, sf), AS_OF, force=True)[0])
