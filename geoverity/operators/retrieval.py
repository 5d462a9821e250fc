"""Retrieval by query text: cache first, then landed responses.

The sequential form asks, per centre, one query after the other until one has candidates; a query is looked up in the
cache under its normalised text and, on a miss, put to the providers in order; what is found is cached. Here the same
is one read-through join over distinct keys:

1. the queries of all centres, and per key how often it is asked (a partial aggregate);
2. keys meet live cache entries; the others meet the landed responses by the same key, parsed only there, and keep the
   first provider with results;
3. the one candidate list of each key (at most ``limit`` entries) goes back to the centres that ask it. A key that a
   large share of all queries ask (at least one in ``HOT_SHARE``; so there are at most so many such keys, which bounds
   the broadcast of their names) is spread over ``SALTS`` copies of its list;
4. the first query with candidates counts; keys found there outside the cache are written back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import written
from ..sources.providers import parse_payloads
from .cache import _as_of, _live, cache_upsert, geocode_cache_key
from .candidates import pending_centres, provider_rank
from .search_terms import generate_queries

NAMESPACE = "geocode"
HOT_SHARE = 1000
SALTS = 32
#: A cached value is a JSON list of these; a landed candidate is brought to the same form.
CANDIDATE = ("struct<name:string, address:string, city:string, state:string, country:string, latitude:double, "
             "longitude:double, confidence:double, provider:string, raw:string>")
FIELDS = ["name", "address", "city", "state", "country", "latitude", "longitude", "confidence", "provider", "raw"]


def query_requests(centres: DataFrame, force: bool = False, limit: int = K.CANDIDATES_PER_PROVIDER) -> DataFrame:
    """(pos, query_rank, query, key): the queries of the centres on the work list, in the order they would be asked."""
    work = pending_centres(centres, force)
    asked = work.select("pos", F.posexplode(generate_queries()).alias("query_rank", "query"))
    return asked.withColumn("key", geocode_cache_key("query", limit))


def cached_lists(cache: DataFrame, keys: DataFrame, as_of: dt.datetime) -> DataFrame:
    """(key, found): candidate lists of the keys with a live entry. An empty list counts as an answer; a value that is
    no list of candidates (null included) does not."""
    live = _live(cache.where(F.col("namespace") == NAMESPACE), as_of).select("key", "value")
    return live.join(keys, "key", "left_semi").select("key", F.from_json("value", f"array<{CANDIDATE}>").alias("found")) \
        .where("found IS NOT NULL")


def response_lists(responses: DataFrame, keys: DataFrame, limit: int = K.CANDIDATES_PER_PROVIDER) -> DataFrame:
    """(key, found): for each key the first ``limit`` candidates of the first provider, in the configured order, whose
    landed response has any. Of several responses of a provider under one key that of the least query text counts."""
    asked = responses.withColumn("key", geocode_cache_key("query", limit)).join(keys, "key", "left_semi")
    one = asked.groupBy("key", "provider").agg(F.min_by("payload", "query").alias("payload"))
    parsed = parse_payloads(one.select(F.col("key").alias("query"), "provider", "payload")).where(F.col("cand_rank") < limit)
    lists = parsed.groupBy(F.col("query").alias("key"), "provider").agg(
        F.array_sort(F.collect_list(F.struct("cand_rank", *FIELDS))).alias("all"))  # at most ``limit`` rows
    first = lists.groupBy("key").agg(F.min_by("all", F.struct(provider_rank("provider"), "provider")).alias("all"))
    return first.select("key", F.transform("all", lambda c: F.struct(*[c[f].alias(f) for f in FIELDS])).alias("found"))


def spread_join(requests: DataFrame, lists: DataFrame, counts: DataFrame, share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """requests LEFT JOIN lists ON key. Keys that at least one request in ``share`` asks are few, whatever the size of
    the table; their requests are dealt to ``salts`` copies of the list."""
    total = counts.agg(F.sum("asked")).first()[0] or 0
    hot = counts.where(F.col("asked") >= max(2, total // share)).select("key", F.lit(True).alias("hot")) if total >= share else \
        counts.limit(0).select("key", F.lit(True).alias("hot"))
    salted = requests.join(F.broadcast(hot), "key", "left") \
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("pos", "query_rank"), F.lit(salts))).otherwise(F.lit(0))).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = lists.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(copies)).drop("hot") \
        .withColumn("salt", F.col("salt").cast("long"))
    return salted.join(spread, ["key", "salt"], "left").drop("salt")


def retrieve(centres: DataFrame, cache: DataFrame, responses: DataFrame, as_of: dt.datetime, force: bool = False,
             limit: int = K.CANDIDATES_PER_PROVIDER) -> tuple[DataFrame, DataFrame]:
    """(answers, writes). answers: one row per centre of the work list that has queries -- pos, the rank, text and key
    of its first query with candidates (null if none has), whether the cache answered it, and the candidates. writes:
    (namespace, key, value, created_at, expires_at), the upsert of what was found outside the cache."""
    requests = written(query_requests(centres, force, limit))
    counts = written(requests.groupBy("key").agg(F.count("*").alias("asked")))
    keys = counts.select("key")
    cached = written(cached_lists(cache, keys, as_of))
    misses = keys.join(cached.select("key"), "key", "left_anti")
    lists = written(cached.withColumn("hit", F.lit(True)).unionByName(
        response_lists(responses, misses, limit).withColumn("hit", F.lit(False))).where(F.size("found") > 0))
    # the first query with candidates is chosen on slim rows; only its list is fetched
    answered = requests.join(lists.select("key", "hit"), "key", "left_semi")
    first = answered.groupBy("pos").agg(F.min(F.struct("query_rank", "query", "key")).alias("q"))
    chosen = written(requests.select("pos").distinct().join(first, "pos", "left").select("pos", "q.*"))
    asked = chosen.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("asked"))
    answers = spread_join(chosen, lists, asked)
    log = lists.where("NOT hit").join(asked, "key", "left_semi").select(
        F.lit(NAMESPACE).alias("namespace"), "key", F.to_json("found").alias("value"),
        _as_of(cache, as_of).alias("created_at"), F.lit(0).alias("seq"))
    return answers.select("pos", "query_rank", "query", "key", F.coalesce("hit", F.lit(False)).alias("hit"), "found"), cache_upsert(log)


def candidates_of(answers: DataFrame) -> DataFrame:
    """Candidate rows (C1's columns) of the answers; ``cand_pos`` from 1 in list order."""
    rows = answers.select("pos", "query_rank", "hit", F.posexplode("found").alias("at", "c"))
    return rows.select("pos", "query_rank", "hit", (F.col("at") + 1).alias("cand_pos"), *[F.col(f"c.{f}").alias(f) for f in FIELDS]) \
        .withColumn("provider_rank", provider_rank("provider"))
