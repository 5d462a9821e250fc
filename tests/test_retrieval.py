"""Retrieval through the cache against the sequential loop: one query after the other, cache, then providers."""

import datetime as dt
import json
import random

import pytest

from geoverity import constants as K
from geoverity.operators import retrieval as R
from geoverity.operators.cache import cache_upsert
from geoverity.plans.geocode import geocode_by_query

NOW = dt.datetime(2024, 3, 1, 12)
CENTRES = "pos long, id string, name string, address string, city string, state string, country string, postal_code string, latitude double, longitude double"


def payload(provider, names):
    if provider == "nominatim":
        return json.dumps([{"display_name": n, "lat": "12.9", "lon": "77.5", "importance": 0.5} for n in names])
    if provider == "overpass":
        return json.dumps({"elements": [{"lat": 12.9, "lon": 77.5, "tags": {"name": n}} for n in names]})
    return json.dumps({"features": [{"geometry": {"coordinates": [77.5, 12.9]}, "properties": {"name": n}} for n in names]})


def made(seed, n):
    rng = random.Random(seed)
    centres = [(i, f"i{i}", rng.choice(["Green", "GREEN", "Oak", ""]), rng.choice(["", "1 Road"]), rng.choice(["Pune", "Agra"]),
                rng.choice(["", "MH"]), rng.choice(["India", ""]), "", None if rng.random() < .8 else 1.0, None) for i in range(n)]
    texts = sorted({" ".join(filter(None, p)) for nm in ("Green", "Oak") for c in ("", "Pune", "Agra") for s in ("", "MH", "India")
                    for p in [(nm, c, s)]} | {"1 Road Pune India"})
    responses, entries = [], []
    for t in texts:
        for p in K.PROVIDER_ORDER:
            if rng.random() < .3:
                responses.append((t, p, payload(p, [f"{p} {t} {j}" for j in range(rng.choice([0, 1, 7]))])))
        kind = rng.randrange(6)
        key = f"geocode:{t.lower()}:5"
        cached = json.dumps([{"name": f"cached {t}", "city": "Pune", "latitude": 1.5, "longitude": 2.5, "confidence": 0.9, "provider": "photon"}])
        if kind == 0:
            entries.append(("geocode", key, cached, NOW - dt.timedelta(days=1), 0))
        elif kind == 1:
            entries.append(("geocode", key, cached, NOW - dt.timedelta(days=4000), 0))
        elif kind == 2:
            entries.append(("geocode", key, rng.choice(["[]", "null", "not json"]), NOW, 0))
        elif kind == 3:
            entries.append(("http", key, cached, NOW, 0))
    return centres, responses, entries


def model(spark, centres, responses, entries):
    """The sequential loop over Python dictionaries."""
    from geoverity.operators.search_terms import generate_queries
    from geoverity.sources.providers import parse_payloads
    found = {}
    for r in parse_payloads(spark.createDataFrame(responses, "query string, provider string, payload string")).orderBy("cand_rank").collect():
        found.setdefault((r.query.lower().strip(), r.provider), []).append(r.name)
    cache = {}
    ttl = dt.timedelta(seconds=K.CACHE_TTL["geocode"])
    for ns, key, value, at, _ in entries:
        if ns == "geocode" and at + ttl >= NOW:
            try:
                value = json.loads(value)
            except ValueError:
                continue
            if value is not None:
                cache[key] = [c["name"] for c in value]
    written, out = {}, {}
    queries = {r.pos: r.q for r in spark.createDataFrame(centres, CENTRES).select("pos", generate_queries().alias("q")).collect()}
    for pos, *_, lat, lon in sorted(centres):
        if lat is not None and lon is not None:
            continue
        if queries[pos]:
            out[pos] = (None, False, [])
        for rank, q in enumerate(queries[pos]):
            key = f"geocode:{q.lower().strip()}:5"
            names, hit = cache.get(key), key in cache
            if names is None:
                names = next((found[q.lower().strip(), p][:5] for p in K.PROVIDER_ORDER if found.get((q.lower().strip(), p))), [])
                if names:
                    written[key] = names
            if names:
                out[pos] = (rank, hit, names)
                break
    return out, written


@pytest.mark.parametrize("seed", [1, 2])
def test_sequential_loop(spark, seed):
    centres, responses, entries = made(seed, 120)
    cache = cache_upsert(spark.createDataFrame(entries, "namespace string, key string, value string, created_at timestamp, seq int"))
    landed = spark.createDataFrame(responses, "query string, provider string, payload string")
    answers, writes = R.retrieve(spark.createDataFrame(centres, CENTRES), cache, landed, NOW)
    got = {r.pos: (r.query_rank, r.hit, [c.name for c in r.found or []]) for r in answers.collect()}
    want, written = model(spark, centres, responses, entries)
    assert got == want
    rows = writes.collect()
    assert {r.key: [c["name"] for c in json.loads(r.value)] for r in rows} == written
    assert all((r.expires_at - r.created_at).total_seconds() == K.CACHE_TTL["geocode"] for r in rows)


def test_second_run_is_answered_by_the_cache(spark):
    """What a run writes back answers the next one, with the same candidates."""
    centres, responses, _ = made(3, 60)
    df = spark.createDataFrame(centres, CENTRES)
    empty = cache_upsert(spark.createDataFrame([], "namespace string, key string, value string, created_at timestamp, seq int"))
    landed = spark.createDataFrame(responses, "query string, provider string, payload string")
    first, writes = R.retrieve(df, empty, landed, NOW)
    again, more = R.retrieve(df, writes, landed.limit(0), NOW)
    show = lambda rows: sorted((r.pos, r.query, [c.name for c in r.found or []]) for r in rows)
    assert show(first.collect()) == show(again.collect()) and more.count() == 0
    assert all(r.hit for r in again.collect() if r.found)


def test_hot_key_is_spread(spark):
    """A key that most centres ask is dealt to several tasks and finds the same list."""
    n = 3000
    requests = spark.range(n).selectExpr("id AS pos", "0 AS query_rank", "CASE WHEN id % 3 = 0 THEN 'rare' || id ELSE 'hot' END AS key")
    lists = spark.createDataFrame([("hot", [1, 2]), ("rare3", [3])], "key string, found array<int>")
    joined = R.spread_join(requests, lists, requests.groupBy("key").count().toDF("key", "asked"))
    assert joined.where("found = array(1, 2)").count() == 2000 and joined.where("found = array(3)").count() == 1
    assert joined.count() == n


def test_geocoded_through_the_cache(spark):
    centres = [(1, "a", "Green School", "", "bangalore", "", "India", "", None, None), (2, "b", "", "", "Pune", "", "India", "", None, None)]
    value = json.dumps([{"name": "Green School", "city": "bangalore", "country": "India", "address": "", "state": "", "latitude": 12.97,
                         "longitude": 77.59, "confidence": 0.9, "provider": "photon", "raw": '{"type": "school"}'}])
    cache = cache_upsert(spark.createDataFrame([("geocode", "geocode:green school bangalore india:5", value, NOW, 0)],
                                               "namespace string, key string, value string, created_at timestamp, seq int"))
    landed = spark.createDataFrame([], "query string, provider string, payload string")
    outcome, writes = geocode_by_query(spark.createDataFrame(centres, CENTRES), cache, landed, NOW)
    rows = {r.pos: r for r in outcome.collect()}
    assert rows[1].n_candidates == 1 and rows[2].error == "no_queries_generated" and writes.count() == 0
