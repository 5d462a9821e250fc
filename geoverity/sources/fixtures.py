"""Stand-in inputs derived from the driver's tables.

The engine's operators take generic relations (centres, candidates, an existing
dataset, a cache log, landed files). The test tables are TPC-H-like, so these
views only *re-shape* rows into those schemas; they do none of the operators'
work. The same SQL text runs in Spark (tables passed as DataFrame parameters)
and in DuckDB (as a ``WITH`` chain in the oracle), so both engines see
identical inputs.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

VIEW_SQL: dict[str, str] = {
    "cities": """
SELECT CAST(i AS BIGINT) city_idx, city, CAST(a AS DOUBLE) city_lat, CAST(o AS DOUBLE) city_lon, ctry
FROM (VALUES (0,'bangalore',12.9716,77.5946,'India'),(1,'mumbai',19.076,72.8777,'IN'),
 (2,'delhi',28.6139,77.209,'Bharat'),(3,'chennai',13.0827,80.2707,'India'),
 (4,'hyderabad',17.385,78.4867,'India'),(5,'pune',18.5204,73.8567,'in'),
 (6,'kolkata',22.5726,88.3639,'INDIA'),(7,'agra',27.1767,78.0081,'India'),
 (8,'jaipur',26.9124,75.7873,'India'),(9,'lucknow',26.8467,80.9462,'India'),
 (10,'new york',40.7128,-74.006,'USA'),(11,'los angeles',34.0522,-118.2437,'U.S.'),
 (12,'chicago',41.8781,-87.6298,'United States'),(13,'houston',29.7604,-95.3698,'America'),
 (14,'phoenix',33.4484,-112.074,'us'),(15,'london',51.5074,-0.1278,'England'),
 (16,'manchester',53.4808,-2.2426,'UK'),(17,'birmingham',52.4862,-1.8904,'Great Britain'),
 (18,'toronto',43.6532,-79.3832,'Canada'),(19,'vancouver',49.2827,-123.1207,'ca'),
 (20,'dubai',25.2048,55.2708,'UAE'),(21,'abu dhabi',24.4539,54.3773,'U.A.E.'),
 (22,'singapore',1.3521,103.8198,'SG')) t(i,city,a,o,ctry)""",
    "centres": """
SELECT o_orderkey AS pos,
 CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'C' || CAST(o_custkey AS STRING) ELSE 'O' || CAST(o_orderkey AS STRING) END AS id,
 CASE WHEN o_orderkey % 5 = 0 THEN 'The ' ELSE '' END || c_mktsegment || CASE o_custkey % 3 WHEN 0 THEN ' School' WHEN 1 THEN ' Intl Academy' ELSE ' House of Trade' END AS name,
 CAST(o_custkey AS STRING) || ' Main Road' AS address, city,
 CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'State ' || CAST(c_nationkey AS STRING) END AS state,
 CASE WHEN o_orderkey % 29 = 0 THEN 'Atlantis' ELSE ctry END AS country,
 CAST(100000 + o_custkey AS STRING) AS postal_code,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN CAST(-20 AS DOUBLE) WHEN o_orderkey % 19 = 1 THEN city_lat
      ELSE city_lat + CAST((o_orderkey * 7919) % 20011 - 10005 AS DOUBLE) / 200000 END AS latitude,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN CAST(60 AS DOUBLE) WHEN o_orderkey % 19 = 1 THEN city_lon
      ELSE city_lon + CAST((o_orderkey * 104729) % 20011 - 10005 AS DOUBLE) / 200000 END AS longitude,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST((o_orderkey * 31) % 100 AS DOUBLE) / 100 END AS confidence
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {cities} ON city_idx = o_custkey % 23""",
    "candidates": """
SELECT l_orderkey AS pos, l_linenumber % 3 AS query_rank, l_suppkey % 4 AS provider_rank,
 CASE l_suppkey % 4 WHEN 0 THEN 'nominatim' WHEN 1 THEN 'photon' WHEN 2 THEN 'geoapify' ELSE 'overpass' END AS provider,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 4, l_linenumber, l_partkey, l_suppkey) AS cand_pos,
 c.name AS name, c.city AS city, c.country AS country,
 k.city_lat + CAST((l_partkey * 131 + l_suppkey * 17) % 401 - 200 AS DOUBLE) / 2000 AS latitude,
 k.city_lon + CAST((l_partkey * 17 + l_suppkey * 131) % 401 - 200 AS DOUBLE) / 2000 AS longitude,
 l_discount * 10 AS confidence,
 CASE l_returnflag WHEN 'A' THEN 'school' WHEN 'N' THEN 'residential' ELSE '' END AS raw_type
FROM {lineitem} JOIN {centres} c ON c.pos = l_orderkey JOIN {cities} k ON k.city = c.city""",
    "existing": """
SELECT pos, id, CASE WHEN pos % 9 = 0 THEN 'Old ' || name ELSE name END AS name, address, city, state, country, postal_code,
 CASE WHEN pos % 5 = 0 THEN latitude + 0.5 ELSE latitude END AS latitude, longitude FROM {centres} WHERE pos % 7 <> 0
 UNION ALL SELECT pos + 10000000, 'GONE' || CAST(pos AS STRING), name, address, city, state, country, postal_code, latitude, longitude FROM {centres} WHERE pos % 50 = 0""",
    "cache_log": """
SELECT CASE event_type WHEN 'view' THEN 'http' WHEN 'click' THEN 'geocode' WHEN 'signup' THEN 'download' WHEN 'purchase' THEN 'manual' ELSE 'other' END AS namespace,
 CAST(user_id AS STRING) AS key, props AS value, ts AS created_at, event_id AS seq FROM {events}""",
    "landed_files": """
SELECT page_id AS file_id, url AS path, html AS payload, length(html) AS n FROM {pages}""",
}

VIEW_DEPS: dict[str, list[str]] = {
    "cities": [],
    "centres": ["orders", "customer", "cities"],
    "candidates": ["lineitem", "centres", "cities"],
    "existing": ["centres"],
    "cache_log": ["events"],
    "landed_files": ["pages"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one stand-in relation (lazily) on top of the parquet scans."""
    args = {}
    for dep in VIEW_DEPS[name]:
        args[dep] = view(spark, sf_dir, dep) if dep in VIEW_SQL else read_table(spark, sf_dir, dep)
    return spark.sql(VIEW_SQL[name], **args) if args else spark.sql(VIEW_SQL[name])


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n not in VIEW_SQL or n in out:
            return
        for d in VIEW_DEPS[n]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


@lru_cache(maxsize=None)
def _plain(name: str) -> str:
    return VIEW_SQL[name].format(**{d: d for d in VIEW_DEPS[name]})


def with_views(body: str, *names: str) -> str:
    """DuckDB form: ``WITH <views> <body>`` with every needed view inlined."""
    ctes = ", ".join(f"{n} AS ({_plain(n)})" for n in _closure(list(names)))
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
