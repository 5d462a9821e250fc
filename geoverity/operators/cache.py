"""Response cache as a relation.

The cache is a table ``(namespace, key, value, created_at, expires_at)`` with
primary key (namespace, key). A log of writes becomes the table by
last-write-wins per key; reads, deletes and cleanup are joins and filters
against an ``as_of`` time. Every per-key step is a partial (map-side)
aggregate or a semi/anti join, so a hot key or namespace is cheap.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def default_ttl(namespace) -> Column:
    ns = F.col(namespace) if isinstance(namespace, str) else namespace
    kv = [x for n, t in K.CACHE_TTL.items() for x in (F.lit(n), F.lit(t))]
    return F.coalesce(F.element_at(F.create_map(*kv), ns), F.lit(K.CACHE_TTL_DEFAULT))


def geocode_cache_key(query, limit: int = K.CANDIDATES_PER_PROVIDER) -> Column:
    """``geocode:{lower(strip(query))}:{limit}``."""
    from ..functions.text import py_strip
    q = F.col(query) if isinstance(query, str) else query
    return F.concat(F.lit("geocode:"), F.lower(py_strip(q)), F.lit(f":{limit}"))


def cache_upsert(log: DataFrame, ttl: Column | None = None) -> DataFrame:
    """Insert-or-replace per (namespace, key): the write with the latest
    (created_at, seq) wins; expires_at = created_at + ttl seconds (namespace
    default unless ``ttl`` is given)."""
    t = ttl if ttl is not None else default_ttl("namespace")
    w = (log.withColumn("_ttl", t)
            .groupBy("namespace", "key")
            .agg(F.max_by(F.struct("value", "created_at", "_ttl"), F.struct("created_at", "seq")).alias("_w")))
    return w.select("namespace", "key", F.col("_w.value").alias("value"),
                    F.col("_w.created_at").alias("created_at"),
                    (F.col("_w.created_at") + F.make_dt_interval(secs=F.col("_w._ttl").cast("decimal(18,6)")))
                    .alias("expires_at"))


def _as_of(table: DataFrame, as_of: dt.datetime) -> Column:
    """``as_of`` typed like the table's timestamps (a wall-clock value for
    TIMESTAMP_NTZ), so the comparison does not depend on the session time zone."""
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(table.schema["expires_at"].dataType)


def _live(table: DataFrame, as_of: dt.datetime) -> DataFrame:
    return table.filter(F.col("expires_at") >= _as_of(table, as_of))


def cache_lookup(table: DataFrame, requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Per requested (namespace, key): hit flag and the value when the
    entry exists and has not expired at ``as_of``."""
    live = _live(table, as_of).select("namespace", "key", "value", F.lit(True).alias("_hit"))
    return (requests.select("namespace", "key").join(live, ["namespace", "key"], "left")
                    .select("namespace", "key", F.coalesce("_hit", F.lit(False)).alias("hit"),
                            F.col("value")))


def cache_misses(table: DataFrame, requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Requests that must be fetched (anti join against live entries)."""
    return requests.join(_live(table, as_of).select("namespace", "key"), ["namespace", "key"], "left_anti")


def cache_has(table: DataFrame, requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """C9 has: live entry whose JSON value is not null."""
    live = _live(table, as_of).filter(F.col("value").isNotNull() & (F.trim(F.col("value")) != "null"))
    return requests.join(live.select("namespace", "key"), ["namespace", "key"], "left_semi")


def cache_cleanup_expired(table: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(remaining table, one-row count of removed entries)."""
    expired = F.col("expires_at") < _as_of(table, as_of)
    return (table.filter(~expired),
            table.agg(F.sum(F.when(expired, 1).otherwise(0)).cast("long").alias("removed")))


def cache_stats(table: DataFrame) -> DataFrame:
    """Entries per namespace (expired ones included)."""
    return table.groupBy("namespace").agg(F.count(F.lit(1)).alias("entries"))


def cache_delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """C9 delete: the table without the given (namespace, key) pairs."""
    return table.join(keys.select("namespace", "key"), ["namespace", "key"], "left_anti")


def cache_clear_namespace(table: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """C9 clear_namespace: (remaining table, removed count)."""
    hit = F.col("namespace") == namespace
    return table.filter(~hit), table.agg(F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("removed"))


def cache_clear_all(table: DataFrame) -> DataFrame:
    """C9 clear_all: removed count (the remaining table is empty)."""
    return table.agg(F.count(F.lit(1)).alias("removed"))
