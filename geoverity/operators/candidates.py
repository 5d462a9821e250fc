"""Candidate retrieval semantics over landed provider results.

Candidate relation columns: ``pos`` (centre key), ``query_rank``,
``provider`` / ``provider_rank`` (provider order), ``cand_pos`` (position in
the centre's list), the candidate fields and ``raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def provider_rank(provider) -> Column:
    """Position of a provider in the configured order (unknown -> last)."""
    kv = [x for i, p in enumerate(K.PROVIDER_ORDER) for x in (F.lit(p), F.lit(i))]
    p = F.col(provider) if isinstance(provider, str) else provider
    return F.coalesce(F.element_at(F.create_map(*kv), p), F.lit(len(K.PROVIDER_ORDER)))


def candidates_all_providers(cands: DataFrame, limit: int = K.CANDIDATES_PER_PROVIDER) -> DataFrame:
    """Per (centre, query, provider) the first ``limit`` results.

    ``row_number() <= k`` is planned as a WindowGroupLimit, which Spark also
    applies *before* the shuffle, so a hot centre sends at most ``k`` rows per
    group from each map task."""
    w = Window.partitionBy("pos", "query_rank", "provider").orderBy("cand_pos")
    return cands.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def candidates_fallback(cands: DataFrame) -> DataFrame:
    """Per (centre, query) only the first provider (in provider order) with results. A partial
    aggregate and a join that Spark may split, so that a hot centre fills no single task."""
    first = cands.groupBy("pos", "query_rank").agg(F.min("provider_rank").alias("provider_rank"))
    return cands.join(first, ["pos", "query_rank", "provider_rank"], "left_semi")


def first_successful_query(cands: DataFrame) -> DataFrame:
    """Per centre keep only the candidates of the lowest query rank that has any."""
    first = cands.groupBy("pos").agg(F.min("query_rank").alias("query_rank"))
    return cands.join(first, ["pos", "query_rank"], "left_semi")


def candidates_batch(cands: DataFrame, limit: int = K.CANDIDATES_PER_PROVIDER) -> DataFrame:
    """C4: fallback mode per query, then the first successful query per centre."""
    return first_successful_query(candidates_fallback(candidates_all_providers(cands, limit)))


def pending_centres(centres: DataFrame, force: bool = False, resume: bool = False) -> DataFrame:
    """The work list. Default skips rows with both coordinates; ``resume``
    keeps rows with either coordinate missing (same rows); ``force`` keeps all."""
    if force:
        return centres
    return centres.filter(F.col("latitude").isNull() | F.col("longitude").isNull())


def provider_usage(cands: DataFrame, limit: int = K.CANDIDATES_PER_PROVIDER) -> DataFrame:
    """C11: calls per provider that returned results, over the queries actually
    tried (ranks up to each centre's first successful one); one call per
    (centre, query). Partial aggregation keeps a hot provider cheap."""
    calls = cands.select("pos", "query_rank", "provider").distinct()
    tried = first_successful_query(calls)
    return tried.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"))
