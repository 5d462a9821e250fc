"""Gazetteer search (S13): per query, the first ``k`` gazetteer entries (by id)
whose name contains the query's first three words, case-insensitively (a
literal substring test).

Join strategy: the match depends only on the phrase, so queries are first
reduced to their distinct phrases. Each gazetteer name is indexed by its
character n-grams (n = 1..3); each phrase is routed to its *rarest* n-gram
(n = min(3, len)), found with a partial aggregate of n-gram frequencies. The
equi-join on that n-gram is a superset of all containing names, so the exact
``contains`` test afterwards loses nothing, and no phrase is compared with all
names. Per-phrase top-k runs as a window-group limit (also applied map-side);
the per-phrase results are joined back to the queries (AQE turns that join into
a broadcast when the measured result is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ngrams(col, n_max: int = 3):
    """Distinct character n-grams (n = 1..n_max) of a string column."""
    s = F.col(col) if isinstance(col, str) else col
    def gram_of(n):
        return lambda i: F.substring(s, i, n)
    grams = []
    for n in range(1, n_max + 1):
        grams.append(F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1),
                                                          gram_of(n))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.flatten(F.array(*grams)), lambda g: F.length(g) > 0))


def first_words(query, n: int = 3):
    q = F.col(query) if isinstance(query, str) else query
    words = F.filter(F.split(F.trim(q), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def gazetteer_search(queries: DataFrame, gazetteer: DataFrame, k: int = 5,
                     query_key: str = "qid", kind: str | None = "school") -> DataFrame:
    """queries(qid, query) x gazetteer(gid, name[, kind]) -> (qid, rank, gid, name)."""
    g = gazetteer
    if kind is not None and "kind" in g.columns:
        g = g.filter(F.col("kind") == kind)
    g = g.select("gid", "name", F.lower("name").alias("lname"))
    q = queries.select(query_key, F.lower(first_words("query")).alias("phrase"))
    phrases = q.select("phrase").filter(F.col("phrase") != "").distinct()
    # each phrase's grams of length min(3, len); it is routed through the rarest one
    plen = F.least(F.length("phrase"), F.lit(3))
    pg = phrases.select("phrase", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("phrase") - plen + 1), lambda i: F.substring("phrase", i, plen))
    ).alias("gram"))
    # (gram, gid) of grams that some phrase has; names are fetched for the hits only
    idx = g.select("gid", F.explode(_ngrams("lname")).alias("gram")).join(pg.select("gram").distinct(), "gram", "left_semi")
    freq = idx.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    route = (pg.join(freq, "gram", "left").fillna(0, ["n"])
               .groupBy("phrase").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))
    hits = (route.join(idx, "gram").select("phrase", "gid").join(g, "gid")
                 .filter(F.contains(F.col("lname"), F.col("phrase"))).select("phrase", "gid", "name"))
    w = Window.partitionBy("phrase").orderBy("gid")
    top = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return q.join(top, "phrase").select(query_key, "rank", "gid", "name")
