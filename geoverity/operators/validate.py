"""Centre validation (V1-V4).

The stateless checks are one ordered CASE. The duplicate checks are
order-dependent: a row is a duplicate only of rows *accepted* earlier, and
rejected rows never block later ones. That is the lexicographically-first
maximal independent set of the conflict graph (same non-empty id, or same
coordinates). Rows without any conflict are accepted at once, short chains are
decided in a few parallel rounds (below). What is left falls into connected components, found by label doubling in logarithmically many rounds
however long a chain of conflicts is; each component of up to ``MAX_COMPONENT``
rows is decided in order by one task. Larger ones (a key that a large share of
all rows holds) are decided in parallel rounds (Blelloch, Fineman, Shun, SPAA
2012): each round accepts every undecided row that is the earliest undecided row
of both its id group and its coordinate group, then rejects the undecided rows
sharing a key with a newly accepted row; all group minima are partial aggregates.
Each round's state is written to the shared checkpoint folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.geo import on_land
from ..functions.text import normalize_country, py_fixed, py_float_repr, spread_id
from ..session import written
from .components import components


def _valid_countries() -> Column:
    # canonical forms of the configured list (they are their own canonical form)
    return F.array(*[F.lit(c) for c in K.VALID_COUNTRIES])


def stateless_reason(ocean_check: bool = True) -> Column:
    """V1: first failing stateless check as struct(reason, failed_at), or NULL."""
    lat, lon, country = F.col("latitude"), F.col("longitude"), F.coalesce(F.col("country"), F.lit(""))
    missing = lat.isNull() | lon.isNull()
    ocean = ~on_land(lat, lon) if ocean_check else F.lit(False)
    wrong = (country != "") & ~F.array_contains(_valid_countries(), normalize_country(country))

    def r(reason, at):
        return F.struct(reason.alias("reason") if isinstance(reason, Column) else F.lit(reason).alias("reason"),
                        F.lit(at).alias("failed_at"))
    return (F.when(missing, r("missing_coordinates", "coordination_check"))
             .when(ocean, r("ocean_coordinates", "ocean_check"))
             .when(wrong, r(F.concat(F.lit("wrong_country: "), country), "country_check")))


def low_confidence(threshold: float = K.CONFIDENCE_THRESHOLD) -> Column:
    """V4: numeric confidence below the threshold (missing confidence counts as 1.0)."""
    c = F.col("confidence")
    return c.isNotNull() & ~F.isnan(c) & (c < threshold)


def low_confidence_text() -> Column:
    return F.concat(F.lit("low_confidence: "), py_fixed(F.col("confidence"), 2))


def validate_stateless(centres: DataFrame, ocean_check: bool = True) -> DataFrame:
    s = stateless_reason(ocean_check)
    return centres.select("pos", s["reason"].alias("reason"), s["failed_at"].alias("failed_at"),
                          s.isNull().alias("passes"))


def confidence_filter(centres: DataFrame, threshold: float = K.CONFIDENCE_THRESHOLD) -> DataFrame:
    """V4 alone: rows failing the confidence check."""
    return centres.filter(low_confidence(threshold)).select(
        "pos", "id", "confidence", low_confidence_text().alias("reason"))


def _checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (the session's
    ``spark.checkpoint.dir``; a scratch folder only when none is configured)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a component that one task decides in order.
MAX_COMPONENT = 200_000


#: Rounds that decide short chains before components are looked for.
FIRST_ROUNDS = 3


def accept_first_free(rows: DataFrame, max_component: int = MAX_COMPONENT, rounds: int = FIRST_ROUNDS) -> DataFrame:
    """Greedy-in-``pos`` acceptance over conflict keys ``id`` (ignored when
    empty) and ``ck`` (coordinates). Returns the accepted rows' ``pos, id, ck``."""
    rows = rows.select("pos", "id", "ck")
    tagged = _checkpoint(_with_firsts(rows).withColumn("free", F.coalesce(F.col("nid"), F.lit(1)) * F.col("nck") == 1))
    free = tagged.filter("free").select("pos", "id", "ck")
    accepted, left = _accept_by_rounds(tagged.filter(~F.col("free")).select("pos", "id", "ck"), rounds)
    accepted = free.unionByName(accepted)
    return accepted if left is None else accepted.unionByName(_accept_by_components(left, max_component))


def _with_firsts(rows: DataFrame) -> DataFrame:
    """Adds how many rows share a row's id (nid, first_id; null without an id) and coordinates (nck, first_ck), and the
    first of them."""
    by_id = rows.filter(F.col("id") != "").groupBy("id").agg(F.count(F.lit(1)).alias("nid"), F.min("pos").alias("first_id"))
    by_ck = rows.groupBy("ck").agg(F.count(F.lit(1)).alias("nck"), F.min("pos").alias("first_ck"))
    return rows.join(by_id.withColumnRenamed("id", "k"), spread_id("id", "pos") == F.col("k"), "left").drop("k") \
        .join(by_ck, "ck", "left")


def _accept_by_components(rest: DataFrame, max_component: int) -> DataFrame:
    """The sequential rule on rows with conflicts, component by component."""
    tagged = _with_firsts(rest)
    # a star for each key: its rows and the first of them
    edges = tagged.where("first_id IS NOT NULL").select(F.col("pos").alias("a"), F.col("first_id").alias("b")) \
        .unionByName(tagged.select(F.col("pos").alias("a"), F.col("first_ck").alias("b")))
    # a row whose conflicts have all been decided is a component by itself
    comps = components(edges).withColumnRenamed("node", "pos")
    placed = rest.join(comps, "pos", "left").withColumn("comp", F.coalesce("comp", "pos"))
    sizes = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    placed = written(placed.join(sizes, "comp"))
    small = placed.where(F.col("n") <= max_component).select("comp", "pos", "id", "ck")
    in_order = small.groupBy("comp").applyInPandas(_accept_in_order, small.drop("comp").schema)
    large, _ = _accept_by_rounds(placed.where(F.col("n") > max_component).select("pos", "id", "ck"))
    return in_order.unionByName(large)


def _accept_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule on the rows of one component."""
    rows = rows.sort_values("pos")
    ids, coords, kept = set(), set(), []
    for cid, ck in zip(rows["id"], rows["ck"]):
        ck = tuple(ck.values()) if isinstance(ck, dict) else tuple(ck)
        fits = (not cid or cid not in ids) and ck not in coords
        if fits:
            ids.add(cid)
            coords.add(ck)
        kept.append(fits)
    return rows.loc[kept, ["pos", "id", "ck"]]


def _accept_by_rounds(und: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(accepted rows, rows left undecided or None) of the sequential rule in parallel rounds, ``most`` at most."""
    accepted, done = und.limit(0), 0
    while True:
        und = _checkpoint(und)
        if und.isEmpty():
            return accepted, None
        if done == most:
            return accepted, und
        done += 1
        mid = und.filter(F.col("id") != "").groupBy("id").agg(F.min("pos").alias("mid"))
        mck = und.groupBy("ck").agg(F.min("pos").alias("mck"))
        cand = und.join(mid.withColumnRenamed("id", "k"), spread_id("id", "pos") == F.col("k"), "left").drop("k") \
            .join(mck, "ck", "left")
        now = _checkpoint(cand.filter(((F.col("id") == "") | (F.col("pos") == F.col("mid")))
                                      & (F.col("pos") == F.col("mck"))).select("pos", "id", "ck"))
        accepted = accepted.unionByName(now)
        ids = now.filter(F.col("id") != "").select(F.col("id").alias("k"))
        und = (und.join(now.select("pos"), "pos", "left_anti")
                  .join(ids, spread_id("id", "pos") == F.col("k"), "left_anti").join(now.select("ck"), "ck", "left_anti"))


def validate_centres(centres: DataFrame, threshold: float = K.CONFIDENCE_THRESHOLD,
                     ocean_check: bool = True, max_component: int = MAX_COMPONENT,
                     rounds: int = FIRST_ROUNDS) -> DataFrame:
    """V2: per centre ``is_valid``, ``reason``, ``failed_at`` with the reference's
    sequential semantics (checks in order; duplicates only of accepted rows)."""
    base = (centres.select("pos", F.coalesce(F.col("id"), F.lit("")).alias("id"), "latitude", "longitude",
                           "country", "confidence")
                   .withColumn("sl", stateless_reason(ocean_check))
                   .withColumn("ck", F.struct("latitude", "longitude"))
                   .withColumn("low", low_confidence(threshold)))
    eligible = base.filter(F.col("sl").isNull() & ~F.col("low"))
    accepted = accept_first_free(eligible, max_component, rounds).select("pos", F.lit(True).alias("acc"))
    acc = base.join(accepted, "pos", "left").withColumn("acc", F.coalesce("acc", F.lit(False)))
    acc = _checkpoint(acc)
    first_id = (acc.filter(F.col("acc") & (F.col("id") != "")).groupBy("id")
                   .agg(F.min("pos").alias("first_id")))
    first_ck = acc.filter("acc").groupBy("ck").agg(F.min("pos").alias("first_ck"))
    # only rows that a duplicate check rejected look their first holders up
    asks = acc.filter(F.col("sl").isNull() & ~F.col("acc"))
    lab = (asks.join(first_id.withColumnRenamed("id", "k"), spread_id("id", "pos") == F.col("k"), "left").drop("k")
               .join(first_ck, "ck", "left")
               .unionByName(acc.filter(F.col("sl").isNotNull() | F.col("acc")), allowMissingColumns=True))
    dup_id = (F.col("id") != "") & (F.col("first_id") < F.col("pos"))
    dup_ck = F.col("first_ck") < F.col("pos")
    coord_txt = F.concat(F.lit("("), py_float_repr(F.col("latitude")), F.lit(", "),
                         py_float_repr(F.col("longitude")), F.lit(")"))
    reason = (F.when(F.col("sl").isNotNull(), F.col("sl")["reason"])
               .when(F.col("acc"), F.lit(None).cast("string"))
               .when(dup_id, F.concat(F.lit("duplicate_id: "), F.col("id")))
               .when(dup_ck, F.concat(F.lit("duplicate_coords: "), coord_txt))
               .when(F.col("low"), low_confidence_text()))
    failed_at = (F.when(F.col("sl").isNotNull(), F.col("sl")["failed_at"])
                  .when(F.col("acc"), F.lit(None).cast("string"))
                  .when(dup_id, F.lit("duplicate_id_check"))
                  .when(dup_ck, F.lit("duplicate_coords_check"))
                  .when(F.col("low"), F.lit("confidence_check")))
    return lab.select("pos", F.col("acc").alias("is_valid"), reason.alias("reason"),
                      failed_at.alias("failed_at"))


def validation_summary(result: DataFrame) -> DataFrame:
    """V3: total, valid, failed and one counter per reason family
    (``wrong_city`` exists and is never incremented)."""
    r = F.coalesce(F.col("reason"), F.lit(""))

    def cnt(prefix):
        return F.sum(F.when(r.startswith(prefix), 1).otherwise(0)).cast("long")
    return result.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("is_valid"), 1).otherwise(0)).cast("long").alias("valid"),
        F.sum(F.when(~F.col("is_valid"), 1).otherwise(0)).cast("long").alias("failed"),
        cnt("duplicate_id").alias("duplicate_ids"), cnt("duplicate_coords").alias("duplicate_coords"),
        cnt("wrong_country").alias("wrong_country"), F.lit(0).cast("long").alias("wrong_city"),
        cnt("missing_coordinates").alias("missing_coords"), cnt("ocean_coordinates").alias("ocean_coords"),
        cnt("low_confidence").alias("low_confidence"))
