"""Provider consensus of a centre (E14, E15) as mergeable aggregates: one row per centre.

A centre's list is cut into chunks of positions, and no task holds more of a centre than a
chunk of it:

1. the first candidate of each chunk is a partial ``min_by``; over the small chunk table the
   centre's first candidate goes to every chunk;
2. chunks meet their reference point on (centre, chunk). Within a chunk the first agreeing
   candidate of each provider and the moments up to it (about the reference point) are found;
3. over these summaries, a provider's chunks after its first agreeing one fall away and the
   moments of the others are summed up.

``evidence.provider_evidence`` gives the same values to every candidate by windows over the
centre; the geocoding job uses that on its five candidates per provider.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from .evidence import provider_weight

CHUNK = 10_000  # positions of a chunk


def _moments(x: str, ref: str) -> list:
    d = F.when(F.col("counted"), F.col(x) - F.coalesce(F.col(ref), F.lit(0.0)))
    return [F.count(d).alias(f"{x}_n"), F.sum(d).alias(f"{x}_s"), F.sum(d * d).alias(f"{x}_ss")]


def _variance(x: str):
    """Population variance from summed moments; rounding never makes it negative."""
    n, s, ss = (F.sum(f"{x}_{m}") for m in ("n", "s", "ss"))
    mean = F.try_divide(s, n)
    return F.greatest(F.lit(0.0), F.try_divide(ss, n) - mean * mean)


def provider_consensus(df: DataFrame, key: str = "pos", order: str = "cand_pos",
                       agree_km: float = K.PROVIDER_AGREEMENT_KM, chunk: int = CHUNK) -> DataFrame:
    """(key, ``provider_evidence``, ``provider_weights``) of every centre with candidates. Rows without a
    centre or position are no candidates. A null provider counts neither as present nor as agreeing, its
    points count in the variance."""
    c = (df.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), "provider",
                   F.col("latitude").cast("double").alias("la"), F.col("longitude").cast("double").alias("lo"))
           .where("k IS NOT NULL AND o IS NOT NULL").withColumn("ch", F.floor(F.col("o") / chunk)))
    heads = c.groupBy("k", "ch").agg(F.min_by(F.struct("la", "lo"), "o").alias("head"), F.min("o").alias("at"))
    heads = heads.select("k", "ch", F.min_by("head", "at").over(Window.partitionBy("k")).alias("ref"))
    near = (c.join(heads, ["k", "ch"]).select("*", F.col("ref.la").alias("r_la"), F.col("ref.lo").alias("r_lo"))
             .withColumn("agree", F.coalesce(geo.haversine_km("la", "lo", "r_la", "r_lo") <= agree_km, F.lit(False))))
    here = Window.partitionBy("k", "ch", "provider")
    near = (near.withColumn("hit", F.min(F.when(F.col("agree"), F.col("o"))).over(here))
                .withColumn("counted", F.col("hit").isNull() | (F.col("o") <= F.col("hit"))))
    parts = near.groupBy("k", "ch", "provider").agg(F.max("agree").alias("agree"), *_moments("la", "r_la"),
                                                    *_moments("lo", "r_lo"))
    first_hit = F.min(F.when(F.col("agree"), F.col("ch"))).over(Window.partitionBy("k", "provider"))
    parts = parts.withColumn("first_hit", first_hit).where("first_hit IS NULL OR ch <= first_hit")
    present = F.col("provider").isNotNull()
    per = (parts.groupBy("k", "provider").agg(F.max("agree").alias("agree"), *[
               F.sum(f"{x}_{m}").alias(f"{x}_{m}") for x in ("la", "lo") for m in ("n", "s", "ss")])
           .withColumn("weight", provider_weight("provider")))
    out = per.groupBy("k").agg(
        F.count_if(present).alias("total"), F.count_if(present & F.col("agree")).alias("agreeing"),
        F.sum("la_n").alias("points"), F.sqrt(_variance("la") + _variance("lo")).alias("spread"),
        F.avg(F.when(present, F.col("weight"))).alias("mean_weight"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(present, F.struct("provider", "weight"))))).alias("weights"))
    ratio = F.coalesce(F.try_divide(F.col("agreeing"), F.col("total")), F.lit(0.0))
    evidence = F.struct(
        F.col("agreeing").cast("int").alias("providers_agreeing"), F.col("total").cast("int").alias("providers_total"),
        ratio.alias("consensus_ratio"),
        F.when(F.col("points") < 2, F.lit(0.0)).otherwise(F.col("spread")).alias("coordinate_variance"),
        F.col("mean_weight").alias("mean_provider_weight"),
        ((F.col("total") >= 2) & (ratio < 0.5)).alias("disagreement"))
    return out.select(F.col("k").alias(key), evidence.alias("provider_evidence"),
                      F.col("weights").alias("provider_weights"))


def ungrouped_evidence(df: DataFrame) -> DataFrame:
    """E14 without results by provider: every candidate's own provider stands for all and agrees."""
    name = F.coalesce(F.col("provider"), F.lit("unknown"))
    return df.withColumn("provider_evidence", F.struct(
        F.lit(1).alias("providers_agreeing"), F.lit(1).alias("providers_total"), F.lit(1.0).alias("consensus_ratio"),
        F.lit(0.0).alias("coordinate_variance"), provider_weight(name).alias("mean_provider_weight"),
        F.lit(False).alias("disagreement"))).withColumn("provider_weights", F.create_map(name, provider_weight(name)))
