"""Connected components by label doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that each node of some edges reaches. In every round a node takes the least label
    of its neighbours and then the label of that label, so labels travel twice as far each time; the rounds are about
    logarithmic in the length of the longest path."""
    links = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(links.union(links.select("v", "u")).distinct())
    state = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")))
    while not state.isEmpty():
        offers = both.join(state.select(F.col("u").alias("v"), "to"), "v").select("u", "to", F.lit(None).alias("old"))
        best = state.withColumn("old", F.col("to")).unionByName(offers).groupBy("u").agg(
            F.min("to").alias("to"), F.max("old").alias("old"))
        far = best.select(F.col("u").alias("to"), F.col("to").alias("far"))
        moved = Observation()
        jumped = best.join(far, "to", "left").select("u", F.least("to", F.coalesce("far", "to")).alias("to"), "old")
        state = written(jumped.observe(moved, F.max(F.col("to") != F.col("old")).alias("any")).select("u", "to"))
        if not moved.get.get("any"):
            break
    return state.select(F.col("u").alias("node"), F.col("to").alias("comp"))
