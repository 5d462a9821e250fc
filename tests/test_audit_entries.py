"""an audit entry is whole: signals and category scores too, as the reference's entries have them."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoverity import constants as K


def test_entries_are_whole(spark, sf001):
    q = entry.queries()
    got = q["audit_entries"](spark, sf001)
    scores = [f"score_{c}" for c in K.CATEGORY_WEIGHTS]
    assert got.columns == ["pos", "cand_pos", "candidate_id", "provider", "latitude", "longitude", "decision", "confidence",
                           "positive_signals", "negative_signals", "raw_score", *scores]
    got = got.cache()
    signals = q["evidence_signals"](spark, sf001)
    assert got.select(signals.columns).exceptAll(signals).isEmpty() and signals.exceptAll(got.select(signals.columns)).isEmpty()
    assert got.where(F.size("positive_signals") > 0).count() and got.where(F.size("negative_signals") > 0).count()
    total = sum(F.col(f"score_{c}") * w for c, w in K.CATEGORY_WEIGHTS.items()) / sum(K.CATEGORY_WEIGHTS.values())
    assert got.where(F.abs(total - F.col("raw_score")) > 1e-4).isEmpty()
    got.unpersist()
