"""a previous record is met once for each centre, and a ratio that is only tested is formed where bounds leave it open."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoverity.functions import similarity as sim


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_history_needs_no_other_collector(spark, sf001):
    """Neither raw records nor the consensus of a centre are read for it."""
    for query in ("historical_evidence", "fusion_historical"):
        text = plan(entry.queries()[query](spark, sf001))
        assert "variant" not in text and "from_json" not in text and "min_by" not in text


def test_previous_record_is_met_before_the_candidates(spark, sf001):
    text = plan(entry.queries()["historical_evidence"](spark, sf001))
    assert "p_id" not in text.split("WindowGroupLimit")[0].split("c_pos")[0]


def test_tested_ratio_equals_the_ratio(spark):
    texts = ["", "a", "ab", "old name", "name", "old school house", "house school old", "mumbai", "bombay", "münchen",
             "munchen", "x" * 70, "x" * 50 + "y" * 20, "学校", "学校a", "😀 school", "school"]
    pairs = [(a, b) for a in texts for b in texts] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for n in (0, 40, 60, 70, 100):
        got = df.select("a", "b", sim.ratio_holds("a", "b", lambda r: r >= n).alias("ge"),
                        sim.ratio_holds("a", "b", lambda r: r > n).alias("gt")).collect()
        for r in got:
            want = None if r.a is None or r.b is None else sim.indel_ratio(r.a, r.b)
            assert (r.ge, r.gt) == ((None, None) if want is None else (want >= n, want > n)), r


def test_equal_texts_form_no_subsequence(spark):
    """A subsequence of texts of this length would take minutes."""
    df = spark.createDataFrame([("ab" * 4000, "ab" * 4000), ("ab" * 4000, "cd" * 4000)], "a string, b string")
    assert [r.x for r in df.select(sim.ratio_holds("a", "b", lambda r: r >= 70).alias("x")).collect()] == [True, False]


def test_decision_plan_stays_small(spark, sf001):
    """Evidence is not copied into each score and signal that reads it."""
    assert len(plan(entry.queries()["decide_all"](spark, sf001))) < 200_000
