"""What the verification of candidates does once, late or not at all."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoverity.functions import similarity as sim


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_raw_records_are_read_after_the_limits(spark, sf001):
    """Only of the candidates that are kept: nothing below the limit of five reads a raw record."""
    text = plan(entry.queries()["uncertainty"](spark, sf001))
    above, below = text.split("WindowGroupLimit", 1)
    assert "variant_get" in above and "variant_get" not in below and "from_json" not in below


def test_consensus_of_a_centre_in_one_window(spark, sf001):
    text = plan(entry.queries()["uncertainty"](spark, sf001))
    assert sum("collect_set" in line for line in text.split("\n") if "Window [" in line) == 1


def test_best_decision_carries_its_columns_only(spark, sf001):
    line = next(x for x in plan(entry.queries()["decide_best"](spark, sf001)).split("\n") if "max_by" in x)
    assert "signals" not in line and "geography" not in line


def test_audit_decides_once(spark, sf001):
    """Entries and best candidates come from one table of decisions."""
    assert "ArrowEvalPython" not in plan(entry.queries()["audit_report"](spark, sf001))


def test_equal_texts_need_no_fold(spark):
    """Decided natively where the fold of both cannot be empty, as the similarity itself decides them elsewhere."""
    texts = ["A b", "9", " ", "́", "é", "", "-", "straße", "学校"]
    rows = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", sim.fuzzy_score("a", "b").alias("s"),
                                                                  sim.same_text("a", "b").alias("same"))
    got = df.collect()
    assert all(r.s == sim.fuzzy_similarity(r.a, r.b) for r in got)
    assert {r.a for r in got if r.same} == {"A b", "9", "straße"}
    assert df.where(F.col("same") & (F.col("a") != F.col("b"))).count() == 0
