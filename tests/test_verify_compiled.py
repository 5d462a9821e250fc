"""the verification step sorts a centre's rows once, reads a raw record in one pass and is compiled in methods
that the JIT compiler takes."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoverity.functions.text import py_strip, strip_column
from geoverity.operators import evidence as E


def test_no_window_by_provider(spark, sf001):
    """Agreement up to a point is told in the order of the list, so that rows are not sorted by provider again."""
    text = entry.queries()["uncertainty"](spark, sf001)._jdf.queryExecution().optimizedPlan().toString()
    parts = [re.findall(r", \[([^\[\]]*)\]", line) for line in text.split("\n") if re.match(r"^[\s:+-]*Window \[", line)]
    assert parts and not any("provider#" in p[0] and "query_rank#" not in p[0] for p in parts if p)


def test_methods_short_enough_for_the_jit_compiler(spark, sf001):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entry.queries()["decide_best"](spark, sf001)._jdf.queryExecution().executedPlan()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


def test_strip_column(spark):
    texts = ["", " ", "a", " a", "a ", "a b", "\x1fa", "a\x85", "é ", "é", "　x　", "~", "!", "\x7f", "\x00a", None, "\ta\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", strip_column("t").alias("got"), py_strip("t").alias("want")).collect()
    assert all(r.got == r.want == (None if r.t is None else r.t.strip()) for r in rows)


def test_points_up_to_the_first_agreeing_one(spark):
    """Against the points picked one by one, with providers of no name and none."""
    data = [(1, 1, "a", 0.0), (1, 2, "b", 9.0), (1, 3, "b", 0.01), (1, 4, "b", 5.0), (1, 5, None, 7.0), (1, 6, None, 0.0),
            (1, 7, None, 3.0), (1, 8, "", 4.0), (1, 9, "=", 0.0), (1, 10, "", 6.0), (2, 1, None, 1.0), (3, None, None, None)]
    df = spark.createDataFrame([(*r, r[3]) for r in data], "pos long, cand_pos int, provider string, latitude double, longitude double")
    for sorted_by in (None, ["cand_pos"]):
        got = {r.pos: r for r in E.provider_evidence(df, sorted_by=sorted_by).select("pos", "provider_evidence.*").distinct().collect()}
        assert len(got) == 3
        kept = [0.0, 9.0, 0.01, 7.0, 0.0, 4.0, 0.0, 6.0]
        mean = sum(kept) / len(kept)
        var = sum((x - mean) ** 2 for x in kept) / len(kept)
        assert abs(got[1].coordinate_variance - (2 * var) ** 0.5) < 1e-9
        assert got[2].coordinate_variance == 0.0 and got[3].providers_total == 0
