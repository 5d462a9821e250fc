"""What the verification does for every centre and candidate is compiled, and sorts are few."""

import sys

from pyspark.sql import functions as F

import __spark_entry__ as entry
from geoverity import constants as K
from geoverity.functions.text import py_strip, strip_noise_words
from geoverity.operators.search_terms import generate_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_raw_records_and_search_texts_without_lambdas(spark, sf001):
    assert "lambda" not in plan(entry.queries()["skipped_collectors"](spark, sf001).select("skipped_collectors"))
    centre = spark.createDataFrame([("a",) * 5], "name string, city string, state string, country string, address string")
    assert "lambda" not in plan(centre.select(generate_queries()))


def test_reference_point_without_a_sort(spark, sf001):
    """A centre's first point is the least of an order."""
    text = plan(entry.queries()["skipped_collectors"](spark, sf001))
    assert "min_by" in text and "first(" not in text


def test_strip_like_python(spark):
    texts = [chr(c) + "a" + chr(c) + "b" + chr(c) * 2 for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and (
        c < 0x3100 or c % 997 == 0 or chr(c).isspace())] + ["", " ", "  \x1c"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", py_strip("x").alias("s")).collect()
    assert all(r.s == r.x.strip() for r in got)


def test_noise_words_like_python(spark):
    texts = ["The House of the Trade", "the", "the the of", "  An apple\tat  AT\nat", "theory often", "the\x00 of", "", " ", "A-the the-A", "İn ın in"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", strip_noise_words(F.col("x")).alias("s")).collect()
    assert all(r.s == " ".join(w for w in r.x.split() if w.lower() not in K.NOISE_WORDS) for r in got)
