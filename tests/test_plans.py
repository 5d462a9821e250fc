"""Physical-plan guards for scale: no registered query plans a cross product or
a nested-loop join, and the flagship limits candidates map-side before its
shuffle. Planning only -- nothing is executed."""

import __spark_entry__ as entry
from geoverity.plans.registry import QUERIES

# these run actions while being built (round loop, first-row planning, streams)
EAGER = {"validate_centres", "validation_summary", "failed_report", "summary_metrics", "summary_report_md",
         "stream_ingest_landed", "stream_ingest_changes", "apply_schema", "save_transformed", "infer_schema_map",
         "raw_path_support", "scan_json_files", "scan_csv_files", "retrieve_candidates", "cache_write_back", "geocode_by_query",
         "cluster_center"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_or_nested_loop_joins(spark, sf001):
    bad = {}
    for name, fn in entry.queries().items():
        if name in EAGER or name not in QUERIES:
            continue
        plan = _plan(fn(spark, sf001))
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_flagship_limits_candidates_before_shuffle(spark, sf001):
    plan = _plan(entry.queries()["geocode_centres"](spark, sf001))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    # one Arrow stage for all string-similarity UDFs
    assert plan.count("ArrowEvalPython") == 1


def test_single_row_results_have_no_join(spark, sf001):
    assert entry.queries()["update_summary"](spark, sf001).count() == 1


def test_normalisation_plan_stays_small(spark):
    """No expression is copied into others: the analysed plan of one record's normalisation has a bounded text."""
    from geoverity.operators.normalize import normalize_records
    from geoverity.sources.records import json_records
    docs = spark.createDataFrame([(1, '[{"name": "A"}]')], "doc_id long, text string")
    plan = normalize_records(json_records(docs), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000
