"""Benchmark: time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is fully executed by writing its result to Spark's no-op sink
(``format("noop")``), so nothing is collected to the driver. Prints one JSON
line: ``{"metric", "value", "unit", "queries", "sf", ...}``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from geoverity.operators.candidates import candidates_all_providers, first_successful_query  # noqa: E402
from geoverity.plans import catalog, inputs  # noqa: E402,F401
from geoverity.plans.registry import QUERIES  # noqa: E402
from geoverity.session import build_session  # noqa: E402

WARMUP_SF = "/root/testdata/sf0.001"

HEADLINE = [
    "geocode_centres",      # flagship: full verification + best match, all centres
    "decide_all",           # per-candidate decisions
    "provider_consensus",
    "fusion_geography",
    "validate_centres",
    "merge_dataset",
    "change_log",
    "url_query_params",
    "gazetteer_search",
    "cache_upsert",
]
#: Timed as well, but not part of the total, which stays comparable between versions.
MORE = ["normalize_records", "scan_json_files", "scan_csv_files", "cluster_center"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session()
    # one pass of the flagship over the smallest tables starts the Python
    # workers and warms the JIT; its time is reported separately
    t0 = time.time()
    QUERIES["geocode_centres"](spark, WARMUP_SF).write.format("noop").mode("overwrite").save()
    warmup = round(time.time() - t0, 3)
    times: dict[str, float] = {}
    for name in HEADLINE + MORE:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(t for name, t in times.items() if name in HEADLINE), 3)
    # throughput of the flagship: verified candidates per second
    # (candidates of each centre's first successful query, top five per provider)
    n_cands = first_successful_query(candidates_all_providers(inputs.candidates(spark, sf))).count()
    flag = times.get("geocode_centres")
    print(json.dumps({
        "metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
        "flagship_candidates_per_sec": round(n_cands / flag, 1) if flag else None,
        "warmup_sec": warmup,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
