"""Provider consensus by chunks against a sequential model and the windowed form."""

import math
import random

from geoverity import constants as K
from geoverity.operators.consensus import provider_consensus
from geoverity.operators.evidence import provider_evidence


def km(a, b):
    h = (math.sin(math.radians(b[0] - a[0]) / 2) ** 2
         + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def model(points):
    """points: (provider, (lat, lon)) in order."""
    ref, groups = points[0][1], {}
    for name, at in points:
        groups.setdefault(name, []).append(at)
    agreeing, used = set(), []
    for name, ats in groups.items():
        for at in ats:
            used.append(at)
            if km(ref, at) <= 5.0:
                agreeing.add(name)
                break
    mean = [sum(p[i] for p in used) / len(used) for i in (0, 1)]
    spread = math.sqrt(sum((p[0] - mean[0]) ** 2 + (p[1] - mean[1]) ** 2 for p in used) / len(used)) if len(used) > 1 else 0.0
    ratio = len(agreeing) / len(groups)
    weight = sum(K.PROVIDER_WEIGHTS.get(n, 0.5) for n in groups) / len(groups)
    return (len(agreeing), len(groups), round(ratio, 9), round(spread, 7), round(weight, 9), len(groups) >= 2 and ratio < 0.5)


def lists(rng):
    names = ["nominatim", "photon", "geoapify", "mapbox", "elsewhere"]
    for pos in range(40):
        base = (rng.uniform(-60, 60), rng.uniform(-170, 170))
        yield pos, [(rng.choice(names), (base[0] + rng.choice([0, 0, .01, .3]) * rng.random(), base[1] + rng.choice([0, .02, 2])))
                    for _ in range(rng.choice([1, 2, 5, 60]))]


def rows_of(frame):
    return {r.pos: (r.provider_evidence.providers_agreeing, r.provider_evidence.providers_total,
                    round(r.provider_evidence.consensus_ratio, 9), round(r.provider_evidence.coordinate_variance, 7),
                    round(r.provider_evidence.mean_provider_weight, 9), r.provider_evidence.disagreement)
            for r in frame.collect()}


def test_against_model(spark):
    cases = dict(lists(random.Random(4)))
    rows = [(p, i, n, *at) for p, ps in cases.items() for i, (n, at) in enumerate(ps, 1)]
    df = spark.createDataFrame(rows, "pos long, cand_pos int, provider string, latitude double, longitude double")
    want = {p: model(ps) for p, ps in cases.items()}
    for chunk in (3, 10_000):
        assert rows_of(provider_consensus(df, chunk=chunk)) == want
    assert rows_of(provider_evidence(df)) == want
    assert provider_consensus(df.limit(0)).count() == 0


def test_nulls_and_weights(spark):
    df = spark.createDataFrame(
        [(1, 1, "photon", 1.0, 1.0), (1, 2, None, 1.0, 3.0), (1, None, "here", 1.0, 1.0), (None, 1, "here", 1.0, 1.0),
         (2, 1, "photon", None, None), (2, 2, "mapbox", 5.0, 5.0)],
        "pos long, cand_pos int, provider string, latitude double, longitude double")
    got = {r.pos: r for r in provider_consensus(df, chunk=2).collect()}
    one, two = got[1].provider_evidence, got[2].provider_evidence
    assert sorted(got) == [1, 2]
    assert (one.providers_agreeing, one.providers_total, one.coordinate_variance) == (1, 1, 1.0)
    assert got[1].provider_weights == {"photon": K.PROVIDER_WEIGHTS["photon"]}
    assert (two.providers_agreeing, two.providers_total, two.disagreement, two.coordinate_variance) == (0, 2, True, 0.0)


def test_no_window_holds_a_centre(spark):
    """Windows over rows are by chunk; those over a centre read the chunks' summaries."""
    df = spark.range(9).selectExpr("id % 2 AS pos", "id AS cand_pos", "'a' AS provider", "1D * id AS latitude", "2D AS longitude")
    plan = provider_consensus(df)._jdf.queryExecution()
    windows = [line for line in plan.optimizedPlan().toString().splitlines() if "Window [" in line]
    assert len(windows) == 3 and all("ch#" in w or "min_by" in w or "first_hit" in w for w in windows)
    assert "partial_min_by" in plan.executedPlan().toString()
