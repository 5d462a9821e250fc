"""Cluster centres against all pairs; crowded places without a table of their pairs."""

import math
import random

from geoverity.operators import cluster as C
from geoverity.operators.evidence import cluster_centre


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def check(spark, groups, t=5.0, **more):
    rows = [(k, i, *p) for k, points in groups.items() for i, p in enumerate(points, 1)]
    df = spark.createDataFrame(rows, "pos long, cand_pos long, latitude double, longitude double")
    got = {(r.k, r.i): r.n_near for r in C.neighbours(df, "pos", "cand_pos", t, **more).collect()}
    for k, points in groups.items():
        count = lambda p: sum(km(p, q) <= t for q in points if None not in q) - 1 if None not in p else 0
        first = {}
        for i, p in enumerate(points, 1):
            first.setdefault(p if None not in p else i, (i, count(p)))
        assert {i: n for (g, i), n in got.items() if g == k} == dict(first.values()), k
    best = {r.pos: (r.center_lat, r.center_lon, r.neighbours) for r in cluster_centre(df, threshold_km=t).collect()}
    for k, points in groups.items():
        n = [got.get((k, i), -1) for i in range(1, len(points) + 1)]
        at = n.index(max(n))
        assert best[k] == (*points[at], n[at])


def around(rng, lat, lon, n, spread):
    return [(min(90.0, max(-90.0, lat + rng.gauss(0, spread))), lon + rng.gauss(0, spread / max(.02, math.cos(math.radians(lat)))))
            for _ in range(n)]


def test_all_pairs(spark):
    rng = random.Random(1)
    groups = {0: around(rng, 12, 77, 150, .04), 1: around(rng, 0, 0, 60, .05), 2: around(rng, 51, 180, 80, .05),
              3: around(rng, 89.97, 10, 60, .02), 4: around(rng, -89.99, -170, 40, .01), 5: [(1.0, 2.0)],
              6: [(3.0, 4.0)] * 40 + [(3.0, 4.01)] * 7 + [(None, 4.0), (3.0, None)], 7: [(None, None)],
              8: around(rng, 60, -180, 50, .3) + around(rng, 60, 180, 50, .3)}
    check(spark, groups, max_pairs=64)


def test_few_pairs_in_crowded_places(spark, monkeypatch):
    """Thousands of points around one place: what is compared point by point stays far from all pairs."""
    rng = random.Random(2)
    points = around(rng, 20, 70, 1500, .03) + [(20.0, 70.0)] * 300
    compared = []
    plain = C._tested

    def counted(points_, pairs, t):
        compared.append(pairs.selectExpr("coalesce(sum(pa * pb), 0) AS n").first().n)
        return plain(points_, pairs, t)

    monkeypatch.setattr(C, "_tested", counted)
    check(spark, {0: points})
    # two runs; all pairs of the 1,501 places would be over 2,250,000 each
    assert sum(compared) / 2 < 500_000
