"""Top-k search against brute force over all pairs."""

import math

import numpy as np
import pytest

from geoverity.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, score double, rank int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "clash", 1.0, 2) for i, v in rows], SCHEMA)


def brute(rows, k, every):
    fit = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
           if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in fit:
        if i is None or i % every:
            continue
        hits = sorted(((-sum(a * b for a, b in zip(q, x)), math.inf if j is None else j) for j, x in fit if j != i))[:k]
        out += [(i, r, None if j == math.inf else j, -s) for r, (s, j) in enumerate(hits, 1)]
    return sorted(map(str, out))


def check(spark, rows, k=5, every=50, **more):
    got = T.top_k(table_of(spark, rows), k, every, **more)
    assert got.columns == ["query", "rank", "vec_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, k, every)


def made(seed, n, dim, spread=1.0, centres=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 3
    return [(i, [float(v) for v in c[rng.integers(centres)] + spread * rng.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("dim, spread, centres", [(16, 1.0, 1), (8, .05, 12), (1, .5, 3)])
def test_brute_force(spark, dim, spread, centres):
    check(spark, made(dim, 1500, dim, spread, centres), every=7)


def test_blocks_of_queries_and_few_pivots(spark):
    check(spark, made(4, 900, 4, .2, 5), every=3, query_bytes=48 * 40, pivots=2)


def test_ties_and_copies(spark):
    rows = made(5, 200, 3) + [(i, [.5, .25, -.5]) for i in range(1000, 4500)] + [(i, [0.0] * 3) for i in range(5000, 5300)]
    check(spark, rows)


def test_edges(spark):
    rows = made(6, 80, 3) + [(100, None), (150, []), (200, [1.0, None, 2.0]), (250, [float("nan")] * 3), (300, [float("inf"), 0.0, 0.0]),
                             (350, [1.0, 2.0]), (400, [1.0, 2.0, 3.0, 4.0]), (None, [9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0]),
                             (0, [5.0, -5.0, 5.0]), (0, [5.0, -5.0, 5.0]), (-50, [1.0, 1.0, 1.0]), (450, [-1e5, 1e5, 3.0])]
    check(spark, rows)


def test_few_rows(spark):
    check(spark, [(50, [1.0, 2.0])])
    check(spark, [(50, [1.0, 2.0]), (51, [2.0, 1.0]), (52, None)])
    check(spark, [(50, []), (51, [])])


def test_empty_table(spark):
    assert T.top_k(table_of(spark, [])).collect() == []
    assert T.top_k(table_of(spark, [(50, None)])).collect() == []
    assert T.top_k(table_of(spark, [(1, [1.0]), (None, [2.0])])).collect() == []


def rings_of(x, space, size):
    far = space.distances(x, space.pivots)
    pivot, out = far.argmin(axis=1), {}
    for p in np.unique(pivot):
        mine = np.flatnonzero(pivot == p)
        mine = mine[far[mine, p].argsort(kind="stable")]
        for at in range(0, len(mine), size):
            part = mine[at:at + size]
            out.setdefault(int(p), []).append(T.Annulus(int(p), far[part[0], p], far[part[-1], p], part, x[part]))
    return out


def test_bounds_leave_out_annuli():
    """Around well separated centres most annuli are left out, and nothing is lost."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 6)) * 300
    x = np.floor(centres[rng.integers(20, size=4000)] + rng.normal(size=(4000, 6)) * 8).astype(np.int64)
    space = T.Space(x[:200], int((x * x).sum(axis=1).max()), 20)
    q, own = x[:40], np.arange(40)
    best, far, visits, total = T.Best(40, 5), space.query_distances(q), 0, 0
    rings = rings_of(x, space, 50)
    for p in sorted(rings, key=lambda p: np.median(far[:, p])):
        visits += T.expand(rings[p], far[:, p], q, own, best, space)
        total += 40 * len(rings[p])
    scores = q @ x.T
    scores[own, own] = -2**62
    assert (best.score == np.sort(scores, axis=1)[:, ::-1][:, :5]).all()
    assert visits < total / 2


def test_lifted_distances_follow_scores():
    x = np.random.default_rng(8).integers(-500, 500, size=(50, 7))
    space = T.Space(x, int((x * x).sum(axis=1).max()), 50)
    d2 = space.query_distances(x) ** 2
    want = (x * x).sum(axis=1)[:, None] + space.most - 2 * (x @ space.pivots.T)
    assert np.allclose(d2, want)
