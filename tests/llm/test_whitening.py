"""Whitening against exact arithmetic on Python integers."""

import math
import random

import numpy as np
import pytest

from geoverity.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, key string, k int, w double, component string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 1, 0.0, "c") for i, v in rows], SCHEMA)


def brute(rows, dim):
    fit = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows
           if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    n = len(fit)
    total = [sum(x[k] for _, x in fit) for k in range(dim)]
    dev = [(i, [n * x[k] - total[k] for k in range(dim)]) for i, x in fit]
    v = np.array([[sum(d[a] * d[b] for _, d in dev) / n**3 for b in range(dim)] for a in range(dim)])
    return n, dev, v


def check(spark, rows, dim, components=8):
    got = W.whiten(table_of(spark, rows), components=components)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    n, dev, v = brute(rows, dim)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    count = min(components, dim)
    assert len(got) == n * count and {r.n for r in got} == {n}
    exact = sorted((str(i), sum(x * x for x in d)) for i, d in dev for _ in range(count))
    assert sorted((str(r.vec_id), r.deviation) for r in got) == exact
    for c in range(1, count + 1):
        rows_c = [r for r in got if r.component == c]
        assert all(abs(r.explained - e[c - 1] / np.trace(v)) <= 1e-9 for r in rows_c)
        mine = sorted(abs(r.whitened) for r in rows_c)
        want = sorted(abs(np.dot([x / n for x in d], w[:, c - 1])) / math.sqrt(e[c - 1]) for _, d in dev)
        assert np.allclose(mine, want, rtol=1e-6, atol=1e-6)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8
    return got


def made(seed, n, dim):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dim)) * np.geomspace(1, .05, dim)) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    return [(i, [float(c) for c in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("dim", [3, 8, 17])
def test_brute_force(spark, dim):
    check(spark, made(dim, 300, dim), dim)


def test_edges(spark):
    rows = made(1, 200, 4) + [(500, None), (501, []), (502, [1.0, None, 2.0, 3.0]), (503, [1.0, float("nan"), 0.0, 0.0]),
                              (504, [float("inf"), 0.0, 0.0, 0.0]), (505, [1.0, 2.0]), (None, [.5, .5, -.5, .5]),
                              (7, [.1, .2, .3, .4]), (7, [.1, .2, .3, .4]), (508, [-300.0, 900.0, 12345.678, 2.0])]
    check(spark, rows, 4)


def test_repeated_vectors(spark):
    check(spark, made(2, 30, 3) + [(i, [.25, -.5, .75]) for i in range(100, 400)], 3)


def test_no_variance(spark):
    got = W.whiten(table_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in got)
    flat = W.whiten(table_of(spark, [(i, [float(i), 5.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9


def test_empty_table(spark):
    assert W.whiten(table_of(spark, [])).collect() == []
    assert W.whiten(table_of(spark, [(1, None), (2, [float("nan")])])).collect() == []


def test_wide_entries(spark):
    """Entries so large that a deviation passes a long; products beyond 64 bits stay exact."""
    rows = [(i, [random.Random(i).uniform(-1e12, 1e12), float(i)]) for i in range(60)]
    got = {r.vec_id: r for r in W.whiten(table_of(spark, rows)).collect() if r.component == 1}
    n, dev, v = brute(rows, 2)
    for i, d in dev:
        exact = sum(x * x for x in d)
        assert got[i].deviation == (exact if exact < 2**63 else None)
    assert abs(got[0].explained - np.linalg.eigvalsh(v)[1] / np.trace(v)) < 1e-9


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(3)
    for high in (1, 2, 5000, 2**40):
        y = rng.integers(0, high, size=(131, 5))
        products, sums = W.cross_products(y)
        z = y.astype(object)
        assert (products == np.triu(z.T @ z)).all() and (sums == z.sum(axis=0)).all()


def test_deviation_near_the_limit():
    half = math.isqrt(2**62)
    dev = np.array([[half, half], [half, half - 1], [2**40, 0], [3, 4]], np.int64)
    assert W.exact_deviation(dev).tolist() == [None, half**2 + (half - 1) ** 2, None, 25]


def test_tables_of_large_scale_have_no_cap(spark):
    """More rows than a slice, in one task: slices add up exactly."""
    x = np.random.default_rng(9).normal(size=(20_000, 2)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    z = np.floor(1024 * x.astype(float)).astype(np.int64) + 100000
    got = {(r.i, r.j): int(r.value) for r in W.scatter(df, "embedding", 2).collect()}
    assert got == {(-1, -1): 20_000, (0, -1): z[:, 0].sum(), (1, -1): z[:, 1].sum(), (0, 0): (z[:, 0] ** 2).sum(),
                   (0, 1): (z[:, 0] * z[:, 1]).sum(), (1, 1): (z[:, 1] ** 2).sum()}
