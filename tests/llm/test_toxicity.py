"""Toxicity: shared-backoff models by hand, held-out accuracy, edge rows."""

import random
import zlib

import numpy as np
import pandas as pd

from geoverity.llm import toxicity as X


def test_positions_and_hashes():
    points, start, at, word, until = X.positions(["Ab  c", "", "é"])
    text = "".join(map(chr, points))
    grams = [text[a:b + 1] for a, b in zip(start, at)]
    assert grams == [" a", " ab", " ab ", " c", " c ", " é", " é "]
    assert word.tolist() == [0, 0, 0, 1, 1, 2, 2] and until.tolist() == [2, 2, 3]
    assert (X.hashes(points, start, at + 1) == X.hashes_of(grams)).all()


def test_probabilities_sum_to_one():
    """In each class and context the seen letters and the backoff share out all the mass."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(300)]
    grams = {}
    for i, w in enumerate(words):
        for j in range(2, len(w) + 3):
            g = f" {w} "[max(j - X.ORDER, 0):j]
            grams.setdefault(g, [0, 0])[i % 2] += 1
    f = pd.DataFrame([(g, *c) for g, c in grams.items()], columns=["gram", "t", "o"])
    f["total"] = f.t + f.o
    s = X.shared_backoff(f, 0.6)
    for n in range(0, X.ORDER - 2):
        by = s[s.index.str.len() == n + 1].groupby(lambda x: x[:-1]).sum()
        assert (by <= 1 + 1e-9).all() and (n or abs(by.iloc[0] - 1) < 1e-9)
    shared = s.reindex(f.gram.str[1:]).to_numpy()
    top, low = X.ratios(f, f.t.to_numpy(float), f.o.to_numpy(float), shared, 0.6)
    assert np.isfinite(top).all() and np.isfinite(low).all()
    swapped, _ = X.ratios(f, f.o.to_numpy(float), f.t.to_numpy(float), shared, 0.6)
    assert np.allclose(top, -swapped)


def test_lookup():
    keys = X.mix64(np.arange(5000, dtype=np.uint64))
    table = X.Lookup(keys[:3000], np.arange(3000, dtype=np.float32)[:, None])
    found = table.find(keys)
    assert found[:3000].tolist() == list(range(3000)) and (found[3000:] == -1).all()


def learnable(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [f"{rng.choice(['lo', 'ra', 'mi'])}{rng.choice(['te', 'nu', 'so'])}" for _ in range(rng.integers(5, 200))]
        if bad:
            for _ in range(2):
                w[rng.integers(len(w))] = f"vexo{rng.choice(list('abcdefgh'))}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, docs):
    rng = np.random.default_rng(1)
    rows, marks = learnable(rng, 400)
    extra = [(None, None), (None, "vexoa"), (900, ""), (901, "vexoz " * 20000)]
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (3, 0), (5000, 1)], "doc_id long, toxic int")
    got = X.score(docs(rows + extra + rows[:5]), labels, keep=("k",)).collect()
    assert len(got) == len(rows) + len(extra) + 5
    truth = dict(marks)
    seen = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.k == "clash"
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.doc_id is None or seen.setdefault(r.doc_id, r.score) == r.score
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert X.score(docs([]), labels).count() == 0
    none = X.score(docs(rows[:9]), labels.where("toxic = 0")).collect()
    assert all(r.score == 0 for r in none)


def test_held_out_labels_are_not_used(spark, docs):
    rng = np.random.default_rng(2)
    rows, marks = learnable(rng, 200)
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    a, b = (spark.createDataFrame([(i, y if not out(i) else other) for i, y in marks], "doc_id long, toxic int")
            for other in (0, 1))
    x, y = (sorted((r.doc_id, round(r.score, 12)) for r in X.score(docs(rows), m).collect()) for m in (a, b))
    assert x == y


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    got = X.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    held = [(r.toxic, r.predicted) for r in got.where("held_out").collect()]
    hit, wrong = held.count((1, 1)), held.count((0, 1))
    assert hit >= 0.5 * sum(t for t, _ in held) and wrong <= 0.01 * len(held)


def plain_model(texts, marks):
    """(ratios of all n-grams, of contexts) by the one-process version."""
    grams = {}
    for (_, t), (_, y) in zip(texts, marks):
        for w in t.lower().split():
            for j in range(2, len(w) + 3):
                grams.setdefault(f" {w} "[max(j - X.ORDER, 0):j], [0, 0])[1 - y] += 1
    f = pd.DataFrame([(g, *c) for g, c in grams.items()], columns=["gram", "t", "o"])
    f["total"] = f.t + f.o
    once, twice = (f.total == 1).sum(), (f.total == 2).sum()
    d = once / (once + 2 * twice)
    top, low = X.ratios(f, f.t.to_numpy(float), f.o.to_numpy(float), X.shared_backoff(f, d).reindex(f.gram.str[1:]).to_numpy(), d)
    return dict(zip(f.gram, top)), low.to_dict()


def test_no_ngram_is_left_out(spark, docs):
    """Over 250,000 distinct n-grams, most of them seen once: each still has its own ratio; broadcast or joined."""
    rng = np.random.default_rng(6)
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [(i, " ".join("".join(letters[rng.integers(0, 26, 9)]) for _ in range(220))) for i in learnt]
    marks = [(i, int(k % 4 == 0)) for k, i in enumerate(learnt)]
    top, low = plain_model(texts, marks)
    assert len(top) > 250_000
    asked = [(10_000 + k, t.split()[k]) for k, (_, t) in enumerate(texts[:120])] + [(20_000, "zq%x é"), (20_001, "")]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    whole = docs(texts + asked + asked[:2])
    got = X.score(whole, labels).collect()
    by = {r.doc_id: r.ratio for r in got}
    for i, t in asked:
        spots = [f" {w} "[max(j - X.ORDER, 0):j] for w in t.split() for j in range(2, len(w) + 3)]
        want = sum(top.get(g, low.get(g[:-1], 0.0)) for g in spots) / max(1, len(spots))
        assert abs(by[i] - want) < 1e-5, (i, by[i], want)
    joined = X.score(whole, labels, max_grams=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))


def test_rare_toxic_rows_are_in_the_fit(spark, docs, monkeypatch):
    """Where toxic rows are fewer than one in a sample, the sample takes them all and the model stays."""
    from geoverity.llm import toxicity as T
    monkeypatch.setattr(T, "MAX_FIT", 24)
    rng = random.Random(3)
    calm = "the river runs slowly past green fields and old stone houses in warm light".split()
    harsh = "vile grunk zorvath"
    rows = [(i, " ".join(rng.choices(calm, k=25)) + (f" {harsh} {harsh}" if i % 100 == 0 else "")) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.score(docs(rows), labels).collect()}
    assert min(got[i] for i in range(0, 900, 100)) > max(got[i] for i in range(900) if i % 100)


def test_shares_of_the_classes():
    from geoverity.llm.toxicity import fit_shares
    assert fit_shares(5, 10, 20) == (1.0, 1.0) and fit_shares(0, 100, 20) == (1.0, .2) and fit_shares(100, 0, 20)[0] == .1
    assert fit_shares(3, 1000, 20) == (1.0, 17 / 1000) and fit_shares(1000, 1000, 20) == (.01, .01) and fit_shares(1000, 4, 20) == (.01, 1.0)
