"""Components against brute force over all pairs."""

import random
import re

import numpy as np

from geoverity.llm import near_dedup as N


def brute(rows, k):
    sets = []
    for _, t in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, inter in near.items():
            if 100 * inter >= 80 * (len(s) + len(sets[j]) - inter):
                parent[root(i)] = root(j)
    big = float("inf")
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), big), big if d is None else d)
    return sorted(str((d, len(sets[i]), None if low[root(i)] == big else low[root(i)],
                       low[root(i)] == (big if d is None else d))) for i, (d, _) in enumerate(rows))


def made(rng, n):
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([30, 80, 160]))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(x.upper() if rng.random() < .1 else x for x in w))
    return out


def check(spark, docs, rows, k, **more):
    got = N.components(docs(rows), k=k, **more)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, k)


def test_brute_force(spark, docs):
    rng = random.Random(4)
    rows = list(enumerate(made(rng, 200)))
    rows += [(None, None), (None, "a b"), (1000, "A b"), (1001, ""), (1002, "x"), (1003, " \n"), (1004, "x"),
             (1005, "same " * 9000), (1006, "same  " * 9000)]
    rows += rows[10:30]
    check(spark, docs, rows, 4)


def test_links_beside_the_hub_and_no_bloom(spark, docs):
    """Copies of copies, insertions and deletions: many links do not touch a bucket's hub."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(160):
        w = list(rng.choice(rows)[1].split()) if rows and rng.random() < .6 else list(base)
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(w))
            w[at:at + rng.choice([0, 1, 1, 3])] = rng.choice([[], [rng.choice(words)], [rng.choice(words)] * 2])
        rows.append((i, " ".join(w)))
    check(spark, docs, rows, 3, max_bloom=0)


def test_groups_around_two_texts(spark, docs, monkeypatch):
    """A smaller group beside a larger one, each text with an edit of its own: the hub of the larger group is no link of
    the smaller one, which gets a hub of its own. The pairs that are left to compare don't grow with the group's square."""
    rng = random.Random(12)
    far = [f"w{i}" for i in range(200)]
    near = [w if i < 158 else f"v{i}" for i, w in enumerate(far)]
    pairs = []
    plain = N.Finder.rest
    monkeypatch.setattr(N.Finder, "rest", lambda self, *a: (lambda out: (pairs.append(out.count()), out)[1])(plain(self, *a)))
    for n in (40, 80):
        rows = []
        for base, count in ((far, 3 * n), (near, n)):
            for _ in range(count):
                w = list(base)
                w[rng.randrange(200)] = f"e{len(rows)}"
                rows.append((len(rows), " ".join(w)))
        check(spark, docs, rows, 5)
        assert pairs[-1] <= 2 * n


def test_empty(spark, docs):
    assert N.components(docs([])).count() == 0
    check(spark, docs, [(1, None), (2, "")], 4)


def test_posterior_bounds():
    """The bound is the posterior under a uniform prior (numerical integration)."""
    x = (np.arange(200_000) + 0.5) / 200_000
    for batches, m in enumerate(N.least_matches(0.8, 1e-6), 1):
        n = batches * N.BATCH
        tail = lambda k: (lambda d: d[x >= 0.8].sum() / d.sum())(x**k * (1 - x) ** (n - k))
        assert tail(m) >= 1e-6 * 0.99 and (m == 0 or tail(m - 1) < 1e-6 * 1.01)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(str(tuple(r)) for r in N.op5_near_dedup(spark, sf).collect()) == brute(rows, 4)


def test_texts_of_one_key_with_equal_short_hashes(spark, docs):
    """Texts that share a key and a 32-bit hash are still two: neither goes, and neither loses what repeats in the other."""
    from pyspark.sql import functions as F

    from geoverity.llm import substring_dedup, suffix_dedup
    tail = " ".join(f"common{i}" for i in range(60))
    words = spark.range(600_000).select(F.concat(F.lit("only"), "id").alias("w"))
    alike = words.withColumn("h", F.hash("w")).groupBy("h").agg(F.sort_array(F.collect_list("w")).alias("w")).where("size(w) > 1")
    pairs = [r.w[:2] for r in alike.collect()]
    assert pairs
    rows = [(None, w) for p in pairs for w in p] + [(5, w) for w in pairs[0]]
    kept = N.dedup(docs(rows)).collect()
    assert sorted(r.text for r in kept) == sorted({w for p in pairs for w in p})
    # texts of many words
    long = spark.range(600_000).select(F.concat(F.lit("x"), "id", F.lit(" " + tail)).alias("w")).withColumn("h", F.hash("w"))
    a, b = long.groupBy("h").agg(F.sort_array(F.collect_list("w")).alias("w")).where("size(w) > 1").first().w[:2]
    whole = [(1, tail), (None, a), (None, b)]
    got = sorted(r.kept for r in substring_dedup.remove_repeats(docs(whole)).collect())
    assert got == sorted([tail, a.split()[0], b.split()[0]])
    assert suffix_dedup.remove_repeats(docs(whole)).count() == 3
