"""Window removal against brute force over every window."""

import hashlib
import random

import pytest

from geoverity.llm import substring_dedup as S


def brute(rows, window):
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            x = tuple(w[p:p + window])
            first[x] = min(first.get(x, float("inf")), key(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < key(i):
                gone |= set(range(p, p + window))
        out.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def texts(rng, n):
    words = ["a", "bb", "ccc", "d,", "é", "x\t", "y\n"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 25))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
                 for _ in range(rng.randint(0, 6))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("max_bloom", [1 << 20, 0])
def test_brute_force(spark, docs, max_bloom):
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate(texts(rng, 150))]
    rows += [(None, None), (None, rows[3][1]), (7, rows[9][1]), (900, ""), (901, "same " * 3000), (902, "same " * 3000 + "end")]
    rows += rows[20:40]  # repeated rows
    rng.shuffle(rows)
    got = S.remove_repeats(docs(rows), window=8, gram=3, max_bloom=max_bloom).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, 8)
    for r in got:
        assert sum(x.end - x.start for x in r.intervals) == r.n_removed
    assert S.remove_repeats(docs([]), window=8, gram=3, max_bloom=max_bloom).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in S.op6_substring_dedup(spark, sf).collect())
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 50)]
    assert got == want and any(r[2] for r in got)
