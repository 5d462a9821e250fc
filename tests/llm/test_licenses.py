"""License scan against brute force over every word offset."""

import math
import random
import re
from collections import Counter

import pytest

from geoverity.llm import licenses as L


def words_of(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]


def brute(text):
    words = words_of(text)
    places, base = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    best, labels = 0.0, set(base)
    for label, t in L.TEMPLATES:
        t = L.template_words(t)
        e = len(t) - math.ceil(len(t) * 0.8 - 1e-9)
        runs = -(-(len(t) - e) // (e + 1))  # an intact run has so many words
        k, least = (4, 1) if runs >= 4 else (2, min(3, len(t) - 1 - 2 * e))
        hits = Counter(i - j for i in range(len(words) - k + 1) for j in range(len(t) - k + 1) if words[i:i + k] == t[j:j + k])
        groups = []
        for d in sorted(hits):
            if groups and d - groups[-1][-1] <= L.SLACK:
                groups[-1].append(d)
            else:
                groups.append([d])
        groups = [g for g in groups if sum(hits[d] for d in g) >= least]
        for g in groups:
            ok = sum(any(0 <= i + d < len(words) and words[i + d] == w for d in range(g[0], g[-1] + 1)) for i, w in enumerate(t))
            best = max(best, ok / len(t))
            labels |= {label} if ok / len(t) >= L.MIN_MATCH else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), round(best, 9))


def rows_of(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
                  for r in frame.collect())


def test_brute_force(spark, docs):
    rng = random.Random(3)
    texts = [None, "", "CC BY", "cc-by! cc by cc by", "All rights reserved all rights\nreserved", "é General  Public License"]
    for label, t in L.TEMPLATES:
        w = t.split()
        texts.append("noise words before " + t + " and after")
        texts.append(" ".join(w[:6] + ["inserted"] + w[6:]) * 2)
        texts.append(" ".join(x for x in w if rng.random() > 0.2))
    texts.append("word " * 20000 + L.TEMPLATES[3][1])
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts + texts[:5])]
    key = lambda r: str(r)
    assert sorted(map(key, rows_of(L.scan(docs(rows))))) == sorted(key((str(i), *brute(t))) for i, t in rows)
    assert L.scan(docs([])).count() == 0


def test_share_of_words_is_enough(spark, docs):
    """A template with any allowed number of words replaced gets its label, wherever they stand."""
    rng, rows, want = random.Random(8), [(0, "Released under an MIT License")], {0: "mit"}
    templates = L.TEMPLATES + [("three", "strictly private work"), ("two", "ask first")]
    for i in range(1, 200):
        label, t = templates[i % len(templates)]
        w = L.template_words(t)
        for at in rng.sample(range(len(w)), int(len(w) * 0.2 + 1e-9)):
            w[at] = f"new{at}"
        rows.append((i, "before it " + " ".join(w) + " after it"))
        want[i] = label
    got = {r.doc_id: r.labels.split(",") for r in L.scan(docs(rows), templates=templates).collect()}
    assert all(label in got[i] for i, label in want.items())
    with pytest.raises(ValueError):
        L.gram_size(1)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows_of(L.op8_license_scan(spark, sf))
    assert sorted(map(str, got)) == sorted(str((str(i), *brute(t))) for i, t in rows)
