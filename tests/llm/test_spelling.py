"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from geoverity.llm import spelling as S

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(rows, drop_every, least_length=6, least_count=5, ratio=5):
    count = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(str((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None)) for w, n in words.items())


def check(docs, rows, drop_every=3, **more):
    got = S.variants(docs(rows), drop_every=drop_every, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, drop_every, **more)
    return got


def made(rng, n):
    letters = "abcdeé÷ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7, 9]))) for _ in range(30)]
    weight = [rng.choice([1, 6, 40, 200]) for _ in base]
    out = []
    for i in range(n):
        words = []
        for w in rng.choices(base, weight, k=40):
            for _ in range(rng.choice([0] * 6 + [1, 2])):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice(letters)) + w[at + (kind < 2):]
            words.append(w.upper() if rng.random() < .1 else w)
        out.append((i, rng.choice([" ", "-", "\n"]).join(words)))
    return out


@pytest.mark.parametrize("drop_every", [0, 3])
def test_brute_force(docs, drop_every):
    check(docs, made(random.Random(5), 120), drop_every, least_count=2)


def test_edges(docs):
    long = "kettle kettel " * 20_000
    rows = [(1, None), (2, ""), (3, "× ÷ 123"), (None, "kettles " * 3), (None, "kettles " * 3), (4, long), (5, "Kettle" * 3),
            (6, "abcdef " * 5 + "abcdeg " * 25 + "abcdeh " * 25)]
    got = check(docs, rows)
    assert got.where("word = 'abcdef'").first().form == "abcdeg"  # a tie goes to the smallest


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, word string")
    assert S.variants(empty).collect() == []


def test_chain_of_forms(docs):
    rows = [(1, "abcdef " * 5 + "abcdeg " * 25 + "abcdhg " * 125 + "abcihg " * 625 + "abjihg " * 3125)]
    got = check(docs, rows, drop_every=0)
    assert {r.root for r in got.collect()} == {"abjihg"}


def test_near_words_share_a_signature():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9)))
        at, kind = rng.randrange(len(a)), rng.randrange(3)
        b = a[:at] + ("" if kind == 0 else rng.choice("abcdé")) + a[at + (kind < 2):]
        if not b or a == b:
            continue
        index, sig = S.signatures([a, b])
        assert np.intersect1d(sig[index == 0], sig[index == 1]).size


def test_crowded_signature_forms_few_pairs():
    """All orders of the same letters, which share every multiset: halves keep them apart."""
    from itertools import permutations
    words = ["".join(p) for p in permutations("abcdefg")]
    index, sig = S.signatures(words)
    _, size = np.unique(sig, return_counts=True)
    assert size.max() <= 24 and (size * (size - 1) // 2).sum() < 1500 * len(words)


def test_no_table_of_words_is_broadcast(docs, monkeypatch):
    """signatures and words grow with the corpus, and their files and rows tell Spark too small a size."""
    plans, landed = [], S.landed

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(S, "landed", lambda df, *more: landed(planned(df), *more))
    planned(S.variants(docs(made(random.Random(5), 60)), drop_every=3, least_count=2))
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 4 and not any("Broadcast" in p for p in joins)
