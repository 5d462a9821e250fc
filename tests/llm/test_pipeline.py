"""The pipeline against a brute-force version of each stage, and its stages on odd rows."""

import re

import numpy as np

import corpus_pipeline as C
from geoverity.llm import bpe, secrets, toxicity
from geoverity.llm import decontaminate as D

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def groups(rows, k=5):
    """Index of each row's group, by all pairs that share a shingle."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets, by = [], {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        s = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        near = {}
        for x in s:
            for j in by.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            by[x].append(i)
        for j, n in near.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        sets.append(s)
    return [root(i) for i in range(len(rows))]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    rows = sorted((i, t) for i, t in texts.items() if i not in toxic)
    low = {}
    for (i, _), g in zip(rows, groups(rows)):
        low[g] = min(low.get(g, i), i)
    rows = [(i, t) for i, t in rows if i in low.values()]
    items = [D.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaky = {i for i, t in rows if any(x in D.normal(t) for x in items)}
    got = {r.doc_id: r for r in C.run(spark, sf).collect()}
    # edits beyond the exact passages may only add leaks
    assert set(got) <= {i for i, _ in rows} - leaky
    blocks = D.Block(list(enumerate(items)), D.RATE)
    assert set(got) == {i for i, t in rows if not blocks.matches(D.normal(t))}
    ranks = bpe.ranks_of(bpe.default_vocabulary())
    for i, r in got.items():
        text = bpe.decode(np.frombuffer(bytes(r.ids), "<u4"), ranks).decode()
        assert r.n_tokens * 4 == len(r.ids) == len(r.ends)
        assert not secrets.base_spans(text) and (text == texts[i] or "[secret]" in text)


def test_stages_keep_columns_and_odd_rows(spark, docs):
    sf = "/root/testdata/sf0.001"
    rows = [(None, None), (None, "a b c"), (1, ""), (2, "x y z " * 20), (2, "x y z " * 20), (3, "x y z " * 20),
            (4, 'token = "abcdef0123"')]
    for make in (docs(rows), docs([])):
        part = make
        for name, stage in C.STAGES[:-1]:
            part = stage(spark, part, sf)
            assert part.columns == make.columns, name
        last = C.STAGES[-1][1](spark, part, sf)
        got = sorted(str(r.doc_id) for r in last.collect())
        assert got == (["1", "2", "4", "None", "None"] if make.count() else [])
    out = C.redact_secrets(spark, docs(rows), sf).where("doc_id = 4").first()
    assert out.text == '[secret]"' and out.n_chars == len(out.text) and out.k == "clash"
