"""Secret scan: fixed patterns by direct reading, the field by gradients, full Viterbi and planted cases."""

import hashlib
import random
import re

import numpy as np

from geoverity.llm import secrets as S


def plain_base(text):
    """The contract's patterns as written: match, then drop what fails."""
    word = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                          for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out = [(m.start(), 0, m.end()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
           if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans():
    rng = random.Random(0)
    parts = ["token", "TOKEN", "api_key", "apikey", "ſecret", "secret", "passwd", "password", "=", " : ", "\"", "'", "abc", "abcdef1",
             "AKIA", "AKIA" + "X" * 17, "0123456789abcdef" * 2, "é", " ", "\n", "a" * 23, "K"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert [x[:3] for x in S.base_spans(t)] == plain_base(t), t


def test_decode_is_viterbi():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = rng.integers(1, 40)
        texts = np.sort(rng.integers(0, 4, n))
        texts = np.unique(texts, return_inverse=True)[1]
        e = rng.normal(size=(n, 3)) * 2 + np.array([3, 0, 0])
        t = rng.normal(size=(3, 3))
        want = np.concatenate([S.viterbi(e[texts == k], t) for k in np.unique(texts)])
        assert (S.decode(e, t, texts) == want).all()


def test_training_finds_a_separating_model():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 6, 4))
    y = (x @ rng.normal(size=(4, 3))).argmax(axis=-1)
    mask = np.arange(6) < rng.integers(2, 7, 30)[:, None]
    w, t = S.train(x * mask[..., None], y * mask, mask)
    hit = [S.viterbi((x[i] @ w)[mask[i]], t) == y[i][mask[i]].tolist() for i in range(30)]
    assert np.mean(hit) > 0.8


def test_emissions_and_offsets():
    texts = ["a token = \"x1\" é", "", "key: Zz9"]
    raw, start, end, word_text, offset = S.layout(texts)
    w = np.random.default_rng(3).normal(size=(S.N_FEATURES, 3))
    assert np.allclose(S.features(raw, start, end, word_text) @ w, S.emissions(raw, start, end, word_text, w), atol=1e-4)
    assert [bytes(raw[a:b]).decode() for a, b in zip(start, end)] == [w for t in texts for w in t.split()]


def planted(rng, n):
    rows, hidden = [], {}
    for i in range(n):
        w = [rng.choice(["lorem", "ipsum", "Dolor,", "12", "sit."]) for _ in range(rng.randint(5, 60))]
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), f'token = "{value}"')
        elif i % 29 == 7:  # no fixed pattern finds this one
            value = "".join(rng.choice("0123456789ghkxyz") for _ in range(40))
            w.insert(rng.randrange(len(w)), f'pwd = "{value}"')
            hidden[i] = value
        rows.append((i, " ".join(w)))
    return rows, hidden


def test_operator(spark, docs):
    rng = random.Random(5)
    rows, hidden = planted(rng, 120)
    rows += [(None, None), (900, ""), (901, "é token=abcdef " + "x" * 5), (902, "lorem " * 30000 + 'token = "abcdef12"')]
    rows += rows[:4]
    got = S.scan(docs(rows), keep=("k",)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
        base = plain_base(dict(rows)[r.doc_id] or "")
        found = [(x.start, S.KINDS.index(x.kind), x.end) for x in r.found]
        assert [x for x in found if x[1] < 3] == base and r.k == "clash"
        assert r.n_crf == sum(x[1] == 3 for x in found)
    assert all(v not in by[i].redacted for i, v in hidden.items())
    clean = [i for i, t in rows if i is not None and i < 120 and i % 3 and i % 29 != 7]
    assert all(not by[i].found and by[i].redacted == dict(rows)[i] for i in clean)
    assert S.scan(docs([])).count() == 0
    assert S.scan(docs([(1, "only prose")])).collect()[0].found == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = S.op7_secret_scan(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id])
        named = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(named.split(",")) - {""} <= set(r.spans.split(","))


def test_rare_secrets_are_learnt_from(spark):
    """A few rows of 80,000 hold a secret, in the half that no hash share below one half takes, and past 200,000
    characters; many rows have a key word only."""
    from pyspark.sql import functions as F
    rng = random.Random(8)
    far = [(i, "lorem ipsum " * (20_000 if i % 2 else 3) + f'token = "{rng.getrandbits(160):040x}" dolor') for i in range(100_000, 100_012)]
    made = spark.createDataFrame(far, "_id long, _text string").where(F.pmod(F.xxhash64("_id", "_text"), F.lit(1_000_000)) >= 500_000)
    prose = spark.range(80_000).select(F.col("id").alias("_id"), F.concat(F.lit("the token of "), "id").alias("_text"))
    assert made.count()
    assert S.fitted(prose.union(made)) is not None
    one = spark.createDataFrame([(1, "lorem ipsum " * 20_000 + 'token = "abcdef12345" dolor'), (2, "lorem")], "_id long, _text string")
    assert S.fitted(one) is not None
    assert S.fitted(prose.limit(10)) is None
