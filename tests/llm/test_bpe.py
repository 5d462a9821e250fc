"""BPE against the tiktoken library: fuzzed texts, whole tables, exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from geoverity.llm import bpe

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_fuzz(reference):
    rng = random.Random(5)
    alphabet = ["'", " ", "\n", "s", "t", "r", "e", "v", "l", "d", "m", "a", "É", "7", "²", "!", "\t", " ",
                "　", "漢", "😀", "\x1c", "\x85", "́", "\0"]
    ranks = bpe.ranks_of(VOCABULARY)
    for _ in range(4000):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4)]
        assert [i.tolist() for i, _ in bpe.encode_many(texts, ranks)] == \
            [reference.encode_ordinary(t) for t in texts]


def test_long_slices(reference):
    ranks = bpe.ranks_of(VOCABULARY)
    for text in ("ab" * 30000, "é" * 5000 + " the" * 3000, " " * 9000 + "x", "=" * 333):
        ids, ends = next(bpe.encode_many([text], ranks))
        assert ids.tolist() == reference.encode_ordinary(text)
        assert ends[-1] == len(text.encode())
        assert bpe.decode(ids, ranks) == text.encode()


def test_operator_edge_rows(spark, docs, reference):
    rows = [(1, "Hello, it's 1999!\n\n  x"), (1, "Hello, it's 1999!\n\n  x"), (None, "a"), (2, None), (3, ""), (3, "ü b")]
    got = bpe.encode(docs(rows), VOCABULARY).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.decoded.decode()) for r in got) == sorted((str(i), t or "") for i, t in rows)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert ids.tolist() == reference.encode_ordinary(r.decoded.decode()) and len(ids) == r.n_tokens
        ends = np.frombuffer(bytes(r.ends), "<u4").tolist()
        assert [bytes(r.decoded)[a:b] for a, b in zip([0, *ends], ends)] == [bpe.ranks_of(VOCABULARY).token[i] for i in ids]
    assert bpe.encode(docs([]), VOCABULARY).count() == 0


def test_query(spark, reference):
    from geoverity.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op2_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
