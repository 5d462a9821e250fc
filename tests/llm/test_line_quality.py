"""Base counts and line removal against brute force."""

import random
import re
from collections import Counter, defaultdict

from geoverity.llm import line_quality as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in Q.SYMBOLS), dup, len(covered))


def normal(line):
    line = "".join(c.lower() if c.isascii() else c for c in line)
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[1-9]", "0", line)).strip(" ")


def brute(rows, max_docs, max_share, max_removed):
    texts, holders = defaultdict(set), defaultdict(set)
    lines = lambda t: [x for x in (t or "").split("\n") if normal(x)]
    for i, t, host in rows:
        texts[host].add((i, t or ""))
        for x in lines(t):
            holders[host, normal(x)].add((i, t or ""))
    out = []
    for i, t, host in rows:
        n = base(t)
        lost = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines(t)
                   if (m := len(holders[host, normal(x)])) > max_docs and m > max_share * len(texts[host]))
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        out.append((i, *n, failed, not failed and lost <= max_removed * n[0], lost))
    return out


def test_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["aa", "b#", "Cc", "d1", "é|", "x", "&", "漢字"]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))), rng.choice(["a", "b", None]))
            for i in range(120)]
    rows += [(None, None, "a"), (5, "", None), (5, "", None), (7, "x y " * 4000, "a"), (8, " ".join(map(str, range(9000))), "a")]
    rows += rows[:9]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, line int, w int")
    got = Q.judge(df, max_docs=9, max_share=0.05, max_removed=0.4, with_text=True).collect()
    fields = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    assert sorted(str(tuple(r[f] for f in fields)) for r in got) == sorted(map(str, brute(rows, 9, 0.05, 0.4)))
    assert Q.judge(df.limit(0)).count() == 0
    removed = [r for r in got if r.n_removed_words]
    assert removed and all(len(r.cleaned.split()) == r.n_words - r.n_removed_words for r in removed)


def test_copies_are_documents(spark):
    """A text that stands often on a host reaches the limit; one document in repeated rows does not."""
    text = "word " * 30
    rows = [(i, text, "a") for i in range(30)] + [(1, "other " * 30, "b")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Q.judge(df.withColumnRenamed("text", "t"), text_col="t", max_docs=20, max_removed=0.5).collect()
    assert {r.n_removed_words for r in got if r.word_chars == 120} == {30}
    assert {r.n_removed_words for r in got if r.word_chars == 150} == {0}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Q.op10_line_quality(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(docs, Q.MAX_DOCS, Q.MAX_SHARE, Q.MAX_REMOVED))
