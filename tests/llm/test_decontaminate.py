"""Edit matching against the plain dynamic programme over every item and document."""

import random
import re

from geoverity.llm import decontaminate as D


def best(item, text):
    """(distance, end) of the nearest substring, by dynamic programming."""
    row = list(range(len(item) + 1))
    out = (row[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[-1] + 1))
        row = new
        out = min(out, (row[-1], j))
    return out


def alone(item, text):
    """The item's words in the text, no word going on at either end."""
    edge = lambda c: r"(?<![^\W_])" if c.isalnum() else ""
    after = r"(?![^\W_])" if item[-1].isalnum() else ""
    return re.search(edge(item[0]) + re.escape(item) + after, text) is not None


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i:i + 1] = rng.choice([[], ["q"], [t[i], "z"]])
    return "".join(t)


def test_brute_force(spark, docs):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde é") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 22)))) for i in range(14)]
    rows = []
    for i in range(70):
        t = " ".join(word() for _ in range(rng.randint(0, 40)))
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items)[1]
            t += "  " + edited(rng, x.upper() if rng.random() < .3 else x, rng.randint(0, 9)) + "\n" + word()
        rows.append((i, t))
    rows += [(None, items[0][1]), (500, None), (501, ""), (502, items[1][1] * 400)] + rows[:5]
    extra = [(None, items[2][1]), (90, None), (91, ""), (92, "short"), (93, " New  Item"), (94, "?"), items[3]]
    rows += [(600, "a new\titem here"), (601, "NEW ITEM"), (602, "a renew item"), (603, "new items"), (604, "new item's end?")]
    want = []
    for i, t in rows:
        for k, x in items + extra:
            x = D.normal(x or "")
            if 0 < len(x) < D.MIN_CHARS and alone(x, D.normal(t or "")):
                want.append(str((i, k, 0)))
            elif len(x) >= D.MIN_CHARS and i != 502:
                d, _ = best(x, D.normal(t or ""))
                if d <= D.budget(len(x), 0.12):
                    want.append(str((i, k, d)))
    frame = spark.createDataFrame([(k, t, 1) for k, t in items + extra], "item_id long, text string, doc_id int")
    for block in (10**6, 300):
        got = D.leaks(docs(rows), frame, rate=0.12, block_chars=block).collect()
        assert sorted(str((r.doc_id, r.item_id, r.distance)) for r in got if r.doc_id != 502) == sorted(want)
        texts = {}
        for i, t in rows:
            texts.setdefault(i, t)
        for r in got:
            item = D.normal(dict(items + extra)[r.item_id] or "")
            part = D.normal(texts[r.doc_id][r.start:r.end])
            assert best(part, item)[0] <= r.distance or best(item, part)[0] == r.distance
    assert any(r.doc_id == 502 and r.n_places > 100 for r in got)
    assert D.leaks(docs([]), frame).count() == 0 and D.leaks(docs(rows), frame.limit(0)).count() == 0


def test_origins():
    for t in ("", " a  B\n c ", "İx  y", "é"):
        at = D.origins(t)
        assert len(at) == len(D.normal(t)) + 1
        assert "".join(D.lowered(t)[i] if not t[i].isspace() else " " for i in at[:-1]) == D.normal(t)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: D.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = [(r.doc_id, D.normal(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in D.op1_decontaminate(spark, sf).collect()}
    assert {(i, k) for i, t in rows for k, x in items.items() if x and x in t and (len(x) >= D.MIN_CHARS or alone(x, t))} <= got and got
