"""Files read by byte ranges against Python's own readers; ranges are a few hundred bytes here."""

import csv
import io
import json
import os
import random
import tempfile
import uuid

import numpy as np
import pytest

from geoverity.sources import ranges as R


@pytest.fixture
def small_ranges(spark):
    """Splits files into ranges of about ``size`` bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield put
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def folder(texts):
    root = os.path.join(tempfile.mkdtemp(prefix="ranges-"), uuid.uuid4().hex)
    os.mkdir(root)
    for i, t in enumerate(texts):
        with open(f"{root}/f{i:03d}", "w", newline="") as f:
            f.write(t)
    return root


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(int(r.doc_id.rsplit("/f", 1)[1]), []).append((r.rec_pos, json.loads(r.record)))
    for rows in out.values():
        rows.sort()
        assert [p for p, _ in rows] == list(range(len(rows)))
    return {i: [x for _, x in rows] for i, rows in out.items()}


def csv_want(text):
    rows = []
    for row in csv.DictReader(io.StringIO(text, newline="")):
        row.pop(None, None)
        rows.append(dict(row))
    return rows


def csv_made(rng, n):
    names = ["name", "city", "note", "name"][:rng.choice([2, 3, 4])]
    out = io.StringIO(newline="")
    end = rng.choice(["\n", "\r\n"])
    w = csv.writer(out, lineterminator=end)
    w.writerow(names)
    word = lambda: "".join(rng.choice(['a', 'é', ' ', ',', '"', '\n', '\r\n', 'x' * 9, '😀']) for _ in range(rng.randrange(9)))
    for _ in range(n):
        if rng.random() < .05:
            out.write(end)
        elif rng.random() < .1:
            out.write('plain "quoted" here,"ab"cd' + end)
        else:
            w.writerow([word() for _ in range(rng.choice([len(names)] * 4 + [1, 5]))])
    return out.getvalue()


@pytest.mark.parametrize("size", [300, 900])
def test_csv_equals_dict_reader(spark, small_ranges, size):
    rng = random.Random(size)
    texts = [csv_made(rng, n) for n in (0, 1, 20, 60)] + ["", "a,b", "a,b\n", 'a,b\n\n1,2\n3', 'a,b\n1,"open\nto the end', '"un\nclosed']
    small_ranges(size)
    root = folder(texts)
    got = rows_of(R.csv_file_records(spark, root))
    for i, t in enumerate(texts):
        assert got.get(i, []) == csv_want(t), i


def test_csv_blank_lines_and_returns(spark):
    """Blank lines before the header are skipped; a lone carriage return ends a record."""
    got = rows_of(R.csv_file_records(spark, folder(["\n\r\na,b\n1,2", "a,b\r1,2\r\"x\ry\",3\n4,5"])))
    assert got == {0: [{"a": "1", "b": "2"}], 1: [{"a": "1", "b": "2"}, {"a": "x\ry", "b": "3"}, {"a": "4", "b": "5"}]}


def test_csv_record_over_many_ranges(spark, small_ranges):
    text = 'k,v\n1,"' + "line, of text\n" * 120 + '"\n2,b\n' + "3,c\n" * 50
    small_ranges(200)
    root = folder([text])
    lines = R.pieces(spark, root, "\n")
    assert lines.rdd.getNumPartitions() >= 10
    assert rows_of(R.csv_file_records(spark, root))[0] == csv_want(text)


def test_lines_from_either_state():
    for line, outside, inside in [(b'a,b', False, True), (b'a,"b', True, False), (b'"a""b",c', False, False),
                                  (b'a"b,c', False, False), (b'x",y', False, False), (b'x","y', True, True),
                                  (b'""', False, True), (b'"ab"cd"ef', False, False)]:
        assert (R.ends_inside(line, False), R.ends_inside(line, True)) == (outside, inside), line


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 2:
        return rng.choice([1, -2.5, True, None, "", "x"])
    if kind < 5:
        return "".join(rng.choice('ab,"\\[]{}: é😀') for _ in range(rng.randrange(12)))
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def document(rng, n):
    obj = lambda: {"name": value(rng, 2), "b,c": value(rng, 1)}
    table = lambda: [["h1", "h2", 3], *[[value(rng, 2) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(8))]]
    kind = rng.randrange(5)
    if kind == 0:
        return [obj() for _ in range(n)]
    if kind == 1:
        return [rng.choice([obj, obj, table, lambda: value(rng), list])() for _ in range(n)]
    if kind == 2:
        return {"meta": value(rng), "list": ["x", "y"], "data": [obj() for _ in range(n)], "more": [obj()]}
    if kind == 3:
        return {"a": value(rng, 2), "b": {"c": [1, 2]}, "t": [[1], [2]], "e": []}
    return [[["name", "city"], *[[f"n{i}", value(rng, 2)] for i in range(n)]]]


def json_want(text):
    """Records of a document as Python sees it."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    if isinstance(data, dict):
        lists = [v for v in data.values() if isinstance(v, list) and v and isinstance(v[0], dict)]
        if not lists:
            return [data]
        data = lists[0]
    out = []
    for item in data if isinstance(data, list) else []:
        if isinstance(item, dict):
            out.append(item)
        elif isinstance(item, list) and item and isinstance(item[0], list):
            keys = [k if isinstance(k, str) else json.dumps(k) for k in item[0]]
            out += [dict(zip(keys, row)) for row in item[1:]]
    return out


def test_json_equals_documents(spark, small_ranges):
    rng, size = random.Random(11), 500
    texts = [json.dumps(document(rng, rng.choice([0, 1, 5, 25])), ensure_ascii=rng.random() < .5, indent=rng.choice([None, None, 1]))
             for _ in range(20)]
    texts += ["", "5", "not json", "[1,2", '{"a": [{"b": 1}', '[{"a":1},]', '[{"a":1}] [2]', '[,{"a":1}]', "{}", "[]", " \n[ ] ",
              '[{"a":1}{"b":2}]', '{"k" 1}', "]", '[{"a": "\\\\"}, {"b": "\\""}]']
    small_ranges(size)
    got = rows_of(R.json_file_records(spark, folder(texts)))
    for i, t in enumerate(texts):
        assert got.get(i, []) == json_want(t), (i, t)


def test_json_table_over_many_ranges(spark, small_ranges):
    rows = [[f"name {i}", "x, [y] \"z\"" * (i % 3), i] for i in range(200)]
    text = json.dumps([[["name", "note", "n"], *rows], {"name": "last"}])
    small_ranges(600)
    root = folder([text])
    assert R.pieces(spark, root, ",").rdd.getNumPartitions() >= 10
    assert rows_of(R.json_file_records(spark, root))[0] == [dict(zip(["name", "note", "n"], r)) for r in rows] + [{"name": "last"}]


def test_summaries_compose():
    rng = random.Random(4)
    for _ in range(200):
        text = json.dumps(document(rng, 3), ensure_ascii=False).encode()
        cuts = sorted(rng.sample(range(len(text)), min(3, len(text))))
        cuts = [c for c in cuts if text[c - 1:c] != b"\\"]
        inside, whole = False, R.Structure()
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            d = np.frombuffer(text[a:b], np.uint8)
            whole = whole.then(R.structure(d, inside))
            inside = R.strings(d, inside)[1]
        assert (whole.pops, whole.pushed, inside) == (0, b"", False)
        assert +whole.commas == +R.structure(np.frombuffer(text, np.uint8), False).commas
