"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

Words of a text are hashed from its bytes, windows of words by a rolling hash.
Counting all windows would shuffle every one of them, so windows are counted in
two steps that lose none. Consecutive windows that share a winnowing anchor form
a run (``runs.py``): only runs whose anchor stands in two documents are counted,
first by the hash of the whole run, which stands for all its windows, and where
runs with one anchor differ, by the hash of each single window. Repeated windows
merge into maximal removal intervals of each document.

Order: a window is removed if its words also start in a document with a smaller
key. Rows that share a key never remove each other's words; a null key sorts last.
Null or empty text: no words, nothing removed. Empty table: empty result. Extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASES, MAX_BLOOM_BYTES, Rolling, landed, sliced, table
from .runs import BYTE_UNITS, keyed, shared_runs, whole_texts

WINDOW = 50
GRAM = 20  # words of an anchor

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of the words of UTF-8 bytes."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_SPACE[raw]
    turn = np.diff(solid)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and the number of words of each."""
    raws = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(raws), np.uint8)
    start, end = word_bounds(raw)
    until = np.cumsum([len(r) + 1 for r in raws])
    counts = np.diff(np.r_[0, np.searchsorted(start, until)])
    return Rolling(BYTE_UNITS[raw], BASES[0]).spans(start, end), counts


def window_rows(docs: DataFrame, places: DataFrame, units, window: int) -> DataFrame:
    """(h1, h2, id, th, p): both hashes of each single window of the runs in ``places``."""
    by_doc = places.groupBy("id", "th").agg(F.collect_list(F.struct("p0", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            parts = []
            ids, ths, texts, runs = (batch.column(k).to_pylist() for k in range(4))
            for i, th, text, spots in zip(ids, ths, texts, runs):
                u, _ = units([text])
                p = np.unique(np.concatenate([np.arange(r["p0"], r["p0"] + r["n"]) for r in spots]))
                parts.append((Rolling(u, BASES[0]).fixed(window)[p].view(np.int64),
                              Rolling(u, BASES[1]).fixed(window)[p].view(np.int64),
                              np.full(len(p), i, np.int64), np.full(len(p), th, np.int64), p.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)],
                                                 ["h1", "h2", "id", "th", "p"])

    joined = docs.join(by_doc, ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "th", "text", "runs")
    return joined.mapInArrow(run, "h1 bigint, h2 bigint, id bigint, th bigint, p int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                     max_bloom: int = MAX_BLOOM_BYTES) -> DataFrame:
    """(id, th, p0, n): runs of consecutive windows that stand in a document with a smaller key."""
    shared = shared_runs(whole_texts(docs), word_units, window, gram, True, max_bloom)
    classes = shared.groupBy("g", "s").agg(F.min("id").alias("first"))
    mixed = classes.groupBy(F.col("g").alias("m_g")).agg(F.count("*").alias("kinds")).where("kinds > 1")
    classes = classes.join(mixed, F.col("g") == F.col("m_g"), "left") \
        .select("g", "s", "first", F.col("kinds").isNotNull().alias("mixed"))
    members = shared.join(classes, ["g", "s"])
    whole = members.where("id > first").select("id", "th", "p0", "n")
    # first documents of runs that differ around one anchor: window by window
    single = landed(window_rows(docs, members.where("id = first AND mixed"), word_units, window))
    first = single.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    parts = single.join(first, ["h1", "h2"]).where("id > first").select("id", "th", F.col("p").alias("p0"), F.lit(1).alias("n"))
    return whole.union(parts)


def covered(spans: list[dict] | None, window: int, size: int) -> np.ndarray:
    """True for each unit inside one of the windows of the spans."""
    if not spans:
        return np.zeros(size, bool)
    edge = np.zeros(size + 1, np.int64)
    at = np.array([s["p0"] for s in spans])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + np.array([s["n"] for s in spans]) + (window - 1), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, digests: bool = False, max_bloom: int = MAX_BLOOM_BYTES) -> DataFrame:
    """One row per document: key, ``n_words``, ``n_removed``, and ``kept`` (words left, joined by a space)
    and ``intervals`` (maximal removed word intervals), or with ``digests`` the SHA-256 of ``kept``."""
    docs = keyed(df, id_col, text_col)
    spans = repeated_windows(docs, window, gram, max_bloom).groupBy("id", "th") \
        .agg(F.collect_list(F.struct("p0", "n")).alias("spans"))
    kind = docs.schema["_id"].dataType.simpleString()
    tail = "kept_sha256 string" if digests else "kept string, intervals array<struct<start:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            n, gone, kept, cuts = [], [], [], []
            for text, spots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split()
                out = covered(spots, window, len(words))
                n.append(len(words))
                gone.append(int(out.sum()))
                left = b" ".join([w for w, x in zip(words, out.tolist()) if not x] if gone[-1] else words)
                if digests:
                    kept.append(hashlib.sha256(left).hexdigest())
                else:
                    kept.append(left.decode())
                    turn = np.diff(np.r_[0, out.astype(np.int8), 0])
                    cuts.append([{"start": int(a), "end": int(b)} for a, b in
                                 zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256" if digests else "kept"]
            if not digests:
                columns.append(pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("intervals")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.join(spans, ["id", "th"], "left").select("_id", "text", "spans") \
        .mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, {tail}")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the 50-word windows that repeat across ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w) x),
least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT doc_id, list(i) AS g FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i
         FROM win JOIN least USING (h) WHERE doc_id > d) x GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(g), 0) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(g, i), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""
