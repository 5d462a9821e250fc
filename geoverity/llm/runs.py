"""Runs of fixed-length windows that share a winnowing anchor.

Of the ``window - gram + 1`` grams of a window the one with the smallest hash is
its anchor (the rightmost of equals). The choice depends on the window's content
alone, so equal windows, wherever they stand, have equal anchors. Consecutive
windows with one anchor form a run; there are about ``2 / (window - gram + 2)``
runs per position. So (1) a window can repeat only if its anchor's hash repeats,
and (2) equal runs (same units from the first window's start to the last one's
end) hold pairwise equal windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, MAX_BLOOM_BYTES, NULL_KEY, Rolling, bloom_of, freed, landed, mix64, sliced

_LOW = np.uint64(0xFFFF)
_SEGMENT = 1 << 15


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the anchor of every ``width`` consecutive grams (by start)."""
    total = len(grams) - width + 1
    out = np.empty(total, np.int64)
    for at in range(0, total, _SEGMENT):
        part = grams[at:at + _SEGMENT + width - 1]
        count = len(part) - width + 1
        key = (part & ~_LOW) | (_LOW - np.arange(len(part), dtype=np.uint64))
        blocks = -(-len(key) // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(key)] = key
        table = padded.reshape(blocks, width)
        head = np.minimum.accumulate(table, axis=1).ravel()
        tail = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(tail[:count], head[width - 1:width - 1 + count])
        out[at:at + count] = at + (_LOW - (low & _LOW)).astype(np.int64)
    return out


def runs_of(units: np.ndarray, size: np.ndarray, window: int, gram: int, named: bool = True) -> tuple[np.ndarray, ...]:
    """(anchor hash, run hash, sequence, first window start, number of windows) of every run; without ``named``
    the run hashes are left out (the anchor's stands there again).

    ``units``: a well mixed uint64 per position, of sequences of ``size`` positions end to end; no window
    spans two sequences.
    """
    if len(units) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = Rolling(units, BASES[0]).fixed(gram)
    at = anchors(grams, window - gram + 1)
    owner = np.repeat(np.arange(len(size)), size)[:len(at)]
    offset = np.cumsum(size) - size
    valid = np.arange(len(at)) - offset[owner] <= size[owner] - window
    turn = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(valid & np.r_[True, turn | ~valid[:-1]])
    last = np.flatnonzero(valid & np.r_[turn | ~valid[1:], True])
    mine = owner[start]
    anchor = grams[at[start]].view(np.int64)
    # the run's hash has another base, so that the two are independent
    run = Rolling(units, BASES[1]).spans(start, last + window).view(np.int64) if named else anchor
    return anchor, run, mine, start - offset[mine], last - start + 1


BYTE_UNITS = mix64(np.arange(256, dtype=np.uint64))


# --- in Spark ---------------------------------------------------------------

RUN_SCHEMA = "g bigint, s bigint, id bigint, th bigint, p0 int, n int"


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, id, th, text): a null key sorts last; th (64 bits) tells apart rows that share a key."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.col(f"`{id_col}`")
    return df.select(key.alias("_id"), F.coalesce(key.cast("long"), F.lit(NULL_KEY)).alias("id"),
                     F.xxhash64(text).alias("th"), text.alias("text"))


#: Turns some payloads (texts, byte strings) into their units, end to end, and the number of each.
Units = Callable[[list], tuple[np.ndarray, np.ndarray]]


def whole_texts(docs: DataFrame) -> DataFrame:
    """(id, th, p0, data): the sequences of whole documents."""
    return docs.select("id", "th", F.lit(0).alias("p0"), F.col("text").alias("data"))


def run_rows(rows: DataFrame, units: Units, window: int, gram: int, bloom: Broadcast | None = None) -> DataFrame:
    """The runs of sequences (id, th, p0, data), ``p0`` the place of the first unit in its document; with a Bloom
    filter only those whose anchor may be in it."""
    names = ["g", "s", "id", "th", "p0", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            ids, ths, p0 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            g, s, mine, start, n = runs_of(*units(batch.column(3).to_pylist()), window, gram)
            if bloom is not None:
                keep = bloom.value.has(g)
                g, s, mine, start, n = g[keep], s[keep], mine[keep], start[keep], n[keep]
            if len(g):
                columns = (g, s, ids[mine], ths[mine], (p0[mine] + start).astype(np.int32), n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows.select("id", "th", "p0", "data").mapInArrow(run, RUN_SCHEMA)


def anchor_rows(rows: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """(g, id): the anchor of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            g, _, mine, _, _ = runs_of(*units(batch.column(1).to_pylist()), window, gram, named=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(ids[mine])], ["g", "id"])

    return rows.select("id", "data").mapInArrow(run, "g bigint, id bigint")


def shared_runs(sequences: DataFrame, units: Units, window: int, gram: int,
                across_only: bool, max_bloom: int = MAX_BLOOM_BYTES) -> DataFrame:
    """Runs whose anchor stands in two places (``across_only``: of two different keys).

    Lossless: a window that repeats has an anchor that repeats. False hits of the
    Bloom filter only add runs that match nothing.
    """
    rows = anchor_rows(sequences, units, window, gram)
    if across_only:
        seen = rows.groupBy("g").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    else:
        seen = rows.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    names = landed(seen.select("g"))
    bloom = bloom_of(names, max_bloom)
    if bloom is None:
        return landed(run_rows(sequences, units, window, gram).join(names, "g", "left_semi"))
    freed(names)
    return landed(run_rows(sequences, units, window, gram, sequences.sparkSession.sparkContext.broadcast(bloom)))
