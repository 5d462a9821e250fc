"""Helpers shared by the training-data operators.

Input convention of every operator: a DataFrame with a key column and a text
column, named by parameters. Only these are carried through the work, under
private names, so extra columns of any name never clash. A null text counts as
empty. Rows are told apart by (key, hash of the text), so repeated rows get the
same result each and rows that share a key but not the text stay separate. A
null key sorts after every other key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Sort key of a null document key: after every other.
NULL_KEY = 2**63 - 1

#: Multipliers of the splitmix64 finaliser and of the rolling hashes (odd, so invertible mod 2**64).
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_col(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array, with built-in functions only."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only (no other letters, as the contracts ask)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sliced(batches: Iterable[pa.RecordBatch], column: int, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of a text or binary column (a longer value is a slice by
    itself), so that a task's memory does not hang on how many rows the session puts into a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(length) - length
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(before, before[at] + size)))
            yield batch.slice(at, end - at)
            at = end


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the folder all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over a uint64 array."""
    x = (x + _GOLD).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes of fixed-length or arbitrary windows over a uint64 sequence.

    ``sum(x[j] * base**j)`` is kept as a wrapping prefix sum; a window is the
    difference of two prefix sums divided by ``base**start``.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values)
        up, down = self._grown(base, n + 1)
        self.down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    @classmethod
    def _grown(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._powers or len(cls._powers[base][0]) < n:
            size = max(1 << 14, 1 << (n - 1).bit_length())
            inverse = pow(base, -1, 2**64)
            cls._powers[base] = tuple(
                np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])
                for b in (base, inverse))
        return cls._powers[base]

    def fixed(self, k: int) -> np.ndarray:
        """Hashes of all windows of length ``k`` (by start)."""
        d = self.sums[k:] - self.sums[:-k] if k else self.sums
        return mix64(d * self.down[:len(d)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the windows ``[start, end)``; the length goes into the hash."""
        d = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(mix64(d) + (end - start).astype(np.uint64))



def landed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder of ``spark.checkpoint.dir``; in at most ``parts``
    parts, where the caller knows that the rows are few."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._landed_at = path
    return out


def freed(df: DataFrame) -> None:
    """Empty a landed table that no later step reads, so that the shared folder holds what is still needed."""
    if path := getattr(df, "_landed_at", None):
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


#: A Bloom filter is broadcast up to this size; beyond it the rows are joined by shuffle.
MAX_BLOOM_BYTES = 64 << 20
BITS_PER_KEY = 12
_BLOCK_BITS = 1 << 19


class Bloom:
    """Membership of int64 keys with about 0.5 % false hits; built from blocks in Spark tasks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words  # uint8, a power of two of blocks

    @staticmethod
    def places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each key, and its four bits there."""
        h = mix64(keys.view(np.uint64))
        block = (h >> np.uint64(40)).astype(np.int64) & (blocks - 1)
        g = mix64(h)
        bits = np.stack([(g >> np.uint64(16 * i)) for i in range(4)]) ^ (h << np.uint64(3))
        return block, (bits % np.uint64(_BLOCK_BITS)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        blocks = len(self.words) * 8 // _BLOCK_BITS
        block, bits = self.places(keys, blocks)
        hit = np.ones(len(keys), bool)
        for b in bits:
            at = block * _BLOCK_BITS + b
            hit &= (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return hit


def bloom_of(keys: DataFrame, max_bytes: int = MAX_BLOOM_BYTES) -> Bloom | None:
    """Bloom filter of a landed one-column (bigint) table; None if it would pass ``max_bytes``.

    The blocks are made in Spark tasks; what comes to the driver is the filter, of a size
    known from the count before it is made.
    """
    count = keys.count()
    blocks = 1 << max(0, (max(1, count * BITS_PER_KEY) - 1) // _BLOCK_BITS).bit_length()
    if blocks * _BLOCK_BITS // 8 > max_bytes:
        return None
    name = keys.columns[0]

    def number(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(Bloom.places(k, blocks)[0])], ["key", "block"])

    def fill(group: pa.Table) -> pa.Table:
        words = np.zeros(_BLOCK_BITS // 8, np.uint8)
        for bits in Bloom.places(group.column("key").to_numpy(), blocks)[1]:
            np.bitwise_or.at(words, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
        return pa.table({"block": group.column("block")[:1], "words": pa.array([words.tobytes()], pa.binary())})

    made = (keys.select(F.col(name)).mapInArrow(number, "key bigint, block bigint")
            .groupBy("block").applyInArrow(fill, "block bigint, words binary").collect())
    words = np.zeros(blocks * _BLOCK_BITS // 8, np.uint8)
    for r in made:
        at = r.block * _BLOCK_BITS // 8
        words[at:at + _BLOCK_BITS // 8] = np.frombuffer(bytes(r.words), np.uint8)
    return Bloom(words)
