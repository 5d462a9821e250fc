"""Embedding whitening with a bit-sliced scatter matrix.

Every entry c becomes the integer x = floor(1024 * c) + 100000. For a slice of rows, each dimension is shifted by its
least x there, and the bits of what is left are packed across the rows: plane b of dimension i is a row of 64-bit words
that hold bit b of that dimension. Cross-products are weighted counts of common bits,

    sum(y_i * y_j) = sum over planes b, c of 2**(b + c) * popcount(plane(i, b) & plane(j, c)),

so the scatter matrix is exact; the shift is added back in integers. Slices are summed in Spark as decimals. The centred
matrix n * sum(x_i * x_j) - S_i * S_j is formed in Python integers and divided once, before the eigenvectors are
computed; only it, as large as the square of the dimension, comes to the driver.

A row takes part if its vector is not null, has the table's dimension (the most frequent length above 0; the larger of
equals) and holds no null, NaN or infinite entry, nor one beyond ``MAX_ABS / 1024``. Rows that take part keep their key,
null or not; repeated rows count each. ``deviation`` is null where it would not fit a long. A component without variance
beyond rounding can't be whitened: its ``whitened`` is null and it stays out of ``identity_error`` (null if there is no
other); ``explained`` is null if no dimension varies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import landed, table

SCALE, OFFSET = 1024, 100_000
SLICE = 8192  # rows whose bits are packed at a time
MAX_ABS = 2.0**52
_LONG = 2.0**63


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, x): the rows of an array column that take part, and their integers."""
    length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = column.filter(pa.array(length == dim))
    entries = fit.flatten()
    c = entries.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = np.floor(SCALE * c)
    good = (np.abs(x) < MAX_ABS).all(axis=1)  # false for NaN
    return np.flatnonzero(length == dim)[good], x[good].astype(np.int64) + OFFSET


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of a (rows, dim) table of integers below 2**bits: (dim, bits, words), rows packed into words."""
    rows, dim = y.shape
    words = -(-rows // 64)
    out = np.zeros((dim, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> b) & 1).astype(np.uint8), axis=0).T
        out[:, b, :packed.shape[1]] = packed
    return out.view(np.uint64)


def cross_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum(y_i * y_j), sum(y_i)) of a (rows, dim) table of integers from 0 on, as Python integers. The lower half
    of the products is left at 0."""
    rows, dim = y.shape
    bits = max(1, int(y.max()).bit_length())
    sliced = planes(y, bits)
    kind = np.int64 if 2 * bits + rows.bit_length() < 63 else object
    weight = np.array([1 << b for b in range(bits)], kind)
    products = np.zeros((dim, dim), kind)
    for i in range(dim):
        rest = sliced[i:].reshape((dim - i) * bits, -1)
        for b in range(bits):
            common = np.bitwise_count(sliced[i, b] & rest).sum(axis=1, dtype=np.int64)
            products[i, i:] += (common.reshape(-1, bits).astype(kind) * weight).sum(axis=1) * weight[b]
    sums = (np.bitwise_count(sliced).sum(axis=2, dtype=np.int64).astype(kind) * weight).sum(axis=1)
    return products.astype(object), sums.astype(object)


def scatter(df: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """(i, j, value) of the rows that take part: sums of x_i * x_j for i <= j, sums of x_i at j = -1, the number of
    rows at (-1, -1). A task adds its slices up before a row leaves it."""
    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, count = np.zeros((dim, dim), object), np.zeros(dim, object), 0
        held: list[np.ndarray] = []

        def add() -> None:
            nonlocal products, sums, count
            x = np.concatenate(held)
            held.clear()
            low = x.min(axis=0)
            y_products, y_sums = cross_products(x - low)
            low = low.astype(object)
            products = products + y_products + np.triu(
                np.outer(low, y_sums) + np.outer(y_sums, low) + len(x) * np.outer(low, low))
            sums = sums + y_sums + len(x) * low
            count += len(x)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                held.append(integers(batch.column(0).slice(at, SLICE), dim)[1])
                if sum(map(len, held)) >= SLICE:
                    add()
        if sum(map(len, held)):
            add()
        if not count:
            return
        i, j = np.triu_indices(dim)
        rows = [(-1, -1, count), *((k, -1, v) for k, v in enumerate(sums)), *zip(i, j, products[i, j])]
        for at in range(0, len(rows), 50_000):
            i, j, value = zip(*rows[at:at + 50_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in value], kind)],
                ["i", "j", "value"])

    rows = df.select(F.col(f"`{vector_col}`")).mapInArrow(run, "i int, j int, value decimal(38,0)")
    return rows.groupBy("i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


def eigen(sums: list[tuple[int, int, int]], dim: int) -> tuple[int, list[int], np.ndarray, np.ndarray, float]:
    """(n, S, e, components as columns, trace) from the rows of ``scatter``; eigenvalues fall."""
    n, total = 0, [0] * dim
    products = [[0] * dim for _ in range(dim)]
    for i, j, value in sums:
        if i < 0:
            n = int(value)
        elif j < 0:
            total[i] = int(value)
        else:
            products[i][j] = products[j][i] = int(value)
    # centred as integers, divided once
    v = np.array([[(n * products[i][j] - total[i] * total[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    trace = sum(n * products[i][i] - total[i] ** 2 for i in range(dim)) / (n * n)
    e, w = np.linalg.eigh(v)
    return n, total, e[::-1], w[:, ::-1], trace


def dimension(df: DataFrame, vector_col: str) -> int | None:
    """The most frequent length of a vector above 0, the larger of equals."""
    length = F.size(F.col(f"`{vector_col}`"))
    top = (df.select(length.alias("dim")).where("dim > 0").groupBy("dim").agg(F.count("*").alias("rows"))
           .orderBy(F.desc("rows"), F.desc("dim")).first())
    return top and top.dim


def exact_deviation(dev: np.ndarray) -> np.ma.MaskedArray:
    """Sums of squares by row, masked where they don't fit a long. Wrapped sums are exact where the true one fits."""
    about = (dev.astype(np.float64) ** 2).sum(axis=1)
    out = np.ma.array((dev * dev).sum(axis=1), mask=about > _LONG * (1 + 1e-9))
    for k in np.flatnonzero(np.abs(about - _LONG) <= _LONG * 1e-9):
        exact = sum(int(d) ** 2 for d in dev[k])
        out[k] = exact if exact < 2**63 else np.ma.masked
    return out


def _projected(df: DataFrame, key_col: str, vector_col: str, dim: int, n: int, total: list[int], scaled: np.ndarray) -> DataFrame:
    """(key, deviation, w) of every row that takes part; ``scaled``: components over the roots of their eigenvalues."""
    most = max(abs(s) for s in total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                place, x = integers(part.column(1), dim)
                if not len(place):
                    continue
                if n * float(np.abs(x).max()) + most >= _LONG / 2:
                    dev = n * x.astype(object) - np.array(total, object)
                    exact = [sum(int(d) ** 2 for d in r) for r in dev]
                    deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
                else:
                    dev = n * x - np.array(total, np.int64)
                    made = exact_deviation(dev)
                    deviation = pa.array(made.data, mask=np.ma.getmaskarray(made))
                w = (dev / n).astype(np.float64) @ scaled
                starts = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(place)), deviation,
                     pa.ListArray.from_arrays(pa.array(starts), pa.array(w.ravel()))], ["key", "deviation", "w"])

    key = F.col(f"`{key_col}`").alias("key")
    rows = df.select(key, F.col(f"`{vector_col}`").alias("v"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, deviation bigint, w array<double>")


def identity_error(rows: DataFrame, width: int) -> float | None:
    """Largest absolute entry of the covariance of w minus the identity, measured on the whitened rows (``covar_pop``
    centres before it multiplies)."""
    if not width:
        return None
    each = rows.select(*[F.col("w")[k].alias(f"w{k}") for k in range(width)])
    pairs = [(a, b) for a in range(width) for b in range(a, width)]
    row = each.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(pairs, row))


def whiten(df: DataFrame, key_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row that takes part and each of
    the first ``components`` components."""
    spark = df.sparkSession
    kind = df.select(F.col(f"`{key_col}`")).schema[0].dataType.simpleString()
    schema = (f"`{key_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    dim = dimension(df, vector_col)
    sums = scatter(df, vector_col, dim).collect() if dim else []
    if not sums:
        return spark.createDataFrame([], schema)
    n, total, e, w, trace = eigen(sums, dim)
    count = min(components, dim)
    width = int((e[:count] > trace * dim * np.finfo(float).eps).sum()) if trace else 0
    # a component that can't be whitened gets 0 for now
    scaled = np.where(np.arange(count) < width, w[:, :count] / np.sqrt(np.where(e[:count] > 0, e[:count], 1)), 0)
    rows = landed(_projected(df, key_col, vector_col, dim, n, total, scaled))
    error = identity_error(rows, width)
    each = F.posexplode("w").alias("k", "whitened")
    explained = F.element_at(F.array(*[F.lit(float(v / trace) if trace else None).cast("double") for v in e[:count]]), F.col("k") + 1)
    return rows.select("key", "deviation", each).select(
        F.col("key").alias(key_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        "deviation", F.when(F.col("k") < width, F.col("whitened")).alias("whitened"), explained.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened ``embeddings``: every vector on the first eight components."""
    return whiten(table(spark, sf_dir, "embeddings"))
