"""Exact top-k search by inner product over a pivot-distance index.

Every vector x (its entries scaled and floored to integers) is lifted to x' = (x, sqrt(M2 - |x|**2)), M2 the largest
square of a norm; a query q becomes (q, 0). Then |q' - x'|**2 = |q|**2 + M2 - 2 <q, x>: the largest inner products are
the nearest points, and the triangle inequality holds.

Index: ``pivots`` vectors are chosen, far from each other, from a sample of at most ``SAMPLE`` rows; every vector is
keyed by its nearest pivot and the distance to it, range-partitioned and sorted by both. Up to ``ANNULUS`` neighbours of
one pivot are an annulus with its inner and outer radius. The key goes on with the vector's id, so equal vectors are
dealt to many tasks, the smaller ids first.

Search: each query first meets the annulus that it stands in itself, which bounds its k-th score. Queries then go out in
blocks of bounded size, each against all of the index. A task expands from the annulus nearest to the queries' own
distances, inwards and outwards, and stops on a side when no query can have a better vector there:
|d(q', p) - d(x', p)| > r(q) for all of it, r(q) the distance that belongs to the query's k-th score by then. The
tolerance on distances is on the safe side, scores are exact integers, and a tie is searched until ids rule it out, so
nothing is lost. Where distances tell little apart (random vectors of many dimensions) hardly an annulus is left out
and the search is a blocked matrix product.

A vector takes part if it is not null and holds no null, NaN or infinite entry, nor one beyond ``MAX_ABS / scale``;
an empty
one scores 0. Of vectors of different lengths the missing entries count as 0. Rows with a query's id are its own,
so repeated rows never find each other; a repeated query gets its rows for each repeat. A null id is no query; as a
candidate it comes after all other ids in a tie. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_KEY, freed, landed, table

SCALE = 256
PIVOTS = 64
SAMPLE = 2048  # vectors that pivots are chosen from
ANNULUS = 2048  # vectors of an annulus
QUERY_BYTES = 8 << 20  # of queries that are broadcast at a time
MAX_ABS = 2.0**25
CELLS = 1 << 21  # scores held at a time
HELD_BYTES = 32 << 20  # of annuli that a task expands over at a time


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x, square): integers of the vectors that take part, packed, and the squares of their norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANNULUS):
                part = batch.slice(at, ANNULUS)
                column = part.column(1)
                entries = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                x = np.floor(scale * entries)
                length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(length)), length)
                good = column.is_valid().to_numpy(zero_copy_only=False).copy()
                good[owner[~(np.abs(x) < MAX_ABS)]] = False  # true of NaN as well
                x = x[good[owner]].astype(np.int64)
                ends = np.r_[0, np.cumsum(length[good])]
                sums = np.r_[0, np.cumsum(x * x)]
                packed = x.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(good)),
                     pa.array([packed[4 * a:4 * b] for a, b in zip(ends, ends[1:])], pa.binary()),
                     pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["id", "x", "square"])

    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY)).alias("id")
    return df.select(key, F.col(f"`{vector_col}`").alias("v")).mapInArrow(run, "id bigint, x binary, square bigint")


def unpacked(column: list[bytes] | pa.Array, dim: int) -> np.ndarray:
    """The integers of packed vectors, padded with 0 to ``dim`` entries."""
    rows = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(r.ljust(4 * dim, b"\0") for r in rows), "<i4").reshape(len(rows), dim).astype(np.int64)


class Space:
    """The lifted space: its pivots, the largest square of a norm, and the narrowest exact type of an inner product."""

    def __init__(self, sample: np.ndarray, most: int, pivots: int) -> None:
        self.most, self.dim = most, sample.shape[1]
        # |sum over any entries| <= |q| |x| <= most, so partial sums are exact as well
        self.kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        self.slack = 1e-7 * (2 * float(most)) ** 0.5 + 1e-9
        chosen = [0] if len(sample) else []
        if chosen:
            far = self.distances(sample, sample[:1])[:, 0]
        while chosen and len(chosen) < min(pivots, len(sample)) and far.max() > self.slack:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, self.distances(sample, sample[chosen[-1:]])[:, 0])
        self.pivots = sample[chosen]

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(0, float(self.most) - (x * x).sum(axis=1)))

    def distances(self, x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """From lifted vectors to lifted pivots."""
        product = x.astype(np.float64) @ pivots.astype(np.float64).T + np.outer(self.lift(x), self.lift(pivots))
        return np.sqrt(np.maximum(0, 2 * float(self.most) - 2 * product))

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        """From queries, which have a last entry of 0, to lifted pivots."""
        q = q.astype(np.float64)
        return np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] + float(self.most) - 2 * (q @ self.pivots.astype(np.float64).T)))

    def radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance within which a better vector than ``score`` must stand."""
        return np.sqrt(np.maximum(0, square + float(self.most) - 2 * score)) + self.slack

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (q.astype(self.kind) @ x.astype(self.kind).T).astype(np.int64)


class Best:
    """The k best (score, id) so far of each query; ties to the smaller id."""

    def __init__(self, count: int, k: int, floor: np.ndarray | None = None, floor_id: np.ndarray | None = None) -> None:
        """``floor``, ``floor_id``: a k-th (score, id) that another task has found; worse rows are not asked for."""
        self.k, self.floor, self.floor_id = k, floor, floor_id
        self.score = np.full((count, k), np.iinfo(np.int64).min)
        self.id = np.full((count, k), NULL_KEY)
        self.none = np.ones((count, k), bool)

    def limit(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-th (score, id) of some queries."""
        score, id_ = self.score[rows, -1], self.id[rows, -1]
        if self.floor is not None:
            f, g = self.floor[rows], self.floor_id[rows]
            better = (f > score) | ((f == score) & (g < id_))
            score, id_ = np.where(better, f, score), np.where(better, g, id_)
        return score, id_

    def add(self, rows: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer a block of vectors to some queries; ``own``: the queries' ids."""
        limit, limit_id = self.limit(rows)
        hit = scores >= limit[:, None]
        if np.count_nonzero(hit) > 16 * self.k * len(rows) and scores.shape[1] > self.k:
            # a k-th row of the block itself is a limit too, beside one that is the query's own
            kth = -np.partition(-scores, self.k, axis=1)[:, self.k]
            in_order = np.sort(ids)
            mine = np.searchsorted(in_order, own, "right") - np.searchsorted(in_order, own)
            higher = (kth > limit) & (mine <= 1)
            limit, limit_id = np.where(higher, kth, limit), np.where(higher, NULL_KEY, limit_id)
            hit = scores >= limit[:, None]
        a, b = np.nonzero(hit)
        keep = ((scores[a, b] > limit[a]) | (ids[b] <= limit_id[a])) & (ids[b] != own[a])
        a, b = a[keep], b[keep]
        if not len(a):
            return
        touched = np.unique(a)
        old = rows[touched]
        q = np.r_[np.repeat(touched, self.k), a]
        s, i = np.r_[self.score[old].ravel(), scores[a, b]], np.r_[self.id[old].ravel(), ids[b]]
        none = np.r_[self.none[old].ravel(), np.zeros(len(a), bool)]
        order = np.lexsort((i, none, ~s, q))
        q, s, i, none = q[order], s[order], i[order], none[order]
        rank = np.arange(len(q)) - np.searchsorted(q, touched)[np.searchsorted(touched, q)]
        first = rank < self.k
        where = rows[q[first]], rank[first]
        self.score[where], self.id[where], self.none[where] = s[first], i[first], none[first]


def index_of(rows: DataFrame, space: Space, partitions: int) -> DataFrame:
    """(id, x, pivot, far): the vectors keyed by their nearest pivot and the distance to it, sorted within ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = space.distances(unpacked(batch.column(1), space.dim), space.pivots)
            pivot = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(far)), pivot]),
                 batch.column(2)], ["id", "x", "pivot", "far", "turn"])

    # the turn deals out even equal vectors with equal ids
    keyed = rows.select("id", "x", F.monotonically_increasing_id().alias("turn")).mapInArrow(
        run, "id bigint, x binary, pivot int, far double, turn bigint")
    order = ["pivot", "far", "id", "turn"]
    return keyed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop("turn")


@dataclass
class Annulus:
    """Up to ``ANNULUS`` neighbours in the index, at ``low`` to ``high`` from their pivot."""

    pivot: int
    low: float
    high: float
    ids: np.ndarray
    x: np.ndarray


def annuli(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Annulus]:
    """Cut rows (id, x, pivot, far) of the sorted index into annuli."""
    for batch in batches:
        pivot, far = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        if not len(pivot):
            continue
        turn = np.flatnonzero((pivot[1:] != pivot[:-1]) | (far[1:] < far[:-1])) + 1  # another pivot, or another file
        cuts = sorted({*map(int, turn), *range(0, len(pivot), ANNULUS), len(pivot)})
        for a, b in zip(cuts, cuts[1:]):
            yield Annulus(int(pivot[a]), float(far[a]), float(far[b - 1]), batch.column(0).slice(a, b - a).to_numpy(),
                          unpacked(batch.column(1).slice(a, b - a), dim))


def _offered(best: Best, rows: np.ndarray, own: np.ndarray, q: np.ndarray, ring: Annulus, space: Space) -> None:
    """Offer an annulus to queries, so many at a time that their scores stay within ``CELLS``."""
    step = max(1, CELLS // len(ring.ids))
    for at in range(0, len(rows), step):
        part = rows[at:at + step]
        best.add(part, own[part], space.scores(q[part], ring.x), ring.ids)


def first_bounds(index: DataFrame, every: int, space: Space, k: int) -> DataFrame:
    """(id, x, score, tie): every query with the k-th score and id of its own annulus (the least values if there are
    fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ring in annuli(batches, space.dim):
            mine = np.flatnonzero((ring.ids % every == 0) & (ring.ids != NULL_KEY))
            if not len(mine):
                continue
            best, each = Best(len(mine), k), np.arange(len(mine))
            _offered(best, each, ring.ids[mine], ring.x[mine], ring, space)
            score, tie = best.limit(each)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ring.ids[mine]), pa.array([r.tobytes() for r in ring.x[mine].astype("<i4")], pa.binary()),
                 pa.array(score), pa.array(tie)], ["id", "x", "score", "tie"])

    return index.select("id", "x", "pivot", "far").mapInArrow(run, "id bigint, x binary, score bigint, tie bigint")


def expand(rings: list[Annulus], d: np.ndarray, q: np.ndarray, own: np.ndarray, best: Best, space: Space) -> int:
    """Search annuli of one pivot, sorted, for queries at distances ``d`` from it: outwards from the queries' own
    distances, on each side until no query can gain. Returns the number of (query, annulus) visits."""
    visits, every = 0, np.arange(len(q))
    square = (q.astype(np.float64) ** 2).sum(axis=1)
    middle = float(np.median(d))
    start = min(range(len(rings)), key=lambda r: max(rings[r].low - middle, middle - rings[r].high, 0))
    for side in (range(start, len(rings)), range(start - 1, -1, -1)):
        for r in side:
            ring = rings[r]
            radius = space.radius(square, best.limit(every)[0].astype(np.float64))
            beyond = ring.low - d if side.step > 0 else d - ring.high
            if (beyond > radius).all():  # what follows is farther still
                break
            rows = np.flatnonzero(np.maximum(ring.low - d, d - ring.high) <= radius)
            if len(rows):
                visits += len(rows)
                _offered(best, rows, own, q, ring, space)
    return visits


def search(index: DataFrame, queries: list[Row], space: Space, k: int) -> DataFrame:
    """(turn, vec_id, score): of each task, its up to k best for each of a block of queries (turn, id, x, score, tie)."""
    own, turn, floor, tie = (np.array([r[c] for r in queries], np.int64) for c in ("id", "turn", "score", "tie"))
    sent = index.sparkSession.sparkContext.broadcast((own, turn, floor, tie, b"".join(bytes(r.x) for r in queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, turn, floor, tie, packed = sent.value
        q = np.frombuffer(packed, "<i4").reshape(len(own), space.dim).astype(np.int64)
        best = Best(len(own), k, floor, tie)
        far = space.query_distances(q)
        held: list[Annulus] = []

        def flush() -> None:
            if held:
                expand(held, far[:, held[0].pivot], q, own, best, space)
                held.clear()

        for ring in annuli(batches, space.dim):
            if held and (held[0].pivot != ring.pivot or ring.low < held[-1].high or sum(h.x.nbytes for h in held) > HELD_BYTES):
                flush()
            held.append(ring)
        flush()
        a, b = np.nonzero(~best.none)
        for at in range(0, len(a), 100_000):
            s = a[at:at + 100_000], b[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(turn[s[0]]), pa.array(best.id[s]), pa.array(best.score[s])],
                                             ["turn", "vec_id", "score"])

    return index.select("id", "x", "pivot", "far").mapInArrow(run, "turn bigint, vec_id bigint, score bigint")


def sampled(rows: DataFrame, count: int, dim: int) -> np.ndarray:
    """About ``SAMPLE`` rows spread by their hashes (at most so many); the first ones if hashes are all alike."""
    spread = F.pmod(F.xxhash64("id", "x"), F.lit(max(1, count // (2 * SAMPLE))))
    for some in (rows.where(spread == 0), rows):
        if found := [bytes(r.x) for r in some.select("x").limit(SAMPLE).collect()]:
            break
    return unpacked(found, dim)


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, pivots: int = PIVOTS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, rank, vec_id, score): of every row whose id is divisible by ``every`` the ``k`` other rows with the
    highest inner products."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query long, rank int, vec_id long, score long")
    rows = landed(vectors(df, id_col, vector_col, scale))
    count, most, size = rows.agg(F.count("*"), F.max("square"), F.max(F.octet_length("x"))).first()
    if not count:
        return empty
    dim = size // 4
    space = Space(sampled(rows, count, dim), most, pivots)
    index = landed(index_of(rows, space, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    freed(rows)
    # landed, so that a query's number stays the same
    queries = landed(first_bounds(index, every, space, k).withColumn("turn", F.monotonically_increasing_id()))
    order = Window.partitionBy("turn").orderBy(F.desc("score"), "vec_id")
    ranked = None
    for low, high in _blocks(queries, max(1, query_bytes // (4 * dim + 32))):
        block = queries.where((F.col("turn") >= low) & (F.col("turn") < high)).collect()
        hits = search(index, block, space, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = landed(hits) if ranked is None else ranked.unionAll(landed(hits))
    if ranked is None:
        return empty
    names = queries.select("turn", F.col("id").alias("query"))
    null = F.when(F.col("vec_id") != NULL_KEY, F.col("vec_id"))
    return ranked.join(names, "turn").select("query", F.col("rank").cast("int").alias("rank"), null.alias("vec_id"), "score")


def _blocks(queries: DataFrame, size: int) -> list[tuple[int, int]]:
    """Stretches of row numbers with up to ``size`` queries each. Numbers run on within a partition (33 bits), so the
    counts of partitions are enough; neighbours in the index stay together."""
    part: Column = F.shiftright("turn", 33)
    counts = sorted(map(tuple, queries.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()))
    out: list[tuple[int, int]] = []
    low, held = 0, 0
    for p, n in counts:
        if held and held + n > size:
            out.append((low, p << 33))
            low, held = p << 33, 0
        at = 0
        while n - at > size:  # a partition with more queries than a block
            out.append((low, (p << 33) + at + size))
            at += size
            low = (p << 33) + at
        held += n - at
    if held:
        out.append((low, 2**63 - 1))
    return out


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth row of ``embeddings`` with all others."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)
SELECT q.vec_id AS query, row_number() OVER w::INT AS rank, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 5
"""
