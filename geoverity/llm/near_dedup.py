"""MinHash near-dedup with sequential Bayesian verification.

Every text becomes the set of its distinct word shingles and a MinHash signature.
Texts with equal sets are one class; only classes are compared. Bands of the
signature name buckets. Candidate pairs of a bucket are verified in two steps:
the signatures are compared batch by batch and the pair is dropped as soon as the
posterior probability of the threshold (uniform prior) falls below ``miss``;
survivors are confirmed on the full shingle sets.

No bucket is expanded into all its pairs. Each member is compared with the hub of
its bucket (a member near the middle of its group); connected components follow. What can still be missing are links x - y of a bucket whose hub
h is not linked with x. Write A for the shingles of h that a member lacks and B
for those that it adds, t for the threshold and c = t / (1 + t). Then x - y is a link
only if |A_x & A_y| + |B_x & B_y| >= m(x) + (1 - c) * |A_y| + c * |B_y|, where
m(x) = |A_x| + c * |x| - (1 - c) * |h| is above 0 as h - x is no link. With all
differences in one order, from rare to frequent among the hub's members, x and y then
share one of the first |D_x| - m(x) + 1 of x and of the first
c * |A_y| + (1 - c) * |B_y| - m(x) + 1 of y (prefix filter; D is A and B). Members of a
hub are joined on just these, so copies with edits of their own, or texts around one
common passage, meet hardly anybody, and no link is lost. The chance that a pair at
the threshold shares no band is ``(1 - 0.8**rows)**bands``, 5e-8 here.

Null or empty text, or text without words: an empty set, linked with nothing. A
null key sorts after every other and is a null component id if nothing else is
reachable. Rows that share a key and differ in text are linked by their texts
alone. Repeated rows get the same result each; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASES, MAX_BLOOM_BYTES, NULL_KEY, Rolling, bloom_of, freed, landed, mix64, sliced, table
from .runs import BYTE_UNITS, keyed
from .substring_dedup import word_bounds

BANDS, ROWS = 32, 4
BATCH = 16  # signature values compared at a time
MISS = 1e-6
LOOSE_ROUNDS = 2  # rounds in which members that their hub doesn't hold choose one among themselves
LOOSE_MIN = 16
PART_ROWS = 2_000  # classes in a part of a written table, at least
MAX_GONE = 1_000_000  # rows (12 bytes each) that dedup() broadcasts; more are joined by shuffle

_A, _B = (mix64(np.arange(i, i + BANDS * ROWS, dtype=np.uint64)) for i in (1, 10_001))
_A |= np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(text: str, k: int) -> np.ndarray:
    """Hashes of the distinct k-word shingles (with fewer words, of the whole sequence), sorted."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    words = Rolling(Rolling(BYTE_UNITS[raw], BASES[0]).spans(start, end), BASES[1])
    return np.unique(words.fixed(min(k, len(start))))


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For 1, 2, ... batches: the fewest equal values with posterior P(J >= threshold) >= miss.

    With a uniform prior and m of n equal, P(J >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Pairs (rows of two signature tables) that no batch prunes."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[equal[alive] >= m]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """(id, th, n, f, c, sig, keys) of every document: set size, class (two hashes), signature, band names."""
    schema = "id bigint, th bigint, n bigint, f bigint, c bigint, sig binary, keys array<bigint>"

    def part(ids, ths, sets) -> pa.RecordBatch:
        size = np.array([len(s) for s in sets])
        full = np.flatnonzero(size)
        begin = np.cumsum(np.r_[0, size[full][:-1]]).astype(np.int64)
        sig = np.zeros((len(sets), BANDS * ROWS), np.uint64)
        f, c = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        if len(full):
            x = np.concatenate([sets[i] for i in full])
            for j in range(BANDS * ROWS):
                sig[full, j] = np.minimum.reduceat(x * _A[j] + _B[j], begin)
            f[full] = np.add.reduceat(mix64(x), begin)
            c[full] = mix64(np.bitwise_xor.reduceat(mix64(x ^ _A[0]), begin) + size[full].astype(np.uint64))
        keys = np.zeros((len(sets), BANDS), np.uint64)
        for r in range(ROWS):
            keys = mix64(keys ^ sig[:, r::ROWS]) + np.arange(BANDS, dtype=np.uint64)
        short = (sig >> np.uint64(40)).astype("<u2")  # for comparing; bands use the whole values
        where = np.arange(0, (len(sets) + 1) * BANDS, BANDS, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(size, pa.int64()),
             pa.array(f.view(np.int64)), pa.array(c.view(np.int64)), pa.array([r.tobytes() for r in short], pa.binary()),
             pa.ListArray.from_arrays(pa.array(where), pa.array(keys.view(np.int64).ravel()))],
            ["id", "th", "n", "f", "c", "sig", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            ids, ths, sets, size = [], [], [], 0
            for i, th, text in zip(*(batch.column(x).to_pylist() for x in range(3))):
                ids.append(i), ths.append(th), sets.append(shingles(text, k))
                size += len(sets[-1])
                if size >= 300_000:
                    yield part(ids, ths, sets)
                    ids, ths, sets, size = [], [], [], 0
            if ids:
                yield part(ids, ths, sets)

    return docs.select("id", "th", "text").mapInArrow(run, schema)


def connected(labels: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Update (c, comp) by edges (a, b) between classes; smallest label wins."""
    lab = lambda x: labels.select(F.col("c").alias(x), F.col("comp").alias(f"{x}_comp"))
    few = lambda df: df if parts is None else df.coalesce(parts)
    links = landed(few(edges.join(lab("a"), "a")).join(lab("b"), "b").where("a_comp != b_comp")
                   .select(F.least("a_comp", "b_comp").alias("u"), F.greatest("a_comp", "b_comp").alias("v")).distinct(), parts)
    if links.isEmpty():
        return labels
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = landed(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), parts)
    while True:
        # offer each neighbour one's label, then let every label follow its own label
        offers = both.join(state.select(F.col("u").alias("v"), "to"), "v").select("u", "to", F.lit(None).cast("long").alias("old"))
        best = few(state.select("u", "to", F.col("to").alias("old")).unionByName(few(offers))
                   .groupBy("u").agg(F.min("to").alias("to"), F.max("old").alias("old")))
        far = best.select(F.col("u").alias("to"), F.col("to").alias("far"))
        jumped = best.join(far, "to", "left").select("u", F.least("to", F.coalesce("far", "to")).alias("to"), "old")
        moved = Observation()
        state = landed(jumped.observe(moved, F.max(F.col("to") != F.col("old")).alias("any")).select("u", "to"), parts)
        if not moved.get.get("any"):
            break
    return landed(labels.join(state.withColumnRenamed("u", "comp"), "comp", "left").select("c", F.coalesce("to", "comp").alias("comp")), parts)


class Finder:
    """Candidate pairs and their verification over one set of documents."""

    def __init__(self, docs: DataFrame, k: int, threshold: int, miss: float = MISS, max_bloom: int = MAX_BLOOM_BYTES) -> None:
        self.k, self.threshold, self.least = k, threshold, least_matches(threshold / 100, miss)
        self.sets = landed(set_rows(docs, k))
        full = self.sets.where("n > 0")
        self.classes = landed(
            full.groupBy("c", "f").agg(F.min(F.struct("id", "th")).alias("r")).select("c", "f", "r.id", "r.th")
            .join(full.select("c", "f", "id", "th", "n", "sig", "keys"), ["c", "f", "id", "th"])
            .dropDuplicates(["c"]))
        rows = self.classes.select("c", F.explode("keys").alias("key"))
        crowded = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        self.members = landed(rows.join(crowded, "key"))
        self.nodes = landed(self.members.groupBy("c").agg(F.sum("size").alias("crowd")))
        # tables of classes in crowded buckets are written in parts of this many
        self.parts = max(docs.sparkSession.sparkContext.defaultParallelism, self.nodes.count() // PART_ROWS)
        self.sigs = landed(self.classes.join(self.nodes, "c", "left_semi").select("c", "n", "sig", "id", "th"), self.parts)
        self.texts = landed(self._texts(docs, max_bloom), self.parts)

    def few(self, df: DataFrame) -> DataFrame:
        """A step of a chain over classes in crowded buckets, in parts of their number."""
        return df.coalesce(self.parts)

    def free(self) -> None:
        """Empty the working tables, once a result that reads them has been written."""
        for part in (self.sets, self.classes, self.members, self.nodes, self.sigs, self.texts):
            freed(part)

    def _texts(self, docs: DataFrame, max_bloom: int) -> DataFrame:
        """(c, text) of the classes in crowded buckets; only their texts are shuffled."""
        ids = landed(self.sigs.select("id").distinct(), self.parts)
        bloom = bloom_of(ids, max_bloom)
        rows = docs.select("id", "th", "text")
        if bloom is not None:
            sent = docs.sparkSession.sparkContext.broadcast(bloom)

            def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array(sent.value.has(b.column(0).to_numpy(zero_copy_only=False))))

            rows = rows.mapInArrow(near, rows.schema)
        return rows.join(self.sigs.select("c", "id", "th"), ["id", "th"]).dropDuplicates(["c"]).select("c", "text")

    def prune(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of rows (a, b, a_n, b_n, a_sig, b_sig) that the signatures don't rule out."""
        least, share = self.least, self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for x in (4, 5))
                ok = survives(a, b, least) & (100 * np.minimum(n, m) >= share * np.maximum(n, m))
                yield batch.select([0, 1]).filter(pa.array(ok))

        return pairs.select("a", "b", "a_n", "b_n", "a_sig", "b_sig").mapInArrow(run, "a bigint, b bigint").distinct().coalesce(self.parts)

    def with_sigs(self, pairs: DataFrame) -> DataFrame:
        for x in ("a", "b"):
            pairs = self.few(pairs.join(self.sigs.select(F.col("c").alias(x), F.col("n").alias(f"{x}_n"), F.col("sig").alias(f"{x}_sig")), x))
        return pairs

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """(a, b) whose full shingle sets reach the threshold."""
        k, share = self.k, self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 3):
                ok, last, mine = [], None, None
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if x != last:
                        last, mine = x, shingles(x, k)
                    other = shingles(y, k)
                    inter = len(np.intersect1d(mine, other, assume_unique=True))
                    ok.append(100 * inter >= share * (len(mine) + len(other) - inter))
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        for x in ("a", "b"):
            pairs = self.few(pairs.join(self.texts.select(F.col("c").alias(x), F.col("text").alias(f"{x}_text")), x))
        return pairs.select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint")

    def hubs(self) -> DataFrame:
        """(c, hub): every member of a crowded bucket with that bucket's hub.

        A bucket's most crowded member (it stands in the largest buckets) gives way to the most crowded one of all
        its own buckets, and that again, so that the buckets of one group share a hub near its middle. A bucket has
        one hub, whether or not that is in the bucket, so members of a bucket share a hub.
        """
        placed = self.members.select("key", "c").join(self.nodes, "c")
        first = placed.groupBy("key").agg(F.max(F.struct("crowd", "c")).alias("top"))
        tops = landed(self.members.select("key", "c").join(first, "key").select("c", "top").distinct(), self.parts)
        own = tops.groupBy("c").agg(F.max("top").alias("top")).select(F.col("c").alias("hub"), F.col("top.c").alias("better"))
        hubs = tops.select("c", F.col("top.c").alias("hub"))
        for _ in range(2):
            hubs = self.few(hubs.join(own, "hub").select("c", F.col("better").alias("hub")))
        return hubs.distinct()

    def beside(self, stars: DataFrame, labels: DataFrame) -> DataFrame:
        """(hub, c, comp, hub_comp) of the members beside their hubs."""
        hub = labels.select(F.col("c").alias("hub"), F.col("comp").alias("hub_comp"))
        return landed(self.few(stars.where("c != hub").join(labels, "c")).join(hub, "hub"), self.parts)

    def loose_stars(self, placed: DataFrame) -> DataFrame:
        """(c, hub): of the members that share a hub but not its component, each with the most crowded one of them, where
        they are more than ``LOOSE_MIN`` in two components at least. So a group whose hub lies in another group gets one
        inside."""
        loose = placed.where("comp != hub_comp").select("hub", "c", "comp")
        kinds = self.few(loose.join(self.nodes, "c")).groupBy("hub").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.max(F.struct("crowd", "c")).alias("top"))
        kinds = kinds.where((F.col("low") < F.col("high")) & (F.col("n") > LOOSE_MIN)).select("hub", F.col("top.c").alias("next"))
        return loose.join(kinds, "hub").where("c != next").select("c", F.col("next").alias("hub")).distinct()

    def open_members(self, placed: DataFrame) -> DataFrame:
        """The members of hubs with two or more components besides their own or a member beside one."""
        kinds = placed.groupBy("hub").agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"),
            F.max(F.col("comp") != F.col("hub_comp")).alias("loose")).where("loose AND low < high").select("hub")
        return self.few(placed.join(kinds, "hub", "left_semi"))

    def differences(self, pairs: DataFrame) -> DataFrame:
        """(hub, c, comp, added, x, margin, asks, offers): the shingles that tell a member from its hub. ``margin``:
        m of a member outside the hub's component, else null. ``asks``, ``offers``: where its prefixes end."""
        k, c_ = self.k, self.threshold / (100 + self.threshold)
        kinds = [pa.int64()] * 3 + [pa.bool_(), pa.int64()] + [pa.float64()] * 3
        names = ["hub", "c", "comp", "added", "x", "margin", "asks", "offers"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 4):
                out, last, mine = [], None, None
                for hub, c, comp, loose, text, hub_text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if hub_text != last:
                        last, mine = hub_text, shingles(hub_text, k)
                    other = shingles(text, k)
                    lacks, adds = np.setdiff1d(mine, other, assume_unique=True), np.setdiff1d(other, mine, assume_unique=True)
                    n = len(adds) + len(lacks)
                    # the small shifts keep rounding from losing a link
                    margin = len(lacks) + c_ * len(other) - (1 - c_) * len(mine) - 1e-6 if loose else np.nan
                    offers = c_ * len(lacks) + (1 - c_) * len(adds) + 1e-6
                    out.append((np.full(n, hub), np.full(n, c), np.full(n, comp), np.arange(n) < len(adds),
                                np.r_[adds, lacks].view(np.int64), *(np.full(n, v) for v in (margin, n - margin, offers))))
                if out:
                    columns = [np.concatenate(v) for v in zip(*out)]
                    calm = np.isnan(columns[5])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t, mask=calm if i in (5, 6) else None) for i, (v, t) in enumerate(zip(columns, kinds))], names)

        rows = pairs.select("hub", "c", "comp", (F.col("comp") != F.col("hub_comp")).alias("loose"))
        rows = self.few(rows.join(self.texts.select("c", "text"), "c"))
        rows = rows.join(self.texts.select(F.col("c").alias("hub"), F.col("text").alias("hub_text")), "hub")
        return rows.select("hub", "c", "comp", "loose", "text", "hub_text").mapInArrow(
            run, "hub bigint, c bigint, comp bigint, added boolean, x bigint, margin double, asks double, offers double")

    def rest(self, placed: DataFrame) -> DataFrame:
        """(a, b): pairs that may be links between components, by a shared difference from their hub."""
        rows = landed(self.differences(self.open_members(placed)), self.parts)
        spot = ["hub", "added", "x"]
        counts = rows.groupBy(*spot).agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        order = Window.partitionBy("hub", "c").orderBy("n", "added", "x")
        wide = rows
        rows = landed(self.few(rows.join(counts, spot)).withColumn("i", F.row_number().over(order) - 1)
                      .where("low < high AND (i <= asks OR i <= offers)").drop("low", "high", "n"), self.parts)
        freed(wide)
        asks = rows.where("i <= asks").select(*spot, F.col("c").alias("a"), F.col("comp").alias("a_comp"), "margin")
        offers = rows.where("i <= offers").select(
            *spot, F.col("c").alias("b"), F.col("comp").alias("b_comp"), (F.col("offers") - F.col("i")).alias("slack"))
        pairs = asks.join(offers, spot).where("a_comp != b_comp AND margin <= slack")
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def labels(self) -> DataFrame:
        """(c, comp) of the classes in crowded buckets."""
        labels = self.nodes.select("c", F.col("c").alias("comp"))
        stars = asked = landed(self.hubs(), self.parts)
        for _ in range(1 + LOOSE_ROUNDS):
            labels, found = self._linked(labels, asked.where("c != hub").select(F.col("hub").alias("a"), F.col("c").alias("b")))
            placed = self.beside(stars, labels)
            if not found or (asked := landed(self.loose_stars(placed), self.parts)).isEmpty():
                break
        return self._linked(labels, self.rest(placed))[0]

    def _linked(self, labels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, bool]:
        """Labels after the links among some pairs, and whether there are any."""
        links = landed(self.confirm(self.prune(self.with_sigs(pairs))), self.parts)
        return (labels, False) if links.isEmpty() else (connected(labels, links, self.parts), True)


def _grouped(finder: Finder) -> DataFrame:
    """(c, least_id, least_th): of each class, the smallest document of its component."""
    labels = finder.labels()
    lowest = finder.classes.select("c", "id", "th").join(labels, "c", "left") \
        .select("c", "id", "th", F.coalesce("comp", "c").alias("comp"))
    least = lowest.groupBy("comp").agg(F.min(F.struct("id", "th")).alias("least"))
    return lowest.join(least, "comp").select("c", F.col("least.id").alias("least_id"), F.col("least.th").alias("least_th"))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80,
               miss: float = MISS, max_bloom: int = MAX_BLOOM_BYTES) -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component_id`` (smallest key reachable over links of at
    least ``threshold`` percent similarity), ``kept`` (it is its component's smallest key)."""
    docs = keyed(df, id_col, text_col)
    finder = Finder(docs, k, threshold, miss, max_bloom)
    out = finder.sets.select("id", "n", "c").join(_grouped(finder), "c", "left")
    whole = F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("id"))
    null = lambda x: F.when(x != NULL_KEY, x)
    kind = docs.schema["_id"].dataType
    return out.select(null(F.col("id")).cast(kind).alias(id_col), F.col("n").alias("n_shingles"),
                      null(whole).cast(kind).alias("component_id"), (F.col("id") == whole).alias("kept"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``df``, all columns: of each component the row with the smallest (key, text hash), of repeated
    rows one; rows without words stay."""
    finder = Finder(keyed(df, id_col, text_col), k, threshold)
    rows = finder.sets.select("id", "th", "n", "c").join(_grouped(finder), "c", "left") \
        .select("id", "th", (F.col("n") > 0).alias("full"), ((F.col("id") == F.col("least_id")) & (F.col("th") == F.col("least_th")))
                .alias("least"))
    rows = landed(rows.groupBy("id", "th").agg(F.max(F.col("full") & ~F.col("least")).alias("goes"), F.count("*").alias("times")))
    finder.free()
    # the rows that go are few: up to a checked number they are broadcast, so that no text is shuffled
    gone = rows.where("goes").select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    if gone.count() <= MAX_GONE:
        gone = F.broadcast(gone)
    out = df.withColumns({"__id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY)),
                          "__th": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    out = out.join(gone, ["__id", "__th"], "left_anti")
    if not rows.where("times > 1").isEmpty():
        out = out.dropDuplicates(["__id", "__th"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate ``documents`` (4-word shingles, similarity of 0.8 or more)."""
    return components(table(spark, sf_dir, "documents"), k=4)
