"""Toxicity by class-conditional Kneser-Ney models.

Two character n-gram models, of toxic and of ordinary text, share their backoff:
``P(w|h) = max(count - D, 0) / count(h) + backoff(h) * S(w|h')``. Counts at the
top order are those of the class; ``S`` is a Kneser-Ney model of continuation
counts over both classes. So a rare expression that a class has not seen falls
back to the same shared estimate in both. n-grams stay inside a word (with its
leading and trailing space); punctuation and letters count alike, A-Z and other
letters lower-cased. All n-grams of all labelled learning rows are counted, and the
models are Spark tables of any size. Up to ``MAX_GRAMS`` rows they are broadcast to the
texts; beyond, the ratios are summed once for each distinct word of the documents and
these word sums are joined to the texts' words. Both give equal results.

A text's features are length-normalised log-likelihood ratios: of the whole text,
of its strongest run of ``RUN`` words and of its strongest word. A logistic
function turns them into a score; it is fitted on about ``MAX_FIT`` learning
rows whose features come from models that have not counted them (two folds by
the hash of the text, so that copies stay together).

Several labels of one document: the largest counts. Null or empty text: all
features 0. Without learning rows of both classes every score is 0. Null key: not
held out, never learnt from. Repeated rows get the same result each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASES, Rolling, freed, landed, mix64, sliced, table

ORDER = 5
RUN = 8  # words of a run
MAX_GRAMS = 2_000_000  # the model is broadcast up to so many n-grams and contexts, else joined by shuffle
MAX_FIT = 20_000  # rows that the logistic function is fitted on, about; toxic ones up to half of them
MAX_LABELS = 2_000_000  # labels are broadcast up to so many rows, else joined by shuffle
THRESHOLD = 0.7
FEATURES = 3
FIXED = 2**20  # ratios are whole multiples of 1 / FIXED, so that sums don't depend on their order
#: Folds that each of the three models counts: all rows, either fold left out.
MODELS = (("0", "1"), ("1",), ("0",))


# --- text to n-grams ----------------------------------------------------------

def lowered(text: str) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``."""
    return text.lower().encode("utf-8", "surrogatepass").split()


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, whether each is a word's opening space, words until the end of each text).

    Every word is laid out as space, letters, space.
    """
    words = [lowered(t) for t in texts]
    until = np.cumsum([len(w) for w in words])
    flat = b" " + b"  ".join([x for w in words for x in w]) + b" " if until[-1] else b""
    points = np.frombuffer(flat.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = points == 32
    opens = space & np.r_[True, space[:-1]][:len(space)]  # the first of two spaces closes a word, the second opens one
    return points, opens, until


def positions(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(code points, gram starts, position, word of each position, words until the end of each text).

    A position is a letter or the closing space of a word.
    """
    points, opens, until = laid_out(texts)
    at = np.flatnonzero(~opens)
    first = np.maximum.accumulate(np.where(opens, np.arange(len(points)), 0))
    word = np.cumsum(opens) - 1
    return points, np.maximum(at - (ORDER - 1), first[at]), at, word[at], until


def named_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash and number of positions of each word, words until the end of each text)."""
    points, opens, until = laid_out(texts)
    begin = np.flatnonzero(opens)
    end = np.r_[begin[1:], len(points)][:len(begin)]
    return hashes(points, begin, end), end - begin - 1, until


def hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(mix64(points.astype(np.uint64)), BASES[0]).spans(start, end)


def hashes_of(grams: list[str]) -> np.ndarray:
    if not grams:
        return np.zeros(0, np.uint64)
    size = np.array([len(g) for g in grams])
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(np.r_[0, size[:-1]])
    return hashes(points, start, start + size)


class Lookup:
    """Open-addressing table from 64-bit hashes to rows of values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)
        self.at = np.full(size, -1, np.int32)
        self.values = np.vstack([values, np.zeros((1, values.shape[1]), values.dtype)])  # row -1: not found
        slot, rows = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(rows):
            free = self.at[slot] == -1
            self.at[slot[free]], self.keys[slot[free]] = rows[free], keys[rows[free]]
            left = self.at[slot] != rows
            slot, rows = (slot[left] + 1) & (size - 1), rows[left]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it is not there."""
        slot = self._slot(keys)
        out = self.at[slot]
        rest = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        out[rest] = -1
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.at) - 1)
            row = self.at[slot[rest]]
            hit = (row >= 0) & (self.keys[slot[rest]] == keys[rest])
            out[rest[hit]] = row[hit]
            rest = rest[(row >= 0) & ~hit]
        return out


# --- the models ---------------------------------------------------------------

def shared_backoff(grams: pd.DataFrame, discount: float) -> pd.Series:
    """S of every shorter n-gram, by continuation counts (raw counts for those that open a word).

    This and ``ratios`` are the plain versions, in one process, of ``backoff_table`` and ``ratio_tables``; only
    the tests call them.
    """
    by_length: dict[int, pd.Series] = {n: g.set_index("gram")["total"] for n, g in grams.groupby(grams.gram.str.len())}
    known: dict[int, pd.Series] = {}
    for n in range(ORDER, 1, -1):
        parts = [x for x in (known.get(n), by_length.get(n)) if x is not None and len(x)]
        longer = pd.concat(parts).astype(float) if parts else pd.Series(dtype=float, index=pd.Index([], dtype=object))
        longer = longer[~longer.index.duplicated(keep="last")]
        known[n] = longer
        shorter = longer.index.to_series().str[1:]
        known[n - 1] = shorter.groupby(shorter.values).size().astype(float)
    p = known[1] / known[1].sum()
    out = [p]
    for n in range(2, ORDER):
        v = known[n]
        context = v.index.str[:-1]
        sums = v.groupby(context).agg(["sum", "size"])
        total, kinds = sums["sum"].reindex(context).to_numpy(), sums["size"].reindex(context).to_numpy()
        lower = p.reindex(v.index.str[1:]).to_numpy()
        p = pd.Series(np.maximum(v.to_numpy() - discount, 0) / total + discount * kinds / total * lower, index=v.index)
        out.append(p)
    return pd.concat(out)


def ratios(grams: pd.DataFrame, toxic: np.ndarray, ordinary: np.ndarray, shared: np.ndarray,
           discount: float) -> tuple[np.ndarray, pd.Series]:
    """log P_toxic - log P_ordinary of each n-gram, and of an unseen one by its context."""
    code, contexts = pd.factorize(grams.gram.str[:-1])
    p, back = [], []
    for count in (toxic, ordinary):
        total = np.bincount(code, weights=count, minlength=len(contexts))
        kinds = np.bincount(code, weights=count > 0, minlength=len(contexts))
        low = np.divide(discount * kinds, total, out=np.ones(len(contexts)), where=total > 0)
        total = total[code]
        own = np.divide(np.maximum(count - discount, 0), total, out=np.zeros(len(count)), where=total > 0)
        p.append(own + low[code] * shared)
        back.append(low)
    return np.log(p[0]) - np.log(p[1]), pd.Series(np.log(back[0]) - np.log(back[1]), index=contexts)


def text_features(total: np.ndarray, size: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Length-normalised ratios of each text, from its words' sums (in fixed point) and positions."""
    out = np.zeros((len(until), FEATURES))
    sums, sizes = np.cumsum(np.r_[0, total]), np.cumsum(np.r_[0, size])
    first = 0
    for k, last in enumerate(until.tolist()):
        if last > first:
            n = min(RUN, last - first)
            a, b = np.arange(first, last - n + 1), np.arange(first + n, last + 1)
            out[k] = ((sums[last] - sums[first]) / (sizes[last] - sizes[first]),
                      ((sums[b] - sums[a]) / (sizes[b] - sizes[a])).max(),
                      (total[first:last] / (size[first:last] + 2)).max())
        first = last
    return out / FIXED


def fit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the constant last) of a logistic function, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


# --- in Spark -----------------------------------------------------------------

def held_out(key) -> object:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_text, toxic, fold, _id): labelled rows outside the held-out part."""
    marks = (labels.select(F.col(f"`{id_col}`").alias("m_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
             .where("m_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("m_id")))
             .groupBy("m_id").agg(F.max("toxic").alias("toxic")))
    if labels.count() <= MAX_LABELS:
        marks = F.broadcast(marks)
    fold = F.pmod(F.xxhash64(F.lower("_text")), F.lit(2)).cast("int")
    return docs.join(marks, F.col("_id") == F.col("m_id")).select("_text", "toxic", fold.alias("fold"), "_id")


def count_grams(rows: DataFrame) -> DataFrame:
    """(gram, t0, t1, o0, o1, total): counts by class and fold over all learning rows."""
    words = (rows.select(F.explode(F.split(F.lower("_text"), r"[\x20\x09-\x0D]+")).alias("word"), "toxic", "fold")
             .where("word != ''").groupBy("word", "toxic", "fold").agg(F.count("*").alias("n")))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    pieces = F.transform(F.sequence(F.lit(2), F.length("word") + 2), lambda i: F.substring(
        padded, F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))))
    cell = lambda y, f: F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == f), F.col("n")).otherwise(0))
    return (words.select(F.explode(pieces).alias("gram"), "toxic", "fold", "n").groupBy("gram")
            .agg(cell(1, 0).alias("t0"), cell(1, 1).alias("t1"), cell(0, 0).alias("o0"), cell(0, 1).alias("o1"),
                 F.sum("n").alias("total")))


def backoff_table(grams: DataFrame, discount: float) -> DataFrame:
    """(gram, s): S of every shorter n-gram, as ``shared_backoff`` has it."""
    known = {ORDER: grams.where(F.length("gram") == ORDER).select("gram", "total")}
    for n in range(ORDER - 1, 0, -1):
        shorter = known[n + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("total"))
        known[n] = landed(shorter.union(grams.where(F.length("gram") == n).select("gram", "total")))
    whole = known[1].agg(F.sum("total")).first()[0]
    out = [landed(known[1].select("gram", (F.col("total") / F.lit(float(whole or 1))).alias("s")))]
    for n in range(2, ORDER):
        rows = known[n].withColumns({"context": F.substring("gram", 1, n - 1), "rest": F.expr("substring(gram, 2)")})
        sums = rows.groupBy("context").agg(F.sum("total").alias("sum"), F.count("*").alias("kinds"))
        lower = out[-1].select(F.col("gram").alias("rest"), F.col("s").alias("lower"))
        own = F.greatest(F.col("total") - F.lit(discount), F.lit(0.0)) / F.col("sum")
        p = rows.join(sums, "context").join(lower, "rest").select(
            "gram", (own + F.lit(discount) * F.col("kinds") / F.col("sum") * F.col("lower")).alias("s"))
        out.append(landed(p) if n < ORDER - 1 else p)
    return reduce(DataFrame.union, out)


def fixed(ratio: Column) -> Column:
    return F.rint(ratio * F.lit(float(FIXED))).cast("long")


def ratio_tables(grams: DataFrame, discount: float) -> tuple[DataFrame, DataFrame]:
    """(gram, r0, r1, r2) and (context, l0, l1, l2) of the three models: log P_toxic - log P_ordinary of each n-gram
    and, of an unseen one, by its context. As ``ratios`` has it, in fixed point."""
    kinds = [f"{kind}{m}" for kind in "to" for m in range(len(MODELS))]
    cells = grams.select("gram", F.expr("substring(gram, 1, length(gram) - 1)").alias("context"),
                         F.expr("substring(gram, 2)").alias("rest"),
                         *[reduce(Column.__add__, [F.col(f"{x[0]}{f}") for f in MODELS[int(x[1])]]).alias(f"n_{x}") for x in kinds])
    sums = cells.groupBy("context").agg(*[F.sum(f"n_{x}").alias(f"sum_{x}") for x in kinds],
                                        *[F.sum((F.col(f"n_{x}") > 0).cast("long")).alias(f"kinds_{x}") for x in kinds])
    some = lambda x, value, other: F.when(F.col(f"sum_{x}") > 0, value / F.col(f"sum_{x}")).otherwise(F.lit(other))
    lows = landed(sums.select("context", *[f"sum_{x}" for x in kinds], *[
        some(x, F.lit(discount) * F.col(f"kinds_{x}"), 1.0).alias(f"low_{x}") for x in kinds]))
    p = lambda x: some(x, F.greatest(F.col(f"n_{x}") - F.lit(discount), F.lit(0.0)), 0.0) + F.col(f"low_{x}") * F.col("s")
    shared = backoff_table(grams, discount).withColumnRenamed("gram", "rest")
    tops = cells.join(lows, "context").join(shared, "rest").select(
        "gram", *[fixed(F.log(p(f"t{m}")) - F.log(p(f"o{m}"))).alias(f"r{m}") for m in range(len(MODELS))])
    return landed(tops), lows.select("context", *[
        fixed(F.log(f"low_t{m}") - F.log(f"low_o{m}")).alias(f"l{m}") for m in range(len(MODELS))])


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word): the lower-cased words of all texts, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            words = set().union(*(lowered(t) for t in batch.column(0).to_pylist() if t))
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()).cast(pa.string())], ["word"])

    return docs.select("_text").mapInArrow(run, "word string").distinct()


def word_sums(docs: DataFrame, tops: DataFrame, lows: DataFrame) -> DataFrame:
    """(w, r0, r1, r2): of each distinct word its hash and, for each model, the sum of its n-grams' ratios."""
    models = range(len(MODELS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, 100_000):
            words = batch.column(0).to_pylist()
            points, start, at, word, _ = positions(words)
            flat = points.tobytes().decode("utf-32-le", "surrogatepass")
            names = named_words(words)[0].view(np.int64)
            pieces = [flat[a:b] for a, b in zip(start.tolist(), (at + 1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names[word]), pa.array(pieces, pa.string())], ["w", "gram"])

    rows = landed(distinct_words(docs).mapInArrow(run, "w bigint, gram string").join(tops, "gram", "left"))
    seen = rows.where("r0 IS NOT NULL").select("w", *[f"r{m}" for m in models])
    unseen = rows.where("r0 IS NULL").select("w", F.expr("substring(gram, 1, length(gram) - 1)").alias("context")) \
        .join(lows, "context", "left").select("w", *[F.coalesce(f"l{m}", F.lit(0)).alias(f"r{m}") for m in models])
    out = landed(seen.union(unseen).groupBy("w").agg(*[F.sum(f"r{m}").alias(f"r{m}") for m in models]))
    freed(rows)
    return out


def lookup_of(rows: DataFrame) -> Lookup:
    """Lookup of a ratio table, by the hashes of its n-grams or contexts; these are made in Spark tasks."""
    name, *ratios = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array(hashes_of(b.column(0).to_pylist()).view(np.int64))
            yield pa.RecordBatch.from_arrays([keys, *b.columns[1:]], ["h", *b.schema.names[1:]])

    small = rows.select(name, *[F.col(r).cast("int") for r in ratios])
    frame = small.mapInArrow(run, ", ".join(["h bigint", *(f"{r} int" for r in ratios)])).toPandas()
    return Lookup(frame.h.to_numpy(np.int64).view(np.uint64), frame[ratios].to_numpy(np.int32))


def word_totals(texts: list[str], which: np.ndarray, tops: Lookup, lows: Lookup) -> tuple[np.ndarray, ...]:
    """(sum of ratios in fixed point, positions of each word, words until the end of each text); ``which``: the
    model of each text."""
    points, start, at, word, until = positions(texts)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), until
    rolling = Rolling(mix64(points.astype(np.uint64)), BASES[0])
    column = np.repeat(which, np.diff(np.r_[0, until]))[word]
    row = tops.find(rolling.spans(start, at + 1))
    ratio = tops.values[row, column].astype(np.int64)
    unseen = np.flatnonzero(row < 0)
    ratio[unseen] = lows.values[lows.find(rolling.spans(start[unseen], at[unseen])), column[unseen]]
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    return np.add.reduceat(ratio, begin), np.diff(np.r_[begin, len(word)]), until


class Model:
    """The features of texts: by a broadcast of the ratios up to ``max_grams`` of them, else by a join of word sums."""

    def __init__(self, docs: DataFrame, grams: DataFrame, discount: float, max_grams: int) -> None:
        tops, lows = ratio_tables(grams, discount)
        self.words = self.sent = None
        if tops.count() + lows.count() <= max_grams:
            self.sent = docs.sparkSession.sparkContext.broadcast((lookup_of(tops), lookup_of(lows)))
        else:
            self.words = word_sums(docs, tops, lows)
        freed(tops)

    def features(self, rows: DataFrame, text: bool = False) -> DataFrame:
        """``rows`` (..., ``_which`` model, ``_text``) with the columns x0, x1, x2 in place of ``_which`` and, unless
        ``text``, of the text."""
        keep = [c for c in rows.columns if c not in ("_which", "_text")] + ["_text"] * text
        return self._sent(rows, keep) if self.sent is not None else self._joined(rows, keep)

    def _sent(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        sent, names = self.sent, [f"x{i}" for i in range(FEATURES)]
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        order = [c for c in rows.columns if c not in ("_which", "_text")] + ["_which", "_text"]
        last = len(order) - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, last, 250_000):
                x = text_features(*word_totals(batch.column(last).to_pylist(), batch.column(last - 1).to_numpy(), *sent.value))
                columns = [batch.column(order.index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x[:, i]) for i in range(FEATURES))], [*keep, *names])

        return rows.select(*order).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{c} double" for c in names]))

    def _joined(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Each distinct text's words go, with their places, to the word sums, and the sums back to the text."""
        models = range(len(MODELS))
        rows = rows.withColumns({"_h1": F.xxhash64("_text"), "_h2": F.xxhash64(F.lit(1), "_text")})

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 2):
                for h1, h2, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    word, size, _ = named_words([text])
                    if len(word):
                        order = np.argsort(word, kind="stable")
                        cut = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0])
                        spots = [x.astype(np.int32).tobytes() for x in np.split(order, cut[1:])]
                        columns = [np.full(len(cut), h1), np.full(len(cut), h2), word[order[cut]].view(np.int64), size[order[cut]]]
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(c, pa.int64()) for c in columns), pa.array(spots, pa.binary())], ["h1", "h2", "w", "size", "at"])

        def gather(group: pa.Table) -> pa.Table:
            at = [np.frombuffer(b, np.int32) for b in group.column("at").to_pylist()]
            times, flat = [len(x) for x in at], np.concatenate(at)
            spread = lambda name: np.repeat(group.column(name).to_numpy(), times)[np.argsort(flat)]
            x = [text_features(spread(f"r{m}"), spread("size"), np.array([len(flat)]))[0] for m in models]
            return pa.table({"_h1": group.column("h1")[:1], "_h2": group.column("h2")[:1],
                             "x": pa.array([np.concatenate(x).tolist()], pa.list_(pa.float64()))})

        spots = rows.select("_h1", "_h2", "_text").mapInArrow(places, "h1 bigint, h2 bigint, w bigint, size bigint, at binary") \
            .dropDuplicates(["h1", "h2", "w"])
        found = spots.join(self.words, "w").groupBy("h1", "h2").applyInArrow(gather, "_h1 bigint, _h2 bigint, x array<double>")
        return rows.join(found, ["_h1", "_h2"], "left").select(*[F.col(f"`{c}`") for c in keep], *[
            F.coalesce(F.get("x", F.col("_which") * FEATURES + i), F.lit(0.0)).alias(f"x{i}") for i in range(FEATURES)])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_grams: int = MAX_GRAMS):
    """(model, logistic) or None without rows of both classes."""
    rows = learning_rows(docs, labels, id_col, label_col)
    grams = landed(count_grams(rows))
    once, twice, toxic, ordinary = grams.agg(
        F.count_if(F.col("total") == 1), F.count_if(F.col("total") == 2), F.sum(F.col("t0") + F.col("t1")),
        F.sum(F.col("o0") + F.col("o1"))).first()
    if not (toxic and ordinary):
        return None
    model = Model(docs, grams, once / (once + 2 * twice) if once and twice else 0.75, max_grams)
    freed(grams)

    # a bounded sample of the learning rows, spread by a hash of the text: all of them, or toxic ones up to half of it
    kind = F.col("toxic") > 0
    have = {bool(r.kind): r.n for r in rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}
    shares = fit_shares(have.get(True, 0), have.get(False, 0), MAX_FIT)
    spread = F.pmod(F.xxhash64(F.lit(1), "_text"), F.lit(1_000_000))
    chosen = rows.where(spread < F.when(kind, F.lit(shares[0] * 1e6)).otherwise(F.lit(shares[1] * 1e6))) if min(shares) < 1 else rows
    got = _fit_rows(model, chosen)
    for toxic_ in (True, False):  # a class whose texts are all alike may have no hash below its share
        if not ((got.y > 0) == toxic_).any():
            got = pd.concat([got, _fit_rows(model, rows.where(kind == F.lit(toxic_)).limit(1))])
    got = got.sort_values(list(got.columns))
    x, y = got.drop(columns="y").to_numpy(), (got.y > 0).to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    mean, scale, w = fit(x, y)
    w[-1] -= np.log(shares[0] / shares[1])  # toxic rows are more frequent in the sample than among the learning rows
    return model, (mean, scale, w)


def fit_shares(toxic: int, ordinary: int, most: int) -> tuple[float, float]:
    """Shares of the toxic and of the other rows that a sample of about ``most`` rows takes: toxic ones fill up to half of
    it, the others the rest."""
    if toxic + ordinary <= most:
        return 1.0, 1.0
    share = min(1.0, most / 2 / max(1, toxic))
    return share, min(1.0, (most - toxic * share) / max(1, ordinary))


def _fit_rows(model: Model, rows: DataFrame) -> pd.DataFrame:
    """Features and class of some learning rows."""
    sample = rows.select(F.col("toxic").alias("y"), (F.col("fold") + 1).alias("_which"), "_text")
    return model.features(sample).select(*[f"x{i}" for i in range(FEATURES)], "y").toPandas()


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          threshold: float = THRESHOLD, keep: tuple[str, ...] = (), max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row per document: key, ``held_out``, ``score``, ``predicted``, ``ratio`` (of the whole text, per
    character). ``keep``: further columns of ``df`` to pass through."""
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
                     *[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep) if c != text_col],
                     F.col(f"`{text_col}`").isNull().alias("_null"))
    learnt = learn(docs.select("_id", "_text"), labels, id_col, label_col, max_grams)
    if learnt is None:
        out = docs.withColumns({"score": F.lit(0.0), "ratio": F.lit(0.0)})
    else:
        model, (mean, scale, w) = learnt
        # the text itself goes back only if it is asked for
        out = model.features(docs.withColumn("_which", F.lit(0)), text_col in keep)
        z = reduce(Column.__add__, [(F.col(f"x{i}") - F.lit(float(mean[i]))) / F.lit(float(scale[i])) * F.lit(float(w[i]))
                                    for i in range(FEATURES)]) + F.lit(float(w[-1]))
        z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
        out = out.withColumns({"score": F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), "ratio": F.col("x0")})
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "ratio",
                      *[(F.when(~F.col("_null"), F.col("_text")) if c == text_col else F.col(f"k_{i}")).alias(c)
                        for i, c in enumerate(keep)])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learnt from ``labels.toxic``."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
