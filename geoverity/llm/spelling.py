"""Spelling variant grouping with PartEnum signatures.

Words of a corpus are counted (a run of letters whose hash falls on one of ``drop_every`` loses a letter, as the
contract of the query asks; 0 leaves all runs as they are). Two words are near if one edit tells them apart.

One edit changes the multiset of a word's letters by one letter (insertion, deletion) or two (replacement). Seen as a
binary vector over (letter, occurrence), near words have a Hamming distance of at most two. PartEnum: the positions of
these vectors are dealt to ``PARTS`` parts by a hash; of two vectors at distance two or less some ``PARTS - 2`` parts
are equal, so every choice of ``PARTS - 2`` parts gives a signature, and near words share one. The equi-join on
signatures is exact; each pair is then verified.

Letter multisets of short words are crowded (anagrams, frequent letters), so a signature also holds half of the word:
for near words of lengths m and m or m and m + 1, either the first m // 2 letters are equal or the last m - m // 2.
Each word therefore signs with both halves, for its own length and for one less. That splits the crowded signatures
and loses no pair.

Null or empty texts hold no words; a null key counts as empty text in the hash. Repeated rows count each. Ties of
equally frequent near words go to the smallest word in code-point order. An empty table gives an empty result.
Chains of forms end, as every step goes to a word at least ``ratio`` times as frequent.

All joins are by shuffle (``by_shuffle``): every side grows with the vocabulary, and Spark takes these tables for small.
It goes by their compressed files, and takes the 24 signatures of a word for one row, so it would collect them on the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASES, Rolling, ascii_lower, landed, mix64, table

PARTS = 4
DISTANCE = 2
_LETTERS = r"[^A-Za-z\u00C0-\u00FF]+"  # what stands between runs of letters


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, however small Spark takes it for."""
    return df.hint("merge")


def lowered(run: Column) -> Column:
    """A-Z in lower case; a run of ASCII letters takes the faster way."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(ascii_lower(run))


def count_words(df: DataFrame, id_col: str, text_col: str, least_length: int, least_count: int, drop_every: int) -> DataFrame:
    """(word, n): words of the whole corpus and how often they stand there."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = df.select(F.concat(key, F.lit(":")).alias("k"), F.explode(F.split(F.col(f"`{text_col}`"), _LETTERS)).alias("run"))
    rows = rows.where("run != ''").select("k", lowered(F.col("run")).alias("run"))
    word = F.col("run")
    if drop_every:
        rows = rows.withColumn("h", F.crc32(F.concat("k", "run").cast("binary")))
        at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, signature) of all words, every word under several signatures."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    # the occurrence number of each letter: its place among equal letters of its word
    order = np.lexsort((codes, owner))
    same = np.r_[False, (codes[order][1:] == codes[order][:-1]) & (owner[order][1:] == owner[order][:-1])]
    place = np.arange(len(codes))
    occurrence = place - np.maximum.accumulate(np.where(same, 0, place))
    element = mix64((codes[order] << np.uint64(20)) + occurrence.astype(np.uint64))
    sums = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(sums, (owner[order], (element >> np.uint64(40)).astype(np.int64) % PARTS), element)
    # hashes of first and last halves, for the word's own length and for one less
    letters = Rolling(mix64(codes), BASES[0])
    start, end = np.cumsum(size) - size, np.cumsum(size)
    out = []
    for length in (size, size - 1):
        half = length // 2
        halves = (letters.spans(start, start + half), ~letters.spans(end - (length - half), end))
        for side in halves:
            side = mix64(side ^ mix64(length.astype(np.uint64)))
            for k, chosen in enumerate(combinations(range(PARTS), PARTS - DISTANCE)):
                out.append(mix64(mix64(sums[:, list(chosen)].sum(axis=1, dtype=np.uint64) + np.uint64(k)) ^ side))
    return np.tile(np.arange(len(words)), len(out)), np.concatenate(out)


def signature_rows(words: DataFrame) -> DataFrame:
    """(sig, word) of a table of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.column(0).slice(at, 20_000)
                index, sig = signatures(part.to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), part.take(pa.array(index))], ["sig", "word"])

    return words.select("word").mapInArrow(run, "sig bigint, word string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): pairs a < b of words that one edit tells apart, each once."""
    rows = signature_rows(words)
    a, b = rows.select("sig", F.col("word").alias("a")), rows.select("sig", F.col("word").alias("b"))
    one_edit = (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(by_shuffle(b), "sig").where(one_edit).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: every round doubles the stretch that a word has followed."""
    state = landed(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("far"))
        further = state.join(by_shuffle(ahead), "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        further = landed(further)
        state = further.select("word", "root")
        if further.where("moved").isEmpty():
            return state


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5,
             ratio: int = 5, drop_every: int = 0) -> DataFrame:
    """One row per word of at least ``least_length`` code points and ``least_count`` occurrences: word, form (its most
    frequent near word, if ``ratio`` times as frequent), root (the end of its chain of forms), n, n_near, form_n."""
    words = landed(count_words(df, id_col, text_col, least_length, least_count, drop_every))
    pairs = landed(near_pairs(words))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    counted = both.join(by_shuffle(words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("top"))
    best = best.select("word", "n_near", (-F.col("top.col1")).alias("top_n"), F.col("top.near").alias("top"))
    frequent = F.col("top_n") >= ratio * F.col("n")
    formed = landed(words.join(by_shuffle(best), "word", "left").select(
        "word", F.when(frequent, F.col("top")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("top_n")).alias("form_n")))
    return formed.join(by_shuffle(roots(formed)), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of ``documents``; one of 199 runs loses a letter first."""
    return variants(table(spark, sf_dir, "documents"), drop_every=199)


#: crc32 is spelt out: its table follows from the polynomial, and a run's bytes are folded over it.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS k,
         translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT k, run, count(*) AS times, hex(encode(k || ':' || run)) AS bytes FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, times,
         xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT,
                        list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc_table),
cut AS (
  SELECT times, CASE WHEN h % 199 = 0
                     THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
holes AS (
  SELECT word, unnest(range(1, length(word) + 1)) AS i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM words),
pairs AS (
  SELECT a.word AS word, b.word AS near FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word != b.word
  UNION SELECT a.word, b.word FROM holes a JOIN words b ON a.hole = b.word
  UNION SELECT b.word, a.word FROM holes a JOIN words b ON a.hole = b.word),
best AS (
  SELECT p.word, count(*) AS n_near, max(w.n) AS top_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top_n >= 5 * w.n THEN b.top_n END AS form_n,
         (SELECT min(p.near) FROM pairs p JOIN words v ON v.word = p.near WHERE p.word = w.word AND v.n = b.top_n) AS top
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.top FROM chain c JOIN formed f ON f.word = c.root WHERE f.form_n IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form_n IS NULL)
SELECT f.word, CASE WHEN form_n IS NOT NULL THEN top END AS form, root, n, n_near, form_n
FROM formed f JOIN ends e ON e.word = f.word
"""
