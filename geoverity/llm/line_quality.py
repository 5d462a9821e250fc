"""Quality rules: cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits to 0, white space squeezed) and
hashed. For each host the distinct documents that hold a line are counted, exact
copies of a text among them (a document is a key with a text; a repeated row is
the same document). Lines above the limits are removed, and a document that loses
too much of its words is rejected. Built-in functions only.

Only hashes are shuffled: (host, text hash, line hash, words) in, and one removed
word count per (host, text hash) back. A line that stands in a third of all
documents is pre-aggregated before each exchange, and the join back is one that
Spark may split. Null text: no words. Null host: a host of its own. Repeated rows
get the same result each. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_col

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
#: A line is boilerplate of its host in more than both so many and such a share of its documents.
MAX_DOCS, MAX_SHARE = 20, 0.02
#: A document is depleted when more than this share of its words stood in removed lines.
MAX_REMOVED = 0.5
WINDOW = 8


_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "123456789" + "\t\x0b\f\r"
_TO = "abcdefghijklmnopqrstuvwxyz" + "000000000" + "    "


def _squeezed(line: Column) -> Column:
    return F.trim(F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, "  +", " ")).otherwise(line))


def line_hash(line: Column) -> Column:
    """Hash of a line with A-Z lower-cased, digits as 0 and white space squeezed."""
    return F.xxhash64(_squeezed(F.translate(line, _FROM, _TO)))


def hashed_lines(text: Column) -> Column:
    """[(line_hash, words)] of the lines with a word; a normalised line has a space between any two words."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), "\n", -1)
    normal = F.filter(F.transform(lines, _squeezed), lambda x: x != "")
    return F.transform(normal, lambda x: F.struct(
        F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))


def lines_col(text: Column) -> Column:
    """\\n-split lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.translate(x, WHITE, "") != "")


def base_columns(df: DataFrame) -> DataFrame:
    """Adds the base counts of a text column ``_text``; n log n in the words of a text."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    df = df.withColumns({
        "_grams": F.transform(words_col(text), lambda w: F.xxhash64(w)),
        "_lines": lines_col(text),
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("_grams").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_win": F.when(F.size("_grams") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_grams") - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.element_at("_grams", i + k) for k in range(WINDOW)]))),
    })
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_win")) < F.size("_win"),
        F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # neighbours in the sorted list are compared by zipping it with itself, shifted
    df = df.withColumn("_pairs", F.when(F.col("_sorted").isNotNull(), F.arrays_zip(
        F.col("_sorted").alias("a"),
        F.concat(F.slice("_sorted", 2, F.greatest(F.size("_sorted") - 1, F.lit(0))), F.array(F.lit(None))).alias("b"),
        F.concat(F.array(F.lit(None)), F.col("_sorted")).alias("c"))))
    at = F.sort_array(F.transform(
        F.filter("_pairs", lambda x: F.coalesce(x["a"]["h"] == x["b"]["h"], F.lit(False))
                 | F.coalesce(x["a"]["h"] == x["c"]["h"], F.lit(False))), lambda x: x["a"]["i"]))
    df = df.withColumn("_at", at)
    covered = F.aggregate(
        "_at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")) \
        .drop("_grams", "_lines", "_win", "_sorted", "_pairs", "_at")


def removed_lines(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(_host, _th, line, words): lines above the limits, in each distinct text that holds them."""
    held = (docs.select("_host", "_th", F.explode(hashed_lines(F.col("_text"))).alias("x"))
            .groupBy("_host", "_th", F.col("x.line").alias("line"))
            # repeated rows repeat a text: the words of one copy are what counts
            .agg(F.sum("x.w").alias("w"), F.count("*").alias("times")))
    copies = (docs.groupBy("_host", "_th", "_id").agg(F.count("*").alias("n"))
              .groupBy(F.col("_host").alias("k_host"), F.col("_th").alias("k_th"))
              .agg(F.sum("n").alias("copies"), F.count("*").alias("documents")))
    hosts = copies.groupBy(F.col("k_host").alias("h_host")).agg(F.sum("documents").alias("all"))
    same = F.col("_host").eqNullSafe(F.col("k_host")) & (F.col("_th") == F.col("k_th"))
    # nearly all texts are one document: only the others are joined to their lines
    several = copies.where("documents > 1")
    common = (held.join(several, same, "left").groupBy("_host", "line")
              .agg(F.sum(F.coalesce("documents", F.lit(1))).alias("n")).where(F.col("n") > max_docs)
              .join(hosts, F.col("_host").eqNullSafe(F.col("h_host")))
              .where(F.col("n") > F.lit(max_share) * F.col("all")).select("_host", "line"))
    c = common.select(F.col("_host").alias("c_host"), F.col("line").alias("c_line"))
    return (held.join(c, F.col("line").eqNullSafe(F.col("c_line")) & F.col("_host").eqNullSafe(F.col("c_host")),
                      "left_semi")
            .join(copies, same)
            .select("_host", "_th", "line", (F.col("w") / F.col("copies")).cast("long").alias("w")))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED,
          with_text: bool = False) -> DataFrame:
    """One row per document: key, base counts, ``base_failed``, ``n_removed_words``, ``kept``;
    with ``with_text`` also ``cleaned``: the text without the removed lines."""
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"),
                     F.col(f"`{host_col}`").alias("_host")) \
        .withColumn("_th", F.xxhash64(F.coalesce("_text", F.lit(""))))
    lost = removed_lines(docs, max_docs, max_share).groupBy(F.col("_host").alias("l_host"), F.col("_th").alias("l_th"))
    lost = lost.agg(F.sum("w").alias("lost"), *([F.collect_set("line").alias("gone")] if with_text else []))
    base = base_columns(docs)
    if not with_text:
        base = base.drop("_text")
    out = base.join(lost, F.col("_th").eqNullSafe(F.col("l_th")) & F.col("_host").eqNullSafe(F.col("l_host")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lost_words = F.coalesce("lost", F.lit(0)).cast("long")
    columns = [F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               failed.alias("base_failed"), (~failed & (lost_words <= F.lit(max_removed) * F.col("n_words"))).alias("kept"),
               lost_words.alias("n_removed_words")]
    if with_text:
        columns.append(F.array_join(F.filter(
            F.split(F.coalesce("_text", F.lit("")), "\n", -1),
            lambda x: F.col("gone").isNull() | (F.translate(x, WHITE, "") == "")
            | ~F.array_contains("gone", line_hash(x))), "\n").alias("cleaned"))
    return out.select(*columns)


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every whole text of ``documents``."""
    return judge(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 7], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM w) x),
twice AS (SELECT doc_id, h FROM win GROUP BY doc_id, h HAVING count(*) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 8)) AS i
        FROM win JOIN twice USING (doc_id, h)) x GROUP BY doc_id),
line AS (SELECT doc_id, source, t, x AS raw, trim(regexp_replace(translate(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '123456789', '000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, source, t, unnest(ls) AS x FROM w) y),
hosts AS (SELECT source, count(DISTINCT doc_id) AS n FROM d GROUP BY source),
common AS (SELECT l.source, l.norm FROM line l JOIN hosts s ON s.source IS NOT DISTINCT FROM l.source
  GROUP BY l.source, l.norm, s.n HAVING count(DISTINCT l.doc_id) > {MAX_DOCS} AND count(DISTINCT l.doc_id) > {MAX_SHARE} * s.n),
lost AS (SELECT l.doc_id, sum(len(list_filter(regexp_split_to_array(raw, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS n
  FROM line l JOIN common c ON c.norm = l.norm AND c.source IS NOT DISTINCT FROM l.source GROUP BY l.doc_id),
base AS (SELECT w.doc_id, len(ws) AS n_words, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_removed_words <= {MAX_REMOVED} * n_words AS kept, n_removed_words FROM judged"""
