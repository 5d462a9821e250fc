"""String similarity: Indel ratio, token-set ratio and Unicode folding.

Spark has no LCS-based similarity (``levenshtein`` is a different metric) and no
NFKD normalisation, so these are the one family of Arrow UDFs in the
engine. The column helpers at the bottom keep the UDFs off the hot path: cheap
arms (empty input, equal after folding) are decided natively, and the UDF only
receives non-NULL arguments for the rows that need it (NULLs cross Arrow as a
validity bit). Inside a worker, repeated pairs hit a per-process cache.

Definitions (the common ones for these metrics):
* ``indel_ratio(a, b) = 100 * 2 * LCS(a, b) / (len a + len b)``; 100 for two
  empty strings.
* ``token_set_ratio``: tokens = whitespace split sets; either empty -> 0; a
  non-empty intersection with one side fully contained -> 100; otherwise the
  best of ratio(sect+a, sect+b), ratio(sect, sect+a), ratio(sect, sect+b) over
  the sorted, space-joined token lists.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound, py_strip

_WS_RE = re.compile(r"\s+")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel (one big-int
    update per character of ``b``)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    return 100.0 * 2.0 * lcs_length(a, b) / total


def _norm_sim(dist: int, lensum: int) -> float:
    return 100.0 * (1.0 - dist / lensum) if lensum else 100.0


def token_set_ratio(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    sect = ta & tb
    only_a, only_b = ta - tb, tb - ta
    if sect and (not only_a or not only_b):
        return 100.0
    ja, jb = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    sect_len = len(" ".join(sorted(sect)))
    glue = 1 if sect_len else 0
    ab_len = sect_len + glue + len(ja)
    ba_len = sect_len + glue + len(jb)
    dist = len(ja) + len(jb) - 2 * lcs_length(ja, jb)
    best = _norm_sim(dist, ab_len + ba_len)
    if not sect_len:
        return best
    r_a = _norm_sim(glue + len(ja), sect_len + ab_len)
    r_b = _norm_sim(glue + len(jb), sect_len + ba_len)
    return max(best, r_a, r_b)


def unicode_fold(text: str | None) -> str:
    """NFKD, drop combining marks, lower, strip, collapse whitespace."""
    if not text:
        return ""
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if not unicodedata.combining(c))
    return _WS_RE.sub(" ", t.lower().strip())


@lru_cache(maxsize=1 << 16)
def fuzzy_similarity(q: str, t: str) -> float:
    """0..1: fold both; empty -> 0; equal -> 1; else token-set ratio / 100."""
    if not q or not t:
        return 0.0
    fq, ft = unicode_fold(q), unicode_fold(t)
    if not fq or not ft:
        return 0.0
    if fq == ft:
        return 1.0
    return token_set_ratio(fq, ft) / 100.0


@lru_cache(maxsize=1 << 16)
def _cached_indel(a: str, b: str) -> float:
    return indel_ratio(a, b)


@lru_cache(maxsize=1 << 16)
def _cached_tsr(a: str, b: str) -> float:
    return token_set_ratio(a, b)


def _pairwise(fn, a: pa.Array, b: pa.Array) -> pa.Array:
    if a.null_count == len(a) or b.null_count == len(b):  # all decided natively
        return pa.nulls(len(a), pa.float64())
    return pa.array([None if (x is None or y is None) else fn(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())],
                    pa.float64())


@F.arrow_udf(T.DoubleType())
def indel_ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(_cached_indel, a, b)


@F.arrow_udf(T.DoubleType())
def token_set_ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(_cached_tsr, a, b)


@F.arrow_udf(T.DoubleType())
def fuzzy_similarity_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(fuzzy_similarity, a, b)


@F.arrow_udf(T.StringType())
def unicode_fold_udf(a: pa.Array) -> pa.Array:
    if a.null_count == len(a):
        return pa.nulls(len(a), pa.string())
    return pa.array([None if x is None else unicode_fold(x) for x in a.to_pylist()], pa.string())


# ---------------------------------------------------------------------------
# Column helpers. Measured on 600k candidate rows, the Arrow UDF (with its
# per-worker cache of repeated pairs) costs less than native regex/array
# pre-checks of folding, so only empty and equal texts are decided natively and
# the UDF receives NULL (a validity bit) for those rows.
# ---------------------------------------------------------------------------
_ASCII = r"^[\x00-\x7F]*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_fold(x) -> Column:
    """``unicode_fold`` for ASCII input, natively (NFKD is the identity there)."""
    return F.regexp_replace(py_strip(F.lower(_c(x))), r"[\s\x1c-\x1f]+", " ")


def fold(x) -> Column:
    """``unicode_fold`` (NFKD, drop marks, lower, strip, collapse spaces)."""
    x = F.coalesce(_c(x), F.lit(""))
    return F.when(x == "", F.lit("")).otherwise(unicode_fold_udf(F.when(x != "", x)))


def same_text(q, t) -> Column:
    """Equal texts with an ASCII letter or digit: folding leaves that, so their folds are equal and not empty."""
    q, t = F.coalesce(_c(q), F.lit("")), F.coalesce(_c(t), F.lit(""))
    return (q == t) & q.rlike("[A-Za-z0-9]")


def fuzzy_score(q, t) -> Column:
    """0..1 fuzzy field similarity (fold, empty -> 0, equal -> 1, else token-set / 100)."""
    q = F.coalesce(_c(q), F.lit(""))
    t = F.coalesce(_c(t), F.lit(""))
    empty, same = (q == "") | (t == ""), same_text(q, t)
    asked = ~empty & ~same
    return F.when(empty, F.lit(0.0)).when(same, F.lit(1.0)).otherwise(
        fuzzy_similarity_udf(F.when(asked, q), F.when(asked, t)))


def with_fuzzy(df: DataFrame, out: str, q, t) -> DataFrame:
    return df.withColumn(out, fuzzy_score(q, t))


def ratio(a, b) -> Column:
    """0..100 Indel ratio of two strings used as given (NULL in -> NULL out)."""
    return indel_ratio_udf(_c(a), _c(b))


def token_set(a, b) -> Column:
    """0..100 token-set ratio of two strings used as given."""
    a = F.coalesce(_c(a), F.lit(""))
    b = F.coalesce(_c(b), F.lit(""))
    return token_set_ratio_udf(a, b)


# ---------------------------------------------------------------------------
# Native Indel ratio (JVM-side, evaluated lazily under CASE): bit-parallel LCS
# on one 64-bit word for strings of up to 62 characters, a dynamic-programming
# row scan beyond that. Both are interpreted, some hundred microseconds a pair:
# where a ratio is only tested, ``ratio_holds`` asks for it last.
# ---------------------------------------------------------------------------
def _lcs_bits(a: Column, b: Column) -> Column:
    return bound(F.split(a, ""), lambda chars: _lcs_bits_of(chars, b))


def _lcs_bits_of(chars: Column, b: Column) -> Column:
    m = F.size(chars)
    full = F.pow(F.lit(2.0), m).cast("long") - 1

    def mask(ch):
        return F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0).cast("long"),
                           lambda acc, i: acc.bitwiseOR(F.when(F.element_at(chars, i + 1) == ch,
                                                               F.pow(F.lit(2.0), i).cast("long"))
                                                        .otherwise(F.lit(0).cast("long"))))

    def step(v, ch):
        u = v.bitwiseAND(mask(ch))
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)
    v = F.aggregate(F.split(b, ""), full, step)
    return m - F.bit_count(v)


def _lcs_dp(a: Column, b: Column) -> Column:
    m = F.length(a)
    zero_row = F.array_repeat(F.lit(0), m + 1)

    def row_step(prev, ch):
        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(0)), lambda row, j: F.concat(row, F.array(
            F.when(F.substring(a, j, 1) == ch, F.element_at(prev, j) + 1)
             .otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(row, j))))))
    last = F.aggregate(F.split(b, ""), zero_row, row_step)
    return F.element_at(last, -1)


def lcs_native(a, b) -> Column:
    a = F.coalesce(_c(a), F.lit(""))
    b = F.coalesce(_c(b), F.lit(""))
    return (F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0))
             .when(F.length(a) <= 62, _lcs_bits(a, b)).otherwise(_lcs_dp(a, b)))


def ratio_native(a, b) -> Column:
    """0..100 Indel ratio, natively; NULL in -> NULL out."""
    a, b = _c(a), _c(b)
    total = F.length(a) + F.length(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(total == 0, F.lit(100.0)) \
        .otherwise(200.0 * lcs_native(a, b) / total)


def ratio_holds(a, b, test: Callable[[Column], Column]) -> Column:
    """``test`` of the 0..100 Indel ratio; NULL in -> NULL out. ``test`` must hold for every ratio above one that it
    holds for. The Indel distance lies between the Levenshtein distance, which is compiled, and twice that: only a pair
    that these bounds leave open has its longest common subsequence formed."""
    a, b = _c(a), _c(b)
    total, edits = F.length(a) + F.length(b), F.levenshtein(a, b)
    exact = bound(F.struct(a.alias("a"), b.alias("b")), lambda p: test(ratio_native(p["a"], p["b"])))
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(a == b, test(F.lit(100.0)))
             .when(test(100.0 * (total - 2 * edits) / total), F.lit(True))
             .when(~test(100.0 * (total - edits) / total), F.lit(False)).otherwise(exact))
