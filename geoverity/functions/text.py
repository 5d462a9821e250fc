"""String column expressions that match Python ``str`` semantics where it matters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Python's str.isspace() set: Unicode White_Space plus the \x1c-\x1f separators.
_WS = r"[\s\x1c-\x1f]"
_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
             + "\u2028\u2029\u202f\u205f\u3000")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def kept_texts(items: list[tuple[Column, Column]]) -> Column:
    """Array of the texts whose condition holds, in order. A concatenation, which is compiled, where a filter over an
    array would be interpreted with all that the texts are made of. A text must not be NULL where its condition holds."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(c, F.array(x)).otherwise(none) for c, x in items])


def bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once however often ``f`` reads it (the variable of a transform): the planner copies
    an expression into each place that names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def py_strip(x) -> Column:
    """``str.strip()``: looks at a text's two ends only."""
    return F.btrim(_c(x), F.lit(_WS_CHARS))


def strip_column(x) -> Column:
    """``py_strip`` of a column: a text that begins and ends with a visible ASCII character is left as it is, since
    trimming looks up each end in all kinds of space."""
    x = _c(x)
    return F.when(F.substring(x, 1, 1).between("!", "~") & F.substring(x, -1, 1).between("!", "~"), x).otherwise(py_strip(x))


def clean_string(x) -> Column:
    """Collapse whitespace runs to one space, strip, then drop NUL characters.

    NULL or empty -> "".
    """
    v = F.coalesce(_c(x).cast("string"), F.lit(""))
    v = py_strip(F.regexp_replace(v, rf"(?U){_WS}+", " "))
    return F.replace(v, F.lit("\x00"), F.lit(""))


def parse_float(x) -> Column:
    """Python ``float(str)`` or NULL. Spark also accepts a ``d``/``f`` suffix
    (``1d``), Python does not, so those are rejected before the cast."""
    s = py_strip(_c(x).cast("string"))
    ok = ~s.rlike(r"[dDfF]$") | s.rlike(r"(?i)^[+-]?inf$")
    return F.when(ok, s.try_cast("double"))


def country_map() -> Column:
    """Literal map lower-case variant -> canonical form."""
    kv = []
    seen = set()
    for canonical, variants in K.COUNTRY_ALIASES.items():
        for v in list(variants) + [canonical.lower()]:
            if v not in seen:
                seen.add(v)
                kv += [F.lit(v), F.lit(canonical)]
    return F.create_map(*kv)


def normalize_country(x) -> Column:
    """Alias lookup on ``lower(strip(x))`` else ``upper(strip(x))``; empty -> ""."""
    v = F.coalesce(_c(x), F.lit(""))
    key = F.lower(strip_column(v))
    return F.when(v == "", F.lit("")).otherwise(
        F.coalesce(F.element_at(country_map(), key), F.upper(key)))


def strip_noise_words(x) -> Column:
    """Split on whitespace, drop noise words (case-insensitive), rejoin with one space."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(py_strip(_c(x)), rf"(?U){_WS}+", " "))  # one space before each word
    return F.substring(F.regexp_replace(spaced, rf"(?i) (?:{'|'.join(K.NOISE_WORDS)})(?= |\z)", ""), 2, 1 << 30)


def lower_words(x) -> Column:
    """Distinct whitespace tokens of an (already folded) string."""
    return F.array_distinct(F.array_remove(F.split(_c(x), " "), ""))


def alias_detected(words_a, words_b) -> Column:
    """Both word sets hit some alias group and their hit sets differ
    (arguments: distinct word arrays of the folded names)."""
    known = F.array(*[F.lit(a) for a in sorted({a for aliases in K.SCHOOL_ALIASES.values() for a in aliases})])

    def hits(w):
        """On the aliases among the words only: where these are equal, or one side has none, no group can differ."""
        def hit(aliases):
            g = F.array(*[F.lit(a) for a in aliases])
            return (F.arrays_overlap(w["a"], g) & F.arrays_overlap(w["b"], g)
                    & (F.sort_array(F.array_intersect(w["a"], g)) != F.sort_array(F.array_intersect(w["b"], g))))
        return F.when((F.size(w["a"]) == 0) | (F.size(w["b"]) == 0) | (F.sort_array(w["a"]) == F.sort_array(w["b"])), False) \
            .otherwise(reduce(lambda a, b: a | b, [hit(aliases) for aliases in K.SCHOOL_ALIASES.values()]))

    return bound(F.struct(F.array_intersect(_c(words_a), known).alias("a"), F.array_intersect(_c(words_b), known).alias("b")), hits)


def transliteration_match(folded_a, folded_b) -> Column:
    """Character-set overlap / larger set size > 0.7 (space counts as a character)."""
    a, b = _c(folded_a), _c(folded_b)
    sets = F.struct(F.array_distinct(F.split(a, "")).alias("a"), F.array_distinct(F.split(b, "")).alias("b"))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(False)).when(a == b, F.lit(True)).otherwise(
        bound(sets, lambda s: F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(F.size(s["a"]), F.size(s["b"])) > 0.7))


def format_bytes(x) -> Column:
    """B/KB/MB/GB/TB with one decimal, dividing by 1024 until below 1024."""
    v = _c(x).cast("double")
    out = None
    for i, unit in enumerate(["B", "KB", "MB", "GB"]):
        scaled = v / F.lit(1024.0 ** i)
        cond = scaled < 1024
        txt = F.concat(py_fixed(scaled, 1), F.lit(f" {unit}"))
        out = F.when(cond, txt) if out is None else out.when(cond, txt)
    return out.otherwise(F.concat(py_fixed(v / F.lit(1024.0 ** 4), 1), F.lit(" TB")))


def format_duration(x) -> Column:
    """``12.3s`` below a minute, else ``2m 3.4s``."""
    v = _c(x).cast("double")
    mins = F.floor(v / 60).cast("long")
    return F.when(v < 60, F.concat(py_fixed(v, 1), F.lit("s"))).otherwise(
        F.concat(mins.cast("string"), F.lit("m "), py_fixed(v - mins * 60, 1), F.lit("s")))

def py_float_repr(x) -> Column:
    """Python ``repr(float)`` text of a double column.

    Spark (like Java) prints the shortest round-trip digits but switches to
    ``d.dddE<n>`` outside [1e-3, 1e7); Python switches outside [1e-4, 1e16) and
    writes ``e-05`` / ``e+16``. The digits are the same; only the layout is
    rewritten here."""
    v = _c(x)
    s = v.cast("string")
    sci = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign = F.regexp_extract(s, sci, 1)
    d0 = F.regexp_extract(s, sci, 2)
    frac = F.regexp_extract(s, sci, 3)
    exp = F.regexp_extract(s, sci, 4)
    e = F.when(exp != "", exp.cast("int"))
    frac_t = F.when(frac == "0", F.lit("")).otherwise(frac)
    digits = F.concat(d0, frac_t)
    nint = e + 1
    small = F.concat(sign, F.lit("0.000"), digits)                  # 1e-4 <= |x| < 1e-3
    big = F.when(F.length(digits) <= nint,                           # 1e7 <= |x| < 1e16
                 F.concat(sign, F.rpad(digits, 64, "0").substr(F.lit(1), nint), F.lit(".0"))).otherwise(
        F.concat(sign, digits.substr(F.lit(1), nint), F.lit("."), digits.substr(nint + 1, F.lit(64))))
    mant = F.concat(d0, F.when(frac_t != "", F.concat(F.lit("."), frac_t)).otherwise(F.lit("")))
    pysci = F.concat(sign, mant, F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                     F.lpad(F.abs(e).cast("string"), 2, "0"))
    return (F.when(v.isNull(), F.lit(None).cast("string"))
             .when(F.isnan(v), F.lit("nan"))
             .when(v == float("inf"), F.lit("inf")).when(v == float("-inf"), F.lit("-inf"))
             .when(~s.contains("E"), s)
             .when(e == -4, small)
             .when((e >= 7) & (e <= 15), big)
             .otherwise(pysci))


def py_fixed(x, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"``: Java's ``%.nf`` rounds half-up on the
    shortest decimal form, ``format_number`` (DecimalFormat, half-even on the
    exact binary value) rounds like Python; its grouping commas are removed."""
    v = _c(x).cast("double")
    return (F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), F.lit("nan"))
             .when(v == float("inf"), F.lit("inf")).when(v == float("-inf"), F.lit("-inf"))
             .otherwise(F.replace(F.format_number(v, digits), F.lit(","), F.lit(""))))


def url_query_params(url) -> Column:
    """Query string after the first ``?``, cut at ``#``, split on ``&``; each
    ``k=v`` (split at the first ``=``) URL-decoded; the last duplicate key wins.
    ``+`` stays literal (percent-decoding only), so it is escaped first."""
    u = _c(url)
    qs = F.when(F.instr(u, "?") > 0, F.regexp_extract(u, r"^[^?]*\?([^#]*)", 1))
    parts = F.filter(F.split(qs, "&"), lambda p: F.instr(p, "=") > 0)

    def dec(s):
        return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
    entries = F.transform(parts, lambda p: F.struct(
        dec(F.substring_index(p, "=", 1)).alias("key"),
        dec(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value")))
    return last_wins_map(entries)


def spread_id(id_col, row_col) -> Column:
    """Join key of a row whose id may be empty: an empty id matches nothing, so each
    such row gets a key of its own instead of all of them meeting in one task."""
    i, r = _c(id_col), _c(row_col)
    return F.when(F.coalesce(i, F.lit("")) != "", i).otherwise(F.concat(F.lit("\x00"), r.cast("string")))


def last_wins_map(entries: Column) -> Column:
    """Map of ``(key, value)`` entries, the last of equal keys kept (independent
    of the session's mapKeyDedupPolicy)."""
    def last(all_):
        return F.filter(all_, lambda e, i: ~F.exists(
            F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(1))),
            lambda x: (x["key"] == e["key"]) & (F.size(all_) > i + 1)))

    # entries are made once, and compared with each other only if some key stands there twice
    apart = lambda all_: F.size(F.array_distinct(F.array_compact(all_["key"]))) == F.size(all_)
    return bound(entries, lambda all_: F.map_from_entries(F.when(apart(all_), all_).otherwise(last(all_))))


_NUM = r"-?\d+\.\d{2,8}"


def detect_url_template(value) -> Column:
    """URL -> template with ``{lat}``/``{lng}`` placeholders, or NULL.

    http(s) only. First, the first ``<lat><sep><lng>`` pair (2-8 decimals,
    separator ``[,%]2?C?``) if both are valid coordinates; the separator kept is
    the one found by re-scanning the matched text after the latitude. Else the
    first ``lat``/``latitude`` and ``lng``/``lon``/``longitude`` query values
    (case-insensitive keys); both are substituted whatever their order."""
    v = py_strip(_c(value))
    is_url = v.startswith("http://") | v.startswith("https://")
    p1 = rf"(?s)^(.*?)({_NUM})([,%]2?C?)({_NUM})(.*)$"
    pre, la, lo, post = (F.regexp_extract(v, p1, i) for i in (1, 2, 4, 5))
    whole = F.regexp_extract(v, rf"{_NUM}[,%]2?C?{_NUM}", 0)
    sep = F.regexp_extract(F.substring(whole, F.length(la) + 1, 1 << 30), r"[,%]2?C?", 0)
    ok1 = (whole != "") & la.cast("double").between(-90, 90) & lo.cast("double").between(-180, 180)
    t1 = F.concat(pre, F.lit("{lat}"), sep, F.lit("{lng}"), post)
    plat = rf"(?s)^(.*?[?&])((?i:lat|latitude))=({_NUM})(.*)$"
    plng = rf"(?s)^(.*?[?&])((?i:lng|lon|longitude))=({_NUM})(.*)$"
    lat_v = F.regexp_extract(v, plat, 3)
    lng_v = F.regexp_extract(v, plng, 3)
    ok2 = (lat_v != "") & (lng_v != "") & lat_v.cast("double").between(-90, 90) & \
        lng_v.cast("double").between(-180, 180)
    s1 = F.concat(F.regexp_extract(v, plat, 1), F.regexp_extract(v, plat, 2), F.lit("={lat}"),
                  F.regexp_extract(v, plat, 4))
    t2 = F.concat(F.regexp_extract(s1, plng, 1), F.regexp_extract(s1, plng, 2), F.lit("={lng}"),
                  F.regexp_extract(s1, plng, 4))
    return (F.when(~is_url | v.isNull(), F.lit(None).cast("string"))
             .when(ok1, t1).when(ok2, t2))
