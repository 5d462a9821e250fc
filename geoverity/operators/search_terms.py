"""Search-string generation per centre."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import kept_texts, py_strip, strip_noise_words


def _s(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def generate_queries(name="name", city="city", state="state", country="country",
                     address="address", max_queries: int = K.MAX_QUERIES, stripped: bool = False) -> Column:
    """Ordered, de-duplicated list of up to 8 search strings:
    name city country; name city state; name city; name country; name;
    noise-stripped name city country (only if it differs from name);
    address city country; name state country. A template is used only when
    all its parts are non-empty. ``stripped``: the columns are, and hold no NULL."""
    n, c, s, k, a = (_s(x) if stripped else py_strip(_s(x)) for x in (name, city, state, country, address))
    cleaned = strip_noise_words(n)

    def q(*parts, cond=F.lit(True)):
        """A template of stripped parts, so their concatenation needs no stripping."""
        return reduce(lambda x, y: x & y, [x != "" for x in parts], cond), F.concat_ws(" ", *parts)
    return F.slice(F.array_distinct(kept_texts([
        q(n, c, k), q(n, c, s), q(n, c), q(n, k), q(n), q(cleaned, c, k, cond=cleaned != n), q(a, c, k), q(n, s, k)])),
        1, max_queries)


def generate_queries_batch(df: DataFrame) -> DataFrame:
    """Id -> queries; for a repeated id the last centre (highest ``pos``)
    wins. ``max_by`` is a partial (map-side) aggregate, so a hot id is safe."""
    return (df.withColumn("queries", generate_queries())
              .groupBy("id").agg(F.max_by("queries", "pos").alias("queries")))
