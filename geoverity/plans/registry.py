"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``
over the whole stand-in tables, plus the equivalent DuckDB SQL where the
operator is SQL-expressible (the oracle). Doubles are rounded to 6 dp on both
sides so that last-bit differences of trig functions do not decide a hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_views(sql, *views)
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column (top level) to 6 decimals."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), 6).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# SQL snippets shared by oracle texts --------------------------------------
def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(6371.0 * (2 * atan2(sqrt({a}), sqrt(1 - {a}))))"


def on_land_sql(lat: str, lon: str) -> str:
    from .. import constants as K
    parts = [f"({lat} BETWEEN {a} AND {c} AND {lon} BETWEEN {b} AND {d})"
             for (a, b, c, d) in K.CONTINENT_BOXES.values()]
    return "(" + " OR ".join(parts) + ")"


def decimals_sql(x: str) -> str:
    s = f"rtrim(printf('%.6f', {x}), '0')"
    return f"(CASE WHEN strpos({s}, '.') > 0 THEN length(split_part({s}, '.', 2)) ELSE 0 END)"


def precision_sql(lat: str, lon: str) -> str:
    return f"least(1.0, (({decimals_sql(lat)} + {decimals_sql(lon)}) / 2.0) / 6.0)"
