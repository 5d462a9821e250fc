"""Geographic column expressions (all native, whole-stage-codegen friendly)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km, atan2 form, R = 6371.0."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2))
    return F.lit(K.EARTH_RADIUS_KM) * (2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def on_land(lat, lon) -> Column:
    """True when the point lies in any continent box (bounds inclusive)."""
    lat, lon = _c(lat), _c(lon)
    tests = [lat.between(mn_lat, mx_lat) & lon.between(mn_lon, mx_lon)
             for (mn_lat, mn_lon, mx_lat, mx_lon) in K.CONTINENT_BOXES.values()]
    return reduce(lambda a, b: a | b, tests)


def _decimals(x: Column) -> Column:
    """Decimals left in ``%.6f`` (half-even on the exact binary value) after
    stripping trailing zeros; 3 for "nan" and "inf", which have no point. The
    point's right side holds no grouping commas, so none are removed."""
    frac = F.rtrim(F.substring_index(F.format_number(F.abs(x), 6), ".", -1), F.lit("0"))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(3)).otherwise(F.length(frac))


def coordinate_precision(lat, lon) -> Column:
    """Average decimals of ``%.6f`` with trailing zeros stripped, / 6, capped at 1."""
    lat, lon = _c(lat), _c(lon)
    avg = (_decimals(lat) + _decimals(lon)) / 2.0
    return F.least(F.lit(1.0), avg / 6.0)


def city_centre(city) -> Column:
    """(lat, lon) of the known centre of ``lower(city)``; NULL for unknown cities. A literal map, looked up once."""
    kv = [x for name, (lat, lon) in K.CITY_CENTRES.items()
          for x in (F.lit(name), F.struct(F.lit(lat).cast("double").alias("lat"), F.lit(lon).cast("double").alias("lon")))]
    return F.element_at(F.create_map(*kv), F.lower(F.coalesce(_c(city), F.lit(""))))


def distance_from_city_centre(city, lat, lon) -> Column:
    """Haversine to the known centre of ``lower(city)``; NULL for unknown cities.
    The 23-entry table is a constant map (no join)."""
    centre = city_centre(city)
    return F.when(centre.isNotNull(), haversine_km(lat, lon, centre["lat"], centre["lon"]))
