"""Cluster centre of a group of points (E16) by counts over cells.

For each group the point with the most other points within a radius is wanted. Equal points are one with a weight.
A group of few places is one row and its places are compared with each other there. The places of the other groups are
put into cells: latitude bands as high as the radius and, in each band, columns as wide as the radius
reaches at its latitude, so what is near a cell lies in the columns next to it. Cells are compared by their bounding
boxes: a cell that lies within the radius as a whole is added as a count, one that lies outside is left out. Only a
pair of cells that the circle crosses needs more: while it has many pairs of points, both cells are cut into quarters
and compared again, round by round; what is left is compared point by point. So a crowded place forms no table of its
pairs: the rounds follow the circles' borders.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import written

#: Pairs of points that two cells, or a group with itself, may have to be compared point by point.
MAX_PAIRS = 256
#: Relative slack of box distances, so that rounding never decides what the points' own distances decide.
SLACK = 1e-9
EARTH_KM = 6371.0
BOX = ["lat0", "lat1", "lon0", "lon1"]


def _sin2(x: Column) -> Column:
    s = F.sin(F.radians(x) / 2)
    return s * s


def _km(a: Column) -> Column:
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def box_distances(a: str, b: str) -> tuple[Column, Column]:
    """(least, largest) great-circle distance that points of two boxes can have."""
    box = lambda x: [F.col(f"{x}.{f}") for f in BOX]
    (a0, a1, ao0, ao1), (b0, b1, bo0, bo1) = box(a), box(b)
    gap = lambda p0, p1, q0, q1: F.greatest(F.lit(0.0), q0 - p1, p0 - q1)
    reach = lambda p0, p1, q0, q1: F.greatest(F.abs(q1 - p0), F.abs(p1 - q0))
    lat_gap, lat_reach = gap(a0, a1, b0, b1), reach(a0, a1, b0, b1)
    lon_gap, lon_reach = gap(ao0, ao1, bo0, bo1), reach(ao0, ao1, bo0, bo1)
    # the sine rises up to half a turn and falls beyond
    low = F.least(_sin2(lon_gap), _sin2(lon_reach))
    high = F.when((lon_gap <= 180) & (lon_reach >= 180), F.lit(1.0)).otherwise(F.greatest(_sin2(lon_gap), _sin2(lon_reach)))
    cos = lambda x: F.cos(F.radians(x))
    least_cos = lambda p0, p1: F.greatest(F.lit(0.0), F.least(cos(p0), cos(p1)))
    most_cos = lambda p0, p1: F.when((p0 <= 0) & (p1 >= 0), F.lit(1.0)).otherwise(F.greatest(cos(p0), cos(p1)))
    return (_km(_sin2(lat_gap) + least_cos(a0, a1) * least_cos(b0, b1) * low),
            _km(_sin2(lat_reach) + most_cos(a0, a1) * most_cos(b0, b1) * high))


def _columns(band: Column, height: float, threshold_km: float) -> Column:
    """Number of columns of a band: each at least as wide as the radius reaches in it and the bands beside it."""
    edge = F.greatest(F.abs(band - 1), F.abs(band + 2)) * height
    share = F.sin(F.lit(threshold_km * 1.0001 / (2 * EARTH_KM))) / F.cos(F.radians(F.least(edge, F.lit(90.0))))
    reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), share)))
    return F.when(edge >= 90, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / reach))).cast("long")


def _column(lon: Column, count: Column) -> Column:
    return F.floor((lon + 180) / 360 * count).cast("long")


def _cells(points: DataFrame) -> DataFrame:
    """(k, cell, n, box) of points (k, la, lo, x, m, cell)."""
    box = F.struct(F.min("la").alias("lat0"), F.max("la").alias("lat1"), F.min("x").alias("lon0"), F.max("x").alias("lon1"))
    return points.groupBy("k", "cell").agg(F.sum("m").alias("n"), F.count("*").alias("points"), box.alias("box"))


def _sorted_out(pairs: DataFrame, threshold_km: float) -> DataFrame:
    """Pairs of cells (k, a, b, na, nb, ...) with ``whole``: b lies within the radius of all of a (true), or the circle
    crosses it (false). What lies outside is gone."""
    least, most = box_distances("a_box", "b_box")
    return pairs.withColumns({"least": least, "most": most}).where(F.col("least") <= threshold_km * (1 + SLACK)) \
        .withColumn("whole", F.col("most") <= threshold_km * (1 - SLACK)).drop("least", "most")


def _sides(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(cells.select("k", F.col("cell").alias(x), F.col("n").alias(f"n{x}"), F.col("points").alias(f"p{x}"),
                              F.col("box").alias(f"{x}_box")) for x in "ab")


def neighbours(df: DataFrame, key: str, order: str, threshold_km: float, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(k, i, la, lo, n_near): the distinct places of each group, ``i`` the first point there, and how many other points
    of the group lie within the radius. A point without coordinates, or beyond a pole, has none and is none's neighbour."""
    placed = F.coalesce(F.col("latitude").between(-90, 90) & (F.abs("longitude") < float("inf")), F.lit(False))
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("i"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"),
                     placed.alias("placed"))
    few = written(_few_places(rows, isqrt(max_pairs) + 1))
    small = F.size("places") <= isqrt(max_pairs)
    compared = few.where(small).select("k", F.inline(_compared(F.col("places"), threshold_km)))
    crowded = few.where(~small).select("k")
    if crowded.isEmpty():
        return compared
    return compared.unionByName(_by_cells(rows.join(crowded, "k", "left_semi"), threshold_km, max_pairs))


def _few_places(rows: DataFrame, most: int) -> DataFrame:
    """(k, places): the first ``most`` places of each group, so that a group that has more is known without being held."""
    places = rows.groupBy("k", "la", "lo", "placed", F.when(~F.col("placed"), F.col("i")).alias("lone")).agg(
        F.min("i").alias("i"), F.count("*").alias("m"))
    first = places.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("i"))).where(F.col("r") <= most)
    return first.groupBy("k").agg(F.collect_list(F.struct("i", "la", "lo", "m", "placed")).alias("places"))


def _compared(places: Column, threshold_km: float) -> Column:
    """Each of a group's places with the other points within the radius."""
    def near(p: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda n, q: F.when(
            q["placed"] & (geo.haversine_km(p["la"], p["lo"], q["la"], q["lo"]) <= threshold_km), n + q["m"]).otherwise(n))
    return F.transform(places, lambda p: F.struct(p["i"].alias("i"), p["la"].alias("la"), p["lo"].alias("lo"), F.when(
        p["placed"], near(p) - 1).otherwise(F.lit(0).cast("long")).alias("n_near")))  # but itself


def _by_cells(rows: DataFrame, threshold_km: float, max_pairs: int) -> DataFrame:
    lone = rows.where("NOT placed").select("k", "i", "la", "lo", F.lit(0).cast("long").alias("n_near"))
    height = max(threshold_km, 1e-3) / 111.0
    band = F.floor(F.col("la") / height)
    wide = _columns(band, height, threshold_km)
    points = rows.where("placed").groupBy("k", "la", "lo").agg(F.min("i").alias("i"), F.count("*").alias("m"))
    points = points.withColumn("x", F.pmod(F.col("lo") + 180, F.lit(360.0)) - 180)  # longitude within one turn
    first = F.struct(band.alias("band"), F.pmod(_column(F.col("x"), wide), wide).alias("col"), F.lit(0).cast("long").alias("code"))
    points = written(points.withColumn("cell", first))
    cells = _cells(points)
    a, b = _sides(cells)
    # the bands and columns that a cell's surroundings may lie in
    near = a.withColumn("to_band", F.explode(F.sequence(F.col("a.band") - 1, F.col("a.band") + 1)))
    there = _columns(F.col("to_band"), height, threshold_km)
    reach = F.sequence(_column(F.col("a_box.lon0"), there) - 1, _column(F.col("a_box.lon1"), there) + 1)
    near = near.withColumn("to_col", F.explode(F.array_distinct(F.transform(reach, lambda c: F.pmod(c, there)))))
    b = b.withColumns({"to_band": F.col("b.band"), "to_col": F.col("b.col")})
    pairs = written(_sorted_out(near.join(b, ["k", "to_band", "to_col"]).drop("to_band", "to_col"), threshold_km))
    counted, tested = [], []
    while True:
        counted.append(_per_point(points, pairs.where("whole").groupBy("k", "a").agg(F.sum("nb").alias("n"))))
        crossed = pairs.where("NOT whole")
        small = F.col("pa") * F.col("pb") <= max_pairs
        tested.append(_tested(points, crossed.where(small), threshold_km))
        large = crossed.where(~small)
        if large.isEmpty():
            break
        points, pairs = _quartered(points, large, threshold_km)
    total = counted[0]
    for part in [*counted[1:], *tested]:
        total = total.unionByName(part)
    sums = total.groupBy("k", "la", "lo").agg(F.min("i").alias("i"), (F.sum("n") - 1).alias("n_near"))  # but itself
    return sums.select("k", "i", "la", "lo", "n_near").unionByName(lone)


def _per_point(points: DataFrame, by_cell: DataFrame) -> DataFrame:
    """Counts of cells, for each of their points."""
    return points.join(by_cell.withColumnRenamed("a", "cell"), ["k", "cell"]).select("k", "la", "lo", "i", "n")


def _tested(points: DataFrame, pairs: DataFrame, threshold_km: float) -> DataFrame:
    """Counts of points found by comparing the points of pairs of cells."""
    a = points.select("k", F.col("cell").alias("a"), "la", "lo", "i")
    b = points.select("k", F.col("cell").alias("b"), F.col("la").alias("lb"), F.col("lo").alias("lob"), "m")
    near = pairs.select("k", "a", "b").join(a, ["k", "a"]).join(b, ["k", "b"])
    near = near.where(geo.haversine_km("la", "lo", "lb", "lob") <= threshold_km)
    return near.groupBy("k", "la", "lo", "i").agg(F.sum("m").alias("n"))


def _quartered(points: DataFrame, pairs: DataFrame, threshold_km: float) -> tuple[DataFrame, DataFrame]:
    """The points of the cells of some pairs in quarters of their cells' boxes, and the pairs of quarters."""
    boxes = pairs.select("k", F.col("a").alias("cell"), F.col("a_box").alias("box")) \
        .unionByName(pairs.select("k", F.col("b").alias("cell"), F.col("b_box").alias("box"))).dropDuplicates(["k", "cell"])
    above = (F.col("la") > (F.col("box.lat0") + F.col("box.lat1")) / 2).cast("long")
    right = (F.col("x") > (F.col("box.lon0") + F.col("box.lon1")) / 2).cast("long")
    cut = points.join(boxes, ["k", "cell"]).withColumn("parent", F.col("cell")).withColumn(
        "cell", F.struct("cell.band", "cell.col", F.xxhash64("cell.code", above + 2 * right).alias("code")))
    cut = written(cut.drop("box"))
    parents = cut.select("k", "cell", "parent").distinct()
    cells = written(_cells(cut).join(parents, ["k", "cell"]))
    sides = []
    for side, x in zip(_sides(cells), "ab"):
        up = cells.select("k", F.col("cell").alias(x), F.col("parent").alias(f"{x}_up"))
        sides.append(side.join(up, ["k", x]))
    up = pairs.select("k", F.col("a").alias("a_up"), F.col("b").alias("b_up"))
    children = up.join(sides[0], ["k", "a_up"]).join(sides[1], ["k", "b_up"]).drop("a_up", "b_up")
    return cut.drop("parent"), written(_sorted_out(children, threshold_km))
