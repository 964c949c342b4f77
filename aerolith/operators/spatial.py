"""Distance joins through grid cells, and nearest neighbours."""

from __future__ import annotations

from functools import reduce
from math import ceil, cos, degrees, floor, pi, radians, sin, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, M_PER_DEG_LAT, M_PER_DEG_LON, haversine_km
from .graph import cut


#: Pairs of rows of the same cell that one task of a spread join compares, on average.
PAIRS_A_TASK = 10_000_000


def spread(a: DataFrame, b: DataFrame, keys: list[str], pairs: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and their keys, dealt to as many tasks as their pairs of equal keys need; keys with many pairs are split by a further key, ``_part``, for which the right side is repeated.

    A table of few bytes may have very many pairs, and Spark counts bytes. Only two numbers reach the driver.
    """
    pairs = pairs or PAIRS_A_TASK
    n = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    one = n.select((F.col("_n") * F.col("_m")).alias("p")).agg(F.sum("p").alias("all"), F.max("p").alias("most")).first()
    parts, tasks = max(1, ceil(8 * (one["most"] or 0) / pairs)), max(1, ceil((one["all"] or 0) / pairs))
    a = a.withColumn("_part", F.pmod(F.xxhash64(*a.columns), F.lit(parts)))
    b = b.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    on = [*keys, "_part"]
    return a.repartition(tasks, *on), b.repartition(tasks, *on), on


def distance_join(left: DataFrame, right: DataFrame, km: float, on: list[str] | None = None, max_abs_lat: float = 60.0, even: bool = False, tasks: int | None = None) -> DataFrame:
    """All pairs within ``km`` (closed). ``left`` has a_lat, a_lon; ``right`` b_lat, b_lon; ``on`` names further equal columns.

    Cells are at least ``km`` wide up to ``max_abs_lat`` degrees, so a pair's cells touch, also over the date line: the left side goes to its
    nine cells, an equi-join finds the candidates, the exact distance decides. A place nearer to a pole is an error, for its pairs could be
    missed. Rows without a place, and empty tables, give no pairs; repeated rows give a pair each. A box around each left place leaves out most candidates
    before distances are computed. ``even`` deals the pairs evenly to tasks (``spread``), at the cost of counting the cells first; ``tasks`` gives their number.
    """
    dlat = km / 110.0
    columns = max(3, floor(360.0 * cos(radians(max_abs_lat)) / dlat))
    low = lambda c: F.when(F.abs(F.col(c)) > max_abs_lat, F.raise_error(F.lit(f"a place beyond {max_abs_lat} degrees")).cast("double")).otherwise(F.col(c))
    row = lambda c: F.floor(low(c) / dlat)
    column = lambda c, shift=0: F.pmod(F.floor((F.col(c) + 180.0) * (columns / 360.0)) + shift, F.lit(columns))
    nine = F.explode(F.array_distinct(F.array(*[F.struct((row("a_lat") + i).alias("ci"), column("a_lon", j).alias("cj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    # the exact half width of the circle in degrees, a little wider for rounding
    turn = min(km / EARTH_KM, pi / 2)
    wide = F.when(F.cos(F.radians("a_lat")) > sin(turn), F.degrees(F.asin(sin(turn) / F.cos(F.radians("a_lat")))) * (1 + 1e-9) + 1e-9).otherwise(180.0)
    a = left.withColumn("_wide", wide).withColumn("_c", nine).withColumns({"_ci": F.col("_c.ci"), "_cj": F.col("_c.cj")}).drop("_c")
    b = right.withColumns({"_ci": row("b_lat"), "_cj": column("b_lon")})
    keys = [*(on or []), "_ci", "_cj"]
    if even:
        a, b, keys = spread(a, b, keys)
    elif tasks:
        a, b = a.repartition(tasks, *keys), b.repartition(tasks, *keys)
    apart = F.pmod(F.col("b_lon") - F.col("a_lon"), F.lit(360.0))
    boxed = a.join(b, keys).where((F.abs(F.col("b_lat") - F.col("a_lat")) <= degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9) & (F.least(apart, 360.0 - apart) <= F.col("_wide")))
    out = boxed.withColumn("distance_km", haversine_km("a_lat", "a_lon", "b_lat", "b_lon"))
    return out.where(F.col("distance_km") <= km).drop("_ci", "_cj", "_part", "_wide")


def _northmost(places: DataFrame) -> float:
    """The largest latitude either way, at most 60, beyond which a distance join is an error: cells fit places up to it."""
    return min(60.0, places.agg(F.max(F.abs(F.nanvl("lat", F.lit(None).cast("double"))))).first()[0] or 0.0)


def neighbor_pairs(stations: DataFrame, km: float) -> DataFrame:
    """(a, b, distance_km) of different stations within ``km``, both ways round. There may be very many, so tasks have about as many each, however few bytes the stations are."""
    a = stations.select(F.col("station_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = stations.select(F.col("station_id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return distance_join(a, b, km, max_abs_lat=_northmost(stations), even=True).where("a <> b").select("a", "b", "distance_km")


def counts_within(stations: DataFrame, radii: list[float]) -> DataFrame:
    """(a, within_<r>km, ...): of each station that has others within the widest of ``radii``, how many rows of others are within each.

    Rows of one place are counted once and weigh as many as they are; a station's own rows are taken off again. Tasks have about as many pairs of places each.
    """
    rows = stations.select(F.col("station_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")).where("a is not null")
    places = rows.groupBy("a_lat", "a_lon").agg(F.count(F.lit(1)).alias("_n"))
    b = places.select(F.col("a_lat").alias("b_lat"), F.col("a_lon").alias("b_lon"), "_n")
    met = distance_join(places.drop("_n"), b, max(radii), max_abs_lat=_northmost(stations), even=True)
    all_, own_ = ([f"_{side}{i}" for i in range(len(radii))] for side in "ao")
    sums = met.groupBy("a_lat", "a_lon").agg(*[F.sum(F.when(F.col("distance_km") <= r, F.col("_n")).otherwise(0)).alias(c) for c, r in zip(all_, radii, strict=True)])
    every = rows.join(sums, ["a_lat", "a_lon"]).groupBy("a").agg(*[F.sum(c).alias(c) for c in all_])
    own = rows.join(rows.select("a", F.col("a_lat").alias("b_lat"), F.col("a_lon").alias("b_lon")), "a").withColumn("d", haversine_km("a_lat", "a_lon", "b_lat", "b_lon"))
    own = own.groupBy("a").agg(*[F.count_if(F.col("d") <= r).alias(c) for c, r in zip(own_, radii, strict=True)])
    others = [F.col(x) - F.col(y) for x, y in zip(all_, own_, strict=True)]
    return every.join(own, "a").where(others[radii.index(max(radii))] > 0).select("a", *[c.alias(f"within_{r:g}km") for c, r in zip(others, radii, strict=True)])


def nearest(pairs: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k rows of each key with the smallest distance, ties by b; the rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*key).orderBy("distance_km", "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_within(stations: DataFrame, k: int, km: float) -> DataFrame:
    """(a, b, distance_km, rank): the ``k`` nearest other stations of each within ``km``, ties by b.

    Circles grow: the first is small enough to hold about twice ``k`` stations at the mean density, and each further one, twice as wide, is searched only for stations that found fewer than ``k`` in the one before. Who has ``k`` within a circle
    has no nearer one outside it. Of stations at one very same place only the ``k`` + 1 first can be among anybody's nearest, so the others are no candidates.
    """
    placed = cut(stations.select("station_id", "lat", "lon").where("lat is not null and lon is not null"))
    box = placed.agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("s"), F.max("lat").alias("e"), F.min("lon").alias("w"), F.max("lon").alias("o")).first()
    area = max(1e-6, ((box.e or 0) - (box.s or 0)) * 111.2 * max(1e-3, ((box.o or 0) - (box.w or 0)) * 111.2 * cos(radians(((box.e or 0) + (box.s or 0)) / 2))))
    radius = min(km, max(km / 2**12, sqrt(2 * k * area / (3.14 * max(1, box.n)))))
    same = Window.partitionBy("lat", "lon").orderBy("station_id")
    b = cut(placed.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).select(F.col("station_id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")))
    left, done = placed.select(F.col("station_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), []
    while True:
        found = nearest(distance_join(left, b, radius).where("a <> b").select("a", "b", "distance_km"), ["a"], k)
        if radius >= km:
            return reduce(DataFrame.unionByName, [*done, found])
        found = cut(found)
        full = found.where(F.col("rank") == k).select("a")
        done.append(found.join(full, "a", "left_semi"))
        left, radius = cut(left.join(full, "a", "left_anti")), min(km, 2 * radius)
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def grid_shape(south: float, west: float, north: float, east: float, metres: float = 1000.0) -> tuple[int, int]:
    """Rows and columns of cells of about ``metres`` that cover a box."""
    rows = ceil((north - south) * M_PER_DEG_LAT / metres)
    cols = ceil((east - west) * M_PER_DEG_LON * cos(radians((south + north) / 2)) / metres)
    return max(1, rows), max(1, cols)
