"""Wind at points and times from weather stations: temporal selection, inverse-distance weighting, validation."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import WindConfig
from ..functions.geo import angle_between, clip, toward_deg
from .graph import cut
from .spatial import distance_join, neighbor_pairs


#: Rows of winds by station and time that a task sorts, where Spark's own number of shuffle partitions would give it more.
ROWS_A_TASK = 400_000


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in so many partitions; as it is where ``tasks`` is None."""
    return df.repartition(tasks, *keys) if tasks else df


def temporal_select(obs: DataFrame, times: DataFrame, cfg: WindConfig, tasks: int | None = None) -> DataFrame:
    """(station_id, at, u, v, calm, offset_s, kind): each station's wind at each time.

    Exact where observed, linear between the nearest observations on both sides within the tolerance, else the
    nearest on one side. Observations go to the time slots (as wide as the tolerance) that they can reach, and in each slot of a station
    the last and the next observation of every time are found by two sorts: as many rows as the result has, no pairs of times and observations.
    Times without any observation in reach give no row.
    """
    reach = _reach(obs, cfg)
    asked = times.select("at").distinct().withColumn("_b", F.floor(F.col("at") / cfg.max_offset_seconds)).join(reach.select("station_id", "_b").distinct(), "_b")
    return _selected(reach, asked, cfg, tasks)


def _reach(obs: DataFrame, cfg: WindConfig) -> DataFrame:
    """Observations in each time slot that they can reach."""
    point = F.struct("t", "u", "v", "calm")
    return obs.select("station_id", F.col("t").alias("_time"), point.alias("_p"), F.explode(F.array(*[F.floor(F.col("t") / cfg.max_offset_seconds) + i for i in (-1, 0, 1)])).alias("_b"))


def _selected(reach: DataFrame, asked: DataFrame, cfg: WindConfig, tasks: int | None = None) -> DataFrame:
    """``temporal_select`` of the stations and times of ``asked`` (station_id, at, _b), whose further columns stay with their rows."""
    width, rest = cfg.max_offset_seconds, [c for c in asked.columns if c not in ("station_id", "at", "_b")]
    none = F.lit(None).cast(reach.schema["_p"].dataType)
    seen = reach.withColumn("_ask", F.lit(0)).withColumns({c: F.lit(None).cast(asked.schema[c].dataType) for c in rest})
    both = seen.unionByName(asked.select("station_id", F.col("at").alias("_time"), none.alias("_p"), "_b", F.lit(1).alias("_ask"), *rest))
    slot = Window.partitionBy("station_id", "_b")
    past, future = (slot.orderBy(o, "_ask").rowsBetween(Window.unboundedPreceding, 0) for o in ("_time", F.desc("_time")))
    found = dealt(both, tasks, "station_id", "_b").withColumns({"b": F.last("_p", ignorenulls=True).over(past), "a": F.last("_p", ignorenulls=True).over(future)}).where("_ask = 1").withColumnRenamed("_time", "at")
    near = lambda c: F.when(F.abs(F.col(f"{c}.t") - F.col("at")) <= width, F.col(c))
    sides = found.withColumns({"b": near("b"), "a": near("a")}).where("a is not null or b is not null")
    before, after = F.col("b"), F.col("a")
    two, exact = before.isNotNull() & after.isNotNull(), before["t"] == F.col("at")
    f = (F.col("at") - before["t"]) / (after["t"] - before["t"])
    mix = lambda c: F.when(exact, before[c]).when(two, before[c] + f * (after[c] - before[c])).otherwise(F.coalesce(before[c], after[c]))
    gap = F.greatest(F.coalesce(F.col("at") - before["t"], F.lit(0)), F.coalesce(after["t"] - F.col("at"), F.lit(0)))
    return sides.select(
        *rest,
        "station_id",
        "at",
        mix("u").alias("u"),
        mix("v").alias("v"),
        F.when(exact, before["calm"]).when(two, before["calm"] & after["calm"]).otherwise(F.coalesce(before["calm"], after["calm"])).alias("calm"),
        F.when(exact, 0).otherwise(gap).alias("offset_s"),
        F.when(exact, "exact").when(two, "bracketed").otherwise("nearest_only").alias("kind"),
    )


def idw(points: DataFrame, selected: DataFrame, stations: DataFrame, keys: list[str], cfg: WindConfig, exclude: str | None = None, settings: list[tuple[float, float]] | None = None, tasks: int | None = None) -> DataFrame:
    """Wind at every (lat, lon, at) of ``points`` from the nearest stations that have a value then.

    The preferred circle counts if it holds enough stations, else the wide one; ``exclude`` names a column of ``points`` with a station to leave
    out. ``settings`` are pairs (preferred_km, power): each gives a row of its own, from the same nearest stations. Points and stations meet on equal times and cells of the wide circle.
    """
    have = selected.join(stations.select("station_id", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")), "station_id")
    met = distance_join(points.withColumns({"a_lat": F.col("lat"), "a_lon": F.col("lon")}), have, cfg.max_km, ["at"], tasks=tasks)
    if exclude:
        met = met.where(F.col("station_id") != F.col(exclude))
    return _weighed(points.select(*keys).distinct(), met, keys, cfg, settings, tasks)


def _weighed(target: DataFrame, met: DataFrame, keys: list[str], cfg: WindConfig, settings: list[tuple[float, float]] | None = None, tasks: int | None = None, few: bool = False) -> DataFrame:
    """``idw`` of the ``keys`` of ``target`` from the stations they met. If those are no more than can be needed (``few``), they are not ranked before the shuffle, and ``_found`` is their number."""
    met = dealt(met, tasks, *keys)
    order = Window.partitionBy(*keys).orderBy("distance_km", "station_id")
    # whether a circle holds enough stations is told by the distance of the last that would be needed
    met = met.withColumn("_r", F.row_number().over(order))
    met = met if few else met.where(F.col("_r") <= max(cfg.max_stations, cfg.min_stations))
    met = met.withColumn("_enough", F.max(F.when(F.col("_r") == cfg.min_stations, F.col("distance_km"))).over(Window.partitionBy(*keys)))
    met = met.withColumn("_found", F.max("_r").over(Window.partitionBy(*keys))) if few else met
    preferred, power = F.lit(cfg.preferred_km), F.lit(cfg.power)
    if settings:
        each = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("preferred_km"), F.lit(float(p)).alias("power")) for r, p in settings]))
        met, target = (d.withColumn("_s", each).select(*d.columns, "_s.*") for d in (met, target))
        preferred, power, keys = F.col("preferred_km"), F.col("power"), [*keys, "preferred_km", "power"]
    used = met.where(F.col("_enough").isNull() | (F.col("_enough") > preferred) | (F.col("distance_km") <= preferred)).where(F.col("_r") <= cfg.max_stations)
    w = 1 / F.pow(F.greatest("distance_km", F.lit(cfg.epsilon_km)), power)
    used = used.withColumn("_w", w)
    sums = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_stations"),
        (F.sum(F.col("_w") * F.col("u")) / F.sum("_w")).alias("u"),
        (F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("v"),
        F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * (F.col("u") * F.col("u") + F.col("v") * F.col("v"))).alias("_s2"),
        F.count_if("calm").alias("n_calm"),
        F.min("distance_km").alias("nearest_km"),
        F.max("distance_km").alias("farthest_km"),
        F.max("offset_s").alias("max_offset_s"),
        F.count_if(F.col("kind") == "nearest_only").alias("one_sided"),
        *[F.max(c).alias(c) for c in ["_found"] * few],
    )
    # the weighted mean square distance from the mean is the mean square less the square of the mean
    spread = F.sqrt(F.greatest(F.col("_s2") / F.col("_sw") - F.col("u") * F.col("u") - F.col("v") * F.col("v"), F.lit(0.0)))
    enough = F.col("n_stations") >= cfg.min_stations
    out = target.join(sums.withColumn("disagreement", spread), keys, "left").withColumn("n_stations", F.coalesce("n_stations", F.lit(0)))
    d, n = F.col("disagreement"), F.col("n_stations")
    spatial = F.when(~enough | d.isNull() | (d >= 2) | (F.col("nearest_km") > 20) | (F.col("farthest_km") > 25), "high").when((d >= 1) | (F.col("nearest_km") > 10) | (F.col("farthest_km") > 15) | (n < 5), "medium").otherwise("low")
    temporal = F.when(~enough | (F.col("max_offset_s") > 600), "STALE").when(F.col("one_sided") > 0, "NEAREST_ONLY").otherwise("EXACT_OR_BRACKETED")
    out = out.withColumns({"spatial_uncertainty": spatial, "temporal_uncertainty": temporal})
    quality = (
        F.when(~enough, "INSUFFICIENT_STATIONS")
        .when(F.col("n_calm") >= F.ceil(n / 2), "CALM / LOW_DIRECTION_CONFIDENCE")
        .when((F.col("spatial_uncertainty") == "high") | (F.col("temporal_uncertainty") == "STALE"), "HIGH_UNCERTAINTY")
        .when((F.col("spatial_uncertainty") == "medium") | (F.col("temporal_uncertainty") == "NEAREST_ONLY"), "MEDIUM_UNCERTAINTY")
        .otherwise("GOOD")
    )
    ladder = lambda c, m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)]
    confidence = F.least(F.lit(1.0), n / cfg.max_stations) * F.greatest(F.lit(0.0), 1 - F.col("farthest_km") / 30) / (1 + d / 2)
    confidence = confidence * ladder("spatial_uncertainty", {"low": 1.0, "medium": 0.7, "high": 0.4}) * ladder("temporal_uncertainty", {"EXACT_OR_BRACKETED": 1.0, "NEAREST_ONLY": 0.75, "STALE": 0.45})
    return out.withColumns(
        {
            "quality": quality,
            "confidence": F.when(n == 0, F.lit(None).cast("double")).when(~enough, 0.0).otherwise(F.round(clip(confidence, 0, 1), 3)),
            "u": F.when(enough, F.col("u")),
            "v": F.when(enough, F.col("v")),
        }
    ).drop("_sw", "_s2", "one_sided", "n_calm")


def grid_points(spark, south: float, west: float, north: float, east: float, km: float) -> DataFrame:
    """(lat, lon) of a regular grid over a box, its south-west corner first."""
    from math import cos, radians

    dlat, dlon = km / 110.54, km / (111.32 * cos(radians((south + north) / 2)))
    ni, nj = ceil((north - south) / dlat - 1e-10), ceil((east - west) / dlon - 1e-10)
    cells = spark.range(ni + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nj).cast("long"))).alias("j"))
    out = cells.select("i", "j", (south + F.col("i") * dlat).alias("lat"), (west + F.col("j") * dlon).alias("lon"))
    return out.where((F.col("lat") <= north + 1e-10) & (F.col("lon") <= east + 1e-10))


def leave_one_out(obs: DataFrame, stations: DataFrame, cfg: WindConfig, settings: list[tuple[float, float]] | None = None) -> DataFrame:
    """Each observation predicted from the other stations: actual, predicted and errors. ``settings`` are pairs (preferred_km, power), each tried on every observation.

    Which stations are nearest doesn't depend on time, so pairs of stations are found once, and an observation asks its nearest stations alone. Only where one of those has no wind then, it asks all
    in reach. The steps are dealt to as many tasks as these rows need (``ROWS_A_TASK``), where that is more than Spark's number of shuffle partitions.
    """
    obs, need = cut(obs), max(cfg.max_stations, cfg.min_stations)
    tasks = ceil(obs.count() * min(need, stations.count()) / ROWS_A_TASK)
    tasks = tasks if tasks > int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    own = Window.partitionBy("a")
    pairs = neighbor_pairs(stations, cfg.max_km).withColumns({"_rank": F.row_number().over(own.orderBy("distance_km", "b")), "_of": F.count(F.lit(1)).over(own)})
    pairs = cut(pairs.select(F.col("a").alias("target"), F.col("b").alias("station_id"), "distance_km", "_rank", "_of"))
    keys = ["target", "at", "actual_u", "actual_v"]
    target = obs.join(stations.select("station_id"), "station_id").select(F.col("station_id").alias("target"), F.col("t").alias("at"), F.col("u").alias("actual_u"), F.col("v").alias("actual_v"))
    ask = lambda df, near: df.join(near.select("target", "station_id", "distance_km"), "target").withColumn("_b", F.floor(F.col("at") / cfg.max_offset_seconds))
    reach = _reach(obs, cfg)
    first = cut(_weighed(target, _selected(reach, ask(target, pairs.where(F.col("_rank") <= need)), cfg, tasks), keys, cfg, settings, tasks, few=True))
    short = F.coalesce("_found", F.lit(0)) < F.least(F.lit(need), F.coalesce("_of", F.lit(0)))
    first = first.join(pairs.where("_rank = 1").select("target", "_of"), "target", "left").withColumn("_short", short).drop("_found", "_of")
    rest = first.where("_short").select(*keys).distinct()
    asked = ask(rest, pairs)
    seen = reach.join(asked.select("station_id", "_b").distinct(), ["station_id", "_b"], "left_semi")
    again = _weighed(rest, _selected(seen, asked, cfg, tasks), keys, cfg, settings, tasks)
    out = first.where(~F.col("_short")).drop("_short").unionByName(again).join(stations.select(F.col("station_id").alias("target"), "lat", "lon"), "target")
    actual, predicted = F.hypot("actual_u", "actual_v"), F.hypot("u", "v")
    turn = angle_between(toward_deg("u", "v"), toward_deg("actual_u", "actual_v"))
    return out.withColumns({"vector_error": F.hypot(F.col("u") - F.col("actual_u"), F.col("v") - F.col("actual_v")), "speed_error": F.abs(predicted - actual), "direction_error": F.when(actual >= 0.5, turn)})


def distance_bucket(km: str):
    c = F.col(km)
    return F.when(c.isNull(), "unavailable").when(c <= 3, "≤3 km").when(c <= 5, "3–5 km").when(c <= 10, "5–10 km").otherwise(">10 km")


DISTANCES = ["≤3 km", "3–5 km", "5–10 km", ">10 km", "unavailable"]


def with_empty_strata(metrics: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Metrics by stratum, those without rows included, with a count of zero."""
    every = metrics.sparkSession.createDataFrame([(n,) for n in names], f"{by} string")
    return every.join(metrics, by, "left").fillna(0, ["n", "predicted"])


def percentiles(rows: DataFrame, by: list[str], asked: dict[str, tuple[str, float]], bins: int = 4096) -> DataFrame:
    """(by, <name>...): exact percentiles, interpolated as ``F.percentile`` does, of numeric columns; ``asked`` gives a column and a share for each name. ``by`` is not null.

    ``F.percentile`` keeps all different values of a group in one task. Here values are counted in ``bins`` equal parts of their group's range; only those in the parts that the asked ranks fall into are put in order.
    ``rows`` are read three times.
    """
    columns = sorted({c for c, _ in asked.values()})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns]))
    long = rows.select(*by, each.alias("_e")).select(*by, "_e.*").where("_v is not null")
    keys = [*by, "_c"]
    span = long.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    # values that are not finite give one part, which is exact too
    part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    usable = (F.col("_hi") > F.col("_lo")) & (F.col("_hi") - F.col("_lo") < float("inf"))
    parted = long.join(span, keys).withColumn("_part", F.when(usable, F.least(part, F.lit(bins - 1))).otherwise(0))
    order = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parted.groupBy(*keys, "_part", "_n").agg(F.count(F.lit(1)).alias("_m")).withColumn("_upto", F.sum("_m").over(order))
    wanted = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(c).alias("_of"), ((F.col("_n") - 1) * F.lit(float(p))).alias("_at")) for n, (c, p) in asked.items()])
    ranks = parts.withColumn("_w", F.explode(wanted)).select("*", "_w.*").where("_c = _of").withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    ranks = ranks.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_m"))).select(*keys, "_part", "_name", "_at", "_rank", (F.col("_rank") - F.col("_upto") + F.col("_m")).alias("_k"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = parted.join(ranks.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi").groupBy(*keys, "_part", "_v").agg(F.count(F.lit(1)).alias("_m")).withColumn("_upto", F.sum("_m").over(inside))
    found = values.join(ranks, [*keys, "_part"]).where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_m")))
    low = lambda n, f: F.max(F.when((F.col("_name") == n) & (F.col("_rank") == f("_at")), F.col("_v")))
    at = lambda n: F.max(F.when(F.col("_name") == n, F.col("_at")))

    def value(n: str):
        a, b, x = low(n, F.floor), low(n, F.ceil), at(n)
        return F.when(a.eqNullSafe(b), a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b).alias(n)

    return found.groupBy(*by).agg(*[value(n) for n in asked])


def error_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each ``by``: counts, means and exact percentiles of the errors of ``leave_one_out``; the errors are written once."""
    rows = cut(rows.select(*by, "vector_error", "speed_error", "direction_error", (F.col("u") - F.col("actual_u")).alias("_du"), (F.col("v") - F.col("actual_v")).alias("_dv")))
    asked = {"vector_median": ("vector_error", 0.5), "vector_p90": ("vector_error", 0.9), "direction_median": ("direction_error", 0.5)}
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("vector_error").alias("predicted"),
        F.round(F.avg("vector_error"), 6).alias("vector_mae"),
        F.round(F.sqrt(F.avg(F.col("vector_error") * F.col("vector_error"))), 6).alias("vector_rmse"),
        F.round(F.avg("speed_error"), 6).alias("speed_mae"),
        F.round(F.avg("_du"), 6).alias("bias_u"),
        F.round(F.avg("_dv"), 6).alias("bias_v"),
    )
    out = sums.join(percentiles(rows, by, asked), by, "left")
    return out.select(*by, "n", "predicted", "vector_mae", "vector_rmse", *[F.round(c, 6).alias(c) for c in ("vector_median", "vector_p90")], "speed_mae", F.round("direction_median", 6).alias("direction_median"), "bias_u", "bias_v")
