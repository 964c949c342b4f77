"""Robust anomalies: temporal and spatial excess, neighbour support, score and candidates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnomalyConfig
from ..functions.geo import clip, finite
from ..functions.robust import array_mad, array_median, sigma
from .graph import cut
from .spatial import neighbor_pairs
from .timeseries import bin_last, smooth, temporal_baseline


#: Bins that one task measures: they are few bytes, by which Spark would give them to one task, but each has a history and neighbours.
BINS_A_TASK = 10_000


def anomaly_rows(obs: DataFrame, stations: DataFrame, cfg: AnomalyConfig, keep_values: bool = False) -> DataFrame:
    """One row per station and bin, all bins in one plan.

    Station pairs don't depend on time: they are found once and joined twice on equal (station, bin) keys. Neighbours are
    those within the radius, or within the wide one where the radius holds too few. ``keep_values`` keeps their values, in ``neighbor_values``.
    Bins and their baselines are written once, and dealt to tasks by their number.
    """
    binned = cut(bin_last(obs, cfg.bin_seconds))
    tasks = ceil(binned.count() / BINS_A_TASK)
    binned = binned.repartition(tasks, "station_id") if tasks > 1 else binned
    bins = cut(temporal_baseline(smooth(binned, cfg.bin_seconds), cfg))
    return against_neighbors(bins, bins, stations, cfg, keep_values, tasks)


def against_neighbors(bins: DataFrame, others: DataFrame, stations: DataFrame, cfg: AnomalyConfig, keep_values: bool = False, tasks: int = 1) -> DataFrame:
    """``bins`` of ``temporal_baseline`` with their spatial measures, score and classes, each against the rows of ``others`` with the same bucket at stations nearby; by so many ``tasks``, if it is more than one."""
    pairs = neighbor_pairs(stations, cfg.wide_radius_km)
    other = others.select(F.col("station_id").alias("b"), "bucket", F.col("smoothed").alias("o_value"), F.col("history_count").alias("o_n"), F.col("temporal_excess").alias("o_te"), F.col("z_t").alias("o_z"))
    passes = (F.col("o_n") >= cfg.min_history) & (F.col("o_te") >= cfg.min_excess) & (F.col("o_z") >= cfg.min_z)
    met = bins.select(F.col("station_id").alias("a"), "bucket").join(pairs, "a").join(other, ["b", "bucket"])
    met = met.repartition(tasks, "a", "bucket") if tasks > 1 else met
    near = F.col("distance_km") <= cfg.radius_km
    lists = met.groupBy("a", "bucket").agg(
        F.collect_list(F.when(near, F.col("o_value"))).alias("v1"),
        F.collect_list("o_value").alias("v2"),
        F.count_if(near & passes).alias("s1"),
        F.count_if(passes).alias("s2"),
    )
    out = bins.join(lists.withColumnRenamed("a", "station_id"), ["station_id", "bucket"], "left")
    out = out.repartition(tasks, "station_id", "bucket") if tasks > 1 else out
    few = F.coalesce(F.size("v1"), F.lit(0)) < cfg.min_neighbors
    none = F.array().cast("array<double>")
    out = out.withColumn("_v", F.coalesce(F.when(few, F.col("v2")).otherwise(F.col("v1")), none))
    out = out.withColumns(
        {
            "neighbor_count": F.size("_v").cast("long"),
            "radius_km": F.when(few, cfg.wide_radius_km).otherwise(cfg.radius_km),
            "support_count": F.coalesce(F.when(few, F.col("s2")).otherwise(F.col("s1")), F.lit(0)).cast("long"),
            "s_median": array_median(F.col("_v")),
        }
    )
    out = out.withColumn("s_mad", array_mad(F.col("_v"), F.col("s_median"))).withColumn("spatial_excess", F.col("smoothed") - F.col("s_median"))
    out = out.withColumn("z_s", F.col("spatial_excess") / sigma(F.col("s_mad"), cfg.sigma_floor))
    out = out.withColumn("spatial_status", F.when(F.col("neighbor_count") >= cfg.min_neighbors, "sufficient").otherwise("insufficient_neighbors"))
    share = F.when(F.col("neighbor_count") > 0, F.col("support_count") / F.col("neighbor_count")).otherwise(0.0)
    out = out.withColumn("support_fraction", share)
    out = out.withColumn("neighbor_values", F.col("_v")) if keep_values else out
    return flagged(out, cfg).drop("_v", "v1", "v2", "s1", "s2")


def report_at(obs: DataFrame, stations: DataFrame, cutoff: int, cfg: AnomalyConfig, core: tuple[float, float, float, float], context: tuple[float, float, float, float], lookback: int = 86_400, now: int | None = None) -> DataFrame:
    """One row for each station in the ``context`` box (south, west, north, east): its anomaly as it was known at ``cutoff``, its ``zone`` (core or context) and the ``status`` of its value.

    Only observations of the ``lookback`` seconds before the cutoff are seen. A station's current value is its newest one, whatever bin it is in: ``missing`` if there is none, ``stale`` if it is older than
    ``max_age_seconds`` at the cutoff, or lies over five minutes after ``now``; else ``usable``. Stale values are measured but are never candidates, never isolated, and nobody's neighbours. The core box doesn't cut
    off neighbours: those are all usable stations of the context. Both zones are one plan.
    """
    within = lambda box: F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3])
    around = stations.where(within(context)).select("station_id", "lat", "lon", F.when(within(core), "core").otherwise("context").alias("zone"))
    seen = obs.where(F.col("t").between(cutoff - lookback, cutoff)).join(around.select("station_id"), "station_id", "left_semi")
    bins = temporal_baseline(smooth(bin_last(seen, cfg.bin_seconds), cfg.bin_seconds), cfg)
    rest = [c for c in bins.columns if c != "station_id"]
    last = bins.groupBy("station_id").agg(F.max_by(F.struct(*rest), "t").alias("m")).select("station_id", "m.*")
    age = F.greatest(F.lit(cutoff) - F.col("t"), F.lit(0))
    ahead = F.lit(False) if now is None else F.col("t") > now + 300
    flags = F.concat_ws(";", F.when(age > cfg.max_age_seconds, "stale_current_observation"), F.when(ahead, "suspicious_future_timestamp"))
    last = last.withColumns({"age_minutes": age / 60, "flags": flags, "own_bucket": F.col("bucket"), "bucket": F.lit(cutoff)})
    usable = F.col("flags") == ""
    rows = against_neighbors(last, last.where(usable), around, cfg).withColumns({"status": F.when(usable, "usable").otherwise("stale"), "bucket": F.col("own_bucket")}).drop("own_bucket")
    rows = rows.withColumns({c: F.col(c) & (F.col("status") == "usable") for c in ("is_candidate", "is_isolated")})
    out = around.join(rows, "station_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    none = F.col("status") == "missing"
    labels = {"temporal_status": F.coalesce("temporal_status", F.lit("insufficient_history")), "spatial_status": F.coalesce("spatial_status", F.lit("insufficient_neighbors")), "flags": F.when(none, "missing_current_value").otherwise(F.col("flags"))}
    fill = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("history_count", "neighbor_count", "support_count")} | {c: F.coalesce(c, F.lit(False)) for c in ("is_candidate", "is_isolated")}
    return out.withColumns(labels | fill)


def report_summary(rows: DataFrame) -> DataFrame:
    """One row for each zone of a report, the context being all of it: how many sensors there are, are usable, lack history or neighbours, are candidates or isolated, and the median, lowest and highest usable value."""
    zones = rows.withColumn("in_zone", F.explode(F.when(F.col("zone") == "core", F.array(F.lit("core"), F.lit("context"))).otherwise(F.array(F.lit("context")))))
    value = F.when(F.col("status") == "usable", F.col("value"))
    return zones.groupBy(F.col("in_zone").alias("zone")).agg(
        F.count(F.lit(1)).alias("sensors"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("usable", "stale", "missing")],
        F.count_if(F.col("temporal_status") != "sufficient").alias("insufficient_history"),
        F.count_if(F.col("spatial_status") != "sufficient").alias("insufficient_neighbors"),
        F.count_if("is_candidate").alias("candidates"),
        F.count_if("is_isolated").alias("isolated"),
        F.percentile(value, F.lit(0.5)).alias("median_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def with_absent(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """``rows`` and, for every bin that any station has, a row for each station without a usable value in it.

    ``status`` is usable or missing, ``flags`` names the missing value; its measures are null, its counts zero, and it is no candidate. Bins and
    stations are dimensions; their product is the size of the result.
    """
    zero = {"history_count": 0, "neighbor_count": 0, "support_count": 0}
    spine = rows.select("bucket").distinct().join(F.broadcast(stations.agg(F.collect_set("station_id").alias("s")))).select("bucket", F.explode("s").alias("station_id"))
    out = spine.join(rows.withColumn("status", F.lit("usable")), ["bucket", "station_id"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    none = F.col("status") == "missing"
    fill = {c: F.coalesce(c, F.lit(v).cast("long")) for c, v in zero.items()} | {c: F.coalesce(c, F.lit(False)) for c in ("is_candidate", "is_isolated")}
    labels = {"temporal_status": F.when(none, "insufficient_history").otherwise(F.col("temporal_status")), "spatial_status": F.when(none, "insufficient_neighbors").otherwise(F.col("spatial_status"))}
    return out.withColumns(fill | labels | {"flags": F.when(none, "missing_current_value").otherwise("")})


def score(z_t="z_t", z_s="z_s", te="temporal_excess", se="spatial_excess", fraction="support_fraction"):
    """0 to 10; null where a part is missing. The excess counts by its size, dips included; no support still leaves a quarter of the spatial part."""
    both = F.greatest(F.abs(F.col(te)), F.abs(F.col(se)))
    total = 0.4 * clip(z_t, 0, 10) + 0.4 * clip(z_s, 0, 10) * clip(fraction, 0.25, 1) + 0.2 * F.least(both / 5, F.lit(10.0))
    known = F.col(z_t).isNotNull() & F.col(z_s).isNotNull() & F.col(te).isNotNull() & F.col(se).isNotNull()
    return F.when(known, F.round(F.least(F.lit(10.0), total), 6))


def flagged(rows: DataFrame, cfg: AnomalyConfig) -> DataFrame:
    both = (F.col("temporal_status") == "sufficient") & (F.col("spatial_status") == "sufficient")
    known = F.lit(True)
    for c in ("temporal_excess", "spatial_excess", "z_t", "z_s"):
        known = known & finite(c)
    temporal = (F.col("temporal_excess") >= cfg.min_excess) & (F.col("z_t") >= cfg.min_z)
    spatial = (F.col("spatial_excess") >= cfg.min_excess) & (F.col("z_s") >= cfg.min_z)
    return rows.withColumns(
        {
            "anomaly_score": score(),
            "is_candidate": F.coalesce(both & known & temporal & spatial & (F.col("support_count") >= 1), F.lit(False)),
            "is_isolated": F.coalesce((F.col("temporal_status") == "sufficient") & temporal & ~F.coalesce(spatial, F.lit(False)), F.lit(False)),
        }
    )
