"""Queries of clusters, events and wind."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import AnomalyConfig, EventConfig, TraceConfig, WindConfig
from ..operators import anomaly, backtrace, events, wind
from ..operators.graph import cut, shared_dir
from ..streaming.live import LiveEvents
from ..functions.geo import toward_deg
from . import views
from .views import ANOMALY, BINNED, hav, with_

LOOSE = AnomalyConfig(bin_seconds=21_600, baseline_seconds=432_000, radius_km=3.0, wide_radius_km=4.5, min_z=1.5)
EVENTS = EventConfig(bin_seconds=21_600, eps_km=2.0, centroid_km=2.5, member_km=2.0)
WIND = WindConfig(max_offset_seconds=10_800)
SIX_HOURS = 21_600
#: The trace of the queries: coarse steps through six hours, as the tables' winds are hours apart.
TRACE = TraceConfig(particles=40, dt_seconds=600, minutes=180, block_seconds=3600)
LAT0, LON0, EXTENT = 25.06, 121.46, (-40_000.0, -40_000.0, 40_000.0, 40_000.0)
RADII, POWERS = (3.0, 5.0, 8.0), (1.0, 2.0, 3.0)
#: South, west, north, east of the core box.
CORE = (25.051429, 121.427692, 25.085714, 121.473846)


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _sr(*names):
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def clusters(spark, d):
    st = views.stations(spark)
    rows = anomaly.anomaly_rows(views.obs(spark, d), st, LOOSE)
    return events.clusters(events.roles(rows, EVENTS), st, EVENTS).join(st, "station_id")


def dbscan_clusters(spark, d):
    return clusters(spark, d).select("bucket", "station_id", "role", "cluster_station")


STATS = ["lat", "lon", "weighted_lat", "weighted_lon", "spread_km", "max_score", "mean_te", "mean_se", "peak_value", "strength"]


def cluster_stats(spark, d):
    return events.cluster_stats(clusters(spark, d)).select("bucket", "cluster_station", "member_count", "seed_count", "eligible", *_r(*STATS))


def _linked(spark, d):
    stats = events.cluster_stats(clusters(spark, d))
    return events.link_events(stats, EVENTS), stats


def event_lifecycle(spark, d):
    linked, stats = _linked(spark, d)
    final = views.obs(spark, d).agg((F.max("t") - F.max("t") % SIX_HOURS).alias("final_bucket"))
    return events.event_summary(linked, stats, EVENTS, final)


def event_stream(spark, d):
    """The events of a live stream of the observations, stopped and started anew twice, with a third of the time in each run."""
    path = shared_dir(spark)
    o = views.obs(spark, d).select("station_id", "obs_id", F.col("t").cast("long").alias("t"), "value", "quality_flags")
    span = o.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    live = LiveEvents(spark, f"{path}/live", views.stations(spark), LOOSE, EVENTS, late=0)
    part = F.least(F.floor((F.col("t") - span.low) * 3 / F.lit((span.high or 0) - (span.low or 0) + 1)), F.lit(2))
    for k in range(3):
        o.where(part == k).write.parquet(f"{path}/in/{k}")
        stream = spark.readStream.schema(o.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        live.start(stream, f"{path}/checkpoint").awaitTermination()
    live.finish()
    return live.events()


def event_membership(spark, d):
    linked, stats = _linked(spark, d)
    return linked.join(stats, ["bucket", "cluster_station"]).select("event_id", "bucket", F.explode("members").alias("station_id"))


def event_path(spark, d):
    """Path metrics over a fixed sequence: the clusters named by the same station, as if each were an event."""
    stats = events.cluster_stats(clusters(spark, d)).select("cluster_station", "bucket", "lat", "lon")
    return events.path(stats, ["cluster_station"], EVENTS).select("cluster_station", "bucket", *_r("displacement_km", "bearing_deg", "speed_kmh"))


LOOSE_ANOMALY = ANOMALY.replace("z_t >= 3", "z_t >= 1.5").replace("z_s >= 3", "z_s >= 1.5")
CLUSTER = f"""mem AS (SELECT *, CASE WHEN is_candidate THEN 'seed' ELSE 'support' END AS role FROM an
       WHERE temporal_status = 'sufficient' AND spatial_status = 'sufficient' AND anomaly_score IS NOT NULL AND (is_candidate OR (anomaly_score >= 0.35 AND temporal_excess >= 3 AND spatial_excess >= 3))),
epair AS (SELECT a.station_id AS a, b.station_id AS b FROM station a, station b WHERE a.station_id <> b.station_id AND {hav("a", "b")} <= 2.0),
edge AS (SELECT x.bucket, x.station_id AS a, y.station_id AS b FROM mem x JOIN epair p ON p.a = x.station_id JOIN mem y ON y.station_id = p.b AND y.bucket = x.bucket),
reach(bucket, station_id, r) AS (SELECT bucket, station_id, station_id FROM mem UNION SELECT e.bucket, e.b, reach.r FROM reach JOIN edge e ON e.bucket = reach.bucket AND e.a = reach.station_id),
lab AS (SELECT bucket, station_id, min(r) AS cluster_station FROM reach GROUP BY 1, 2),
cl0 AS (SELECT mem.*, cluster_station, count(*) OVER (PARTITION BY mem.bucket, cluster_station) AS size FROM mem JOIN lab USING (bucket, station_id)),
cl AS (SELECT cl0.*, lat, lon FROM cl0 JOIN station USING (station_id) WHERE size > 1 OR role = 'seed'),
cs0 AS (SELECT bucket, cluster_station, count(*) AS member_count, count(*) FILTER (WHERE role = 'seed') AS seed_count, avg(lat) AS lat, avg(lon) AS lon,
        sum(greatest(anomaly_score, 0.001) * lat) / sum(greatest(anomaly_score, 0.001)) AS weighted_lat, sum(greatest(anomaly_score, 0.001) * lon) / sum(greatest(anomaly_score, 0.001)) AS weighted_lon,
        max(anomaly_score) AS max_score, avg(temporal_excess) AS mean_te, avg(spatial_excess) AS mean_se, max(temporal_excess) AS max_te, max(spatial_excess) AS max_se, max(smoothed) AS peak_value FROM cl GROUP BY 1, 2),
sp AS (SELECT c.bucket, c.cluster_station, max({hav("s", "c")}) AS spread_km FROM cl c JOIN cs0 s USING (bucket, cluster_station) GROUP BY 1, 2),
cs AS (SELECT *, least(0.45 * least(greatest(seed_count, 0) / 3, 1) + 0.2 * least(member_count / 5, 1) + 0.2 * least(greatest(max_score, 0) / 10, 1) + 0.075 * least(greatest(max_te, 0) / 10, 1) + 0.075 * least(greatest(max_se, 0) / 10, 1),
       CASE WHEN member_count = 1 AND seed_count = 1 THEN 0.3 ELSE 10 END) AS strength FROM cs0 JOIN sp USING (bucket, cluster_station))"""


def cluster_sql(rest: str) -> str:
    return with_("obs", "station", BINNED, LOOSE_ANOMALY, CLUSTER).replace("WITH ", "WITH RECURSIVE ", 1) + rest


def wind_vectors(spark, d):
    w = views.weather(spark, d)
    return w.select("station_id", "t", "calm", *_r("u", "v"), F.round(F.hypot("u", "v"), 6).alias("speed"), F.round(toward_deg("u", "v"), 6).alias("toward"))


def _times(spark, d):
    t = views.events(spark, d).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return t.select(F.explode(F.sequence(F.col("a") - F.col("a") % SIX_HOURS + SIX_HOURS, F.col("b"), F.lit(SIX_HOURS))).alias("at"))


def _wstations(spark):
    return views.stations(spark).where("station_id < 24")


def wind_temporal_select(spark, d):
    out = wind.temporal_select(views.weather(spark, d), _times(spark, d), WIND)
    return out.select("station_id", "at", "calm", F.col("offset_s").cast("long").alias("offset_s"), "kind", *_r("u", "v"))


OUT = ["n_stations", "quality", "spatial_uncertainty", "temporal_uncertainty", "confidence"]
ROUND = ["u", "v", "disagreement", "nearest_km", "farthest_km"]


def wind_idw(spark, d):
    spots = wind.grid_points(spark, 25.0, 121.4, 25.12, 121.52, 6.0).select("i", "j", "lat", "lon")
    points = _times(spark, d).withColumn("spots", F.lit(0)).join(F.broadcast(spots.withColumn("spots", F.lit(0))), "spots").drop("spots")
    out = wind.idw(points, wind.temporal_select(views.weather(spark, d), points, WIND), _wstations(spark), ["i", "j", "lat", "lon", "at"], WIND)
    return out.select("i", "j", "at", *OUT, *_r(*ROUND))


def wind_grid(spark, d):
    """The wind at every point of a 1 km grid over the core box, at the last time of the spine."""
    spots = wind.grid_points(spark, *CORE, 1.0)
    points = spots.join(F.broadcast(_times(spark, d).agg(F.max("at").alias("at"))))
    out = wind.idw(points, wind.temporal_select(views.weather(spark, d), points, WIND), _wstations(spark), ["i", "j", "lat", "lon", "at"], WIND)
    return out.select("i", "j", "at", *_r("lat", "lon"), *OUT, *_r(*ROUND))


def _loso(spark, d):
    return wind.leave_one_out(views.weather(spark, d), _wstations(spark), WIND)


def wind_loso(spark, d):
    return _loso(spark, d).select("target", "at", "n_stations", *_r("vector_error", "speed_error", "direction_error"))


def wind_loso_strata(spark, d):
    metrics = wind.error_metrics(_loso(spark, d).withColumn("bucket", wind.distance_bucket("nearest_km")), ["bucket"])
    return wind.with_empty_strata(metrics, "bucket", wind.DISTANCES)


def wind_param_sweep(spark, d):
    """Every observation predicted with nine settings, three radii by three powers, in one pass over the met pairs."""
    out = wind.leave_one_out(views.weather(spark, d), _wstations(spark), WIND, [(r, p) for r in RADII for p in POWERS])
    return wind.error_metrics(out, ["preferred_km", "power"]).withColumnsRenamed({"preferred_km": "radius_km"})


def residual_table(spark, d):
    return backtrace.residual_table(_loso(spark, d)).select("target", "at", "bucket", "quality", *_r("du", "dv"))


def _event_members(spark, d):
    clustered = clusters(spark, d)
    linked = events.link_events(events.cluster_stats(clustered), EVENTS)
    return linked.select("event_id", "bucket", "cluster_station").join(clustered, ["bucket", "cluster_station"])


def _traced(spark, d, cells=True):
    seeds = cut(backtrace.event_receptors(_event_members(spark, d)))
    pool = backtrace.whole_pools(backtrace.residual_table(_loso(spark, d)))
    return seeds, cut(backtrace.trace(seeds, backtrace.Measured(views.weather(spark, d), _wstations(spark), WIND), pool, TRACE, LAT0, LON0, EXTENT, cells))


def trace_terminations(spark, d):
    """How the particles of every event end, and from which residuals they drew."""
    _, passed = _traced(spark, d, cells=False)
    return passed.where("ci is null").groupBy("event_id", "ended", "source").agg(F.sum("hits").alias("particles"))


def trace_surface(spark, d):
    seeds, passed = _traced(spark, d)
    return backtrace.surface(passed, seeds, TRACE).select("event_id", "ci", "cj", "support_count", F.size("times").cast("long").alias("n_times"), *_r("density", "support_fraction", "score"))


def trace_regions(spark, d):
    seeds, passed = _traced(spark, d)
    return backtrace.regions(backtrace.surface(passed, seeds, TRACE)).select("event_id", "rank", "cells", "support", F.size("times").cast("long").alias("n_times"), *_r("peak", "mean", "x", "y", "west", "east", "south", "north", "area_km2"))


def movement_consistency(spark, d):
    path = events.cluster_stats(clusters(spark, d)).select("bucket", "cluster_station", "lat", "lon").withColumn("event_id", F.col("cluster_station").cast("string"))
    out = backtrace.movement(path, views.weather(spark, d), _wstations(spark), WIND)
    return out.select("event_id", "status", *_r("displacement_km", "observed_deg", "wind_deg", "difference_deg"))


TIMES = "times AS (SELECT unnest(range(a - a % 21600 + 21600, b + 1, 21600)) AS at FROM (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS a, CAST(floor(epoch(max(ts))) AS BIGINT) AS b FROM events))"
SELECT = """near AS (SELECT o.station_id, a.at, o.t, o.u, o.v, o.calm FROM weather o JOIN (SELECT DISTINCT at FROM times) a ON o.t BETWEEN a.at - 10800 AND a.at + 10800),
sides AS (SELECT station_id, at, arg_max(struct_pack(t := t, u := u, v := v, calm := calm), t) FILTER (WHERE t <= at) AS b, arg_min(struct_pack(t := t, u := u, v := v, calm := calm), t) FILTER (WHERE t >= at) AS a FROM near GROUP BY 1, 2),
sel AS (SELECT station_id, at, CASE WHEN b.t = at THEN b.u WHEN b IS NOT NULL AND a IS NOT NULL THEN b.u + (at - b.t) / (a.t - b.t) * (a.u - b.u) ELSE coalesce(b.u, a.u) END AS u,
        CASE WHEN b.t = at THEN b.v WHEN b IS NOT NULL AND a IS NOT NULL THEN b.v + (at - b.t) / (a.t - b.t) * (a.v - b.v) ELSE coalesce(b.v, a.v) END AS v,
        CASE WHEN b.t = at THEN b.calm WHEN b IS NOT NULL AND a IS NOT NULL THEN b.calm AND a.calm ELSE coalesce(b.calm, a.calm) END AS calm,
        CASE WHEN b.t = at THEN 0 ELSE greatest(coalesce(at - b.t, 0), coalesce(a.t - at, 0)) END AS offset_s,
        CASE WHEN b.t = at THEN 'exact' WHEN b IS NOT NULL AND a IS NOT NULL THEN 'bracketed' ELSE 'nearest_only' END AS kind FROM sides)"""


def _idw_sql(keys: str, exclude: str = "true", preferred: float = 15.0, power: float = 2.0, tag: str = "") -> str:
    on = " AND ".join(f"p.{k} = s.{k}" for k in keys.split(", "))
    return f"""met{tag} AS (SELECT p.*, s.station_id, s.u, s.v, s.calm, s.offset_s, s.kind, {hav("p", "w")} AS d FROM point p JOIN sel s ON s.at = p.at JOIN wstation w ON w.station_id = s.station_id WHERE {exclude}),
used{tag} AS (SELECT *, 1 / pow(greatest(d, 0.1), {power}) AS w FROM (SELECT *, count(*) FILTER (WHERE d <= {preferred}) OVER (PARTITION BY {keys}) AS p FROM met{tag} WHERE d <= 30)
         WHERE p < 3 OR d <= {preferred} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY d, station_id) <= 8),
sums{tag} AS (SELECT {keys}, count(*) AS n_stations, sum(w * u) / sum(w) AS u, sum(w * v) / sum(w) AS v, sum(w * (u * u + v * v)) / sum(w) AS ms, count(*) FILTER (WHERE calm) AS n_calm, min(d) AS nearest_km, max(d) AS farthest_km,
          max(offset_s) AS max_offset, count(*) FILTER (WHERE kind = 'nearest_only') AS one_sided FROM used{tag} GROUP BY {keys}),
i0{tag} AS (SELECT p.*, coalesce(s.n_stations, 0) AS n_stations, s.u, s.v, CASE WHEN s.n_stations IS NOT NULL THEN sqrt(greatest(s.ms - s.u * s.u - s.v * s.v, 0)) END AS disagreement, s.n_calm, s.nearest_km, s.farthest_km, s.max_offset, s.one_sided FROM (SELECT DISTINCT * FROM point) p LEFT JOIN sums{tag} s ON {on}),
i1{tag} AS (SELECT *, n_stations >= 3 AS enough,
        CASE WHEN n_stations < 3 OR disagreement IS NULL OR disagreement >= 2 OR nearest_km > 20 OR farthest_km > 25 THEN 'high' WHEN disagreement >= 1 OR nearest_km > 10 OR farthest_km > 15 OR n_stations < 5 THEN 'medium' ELSE 'low' END AS spatial_uncertainty,
        CASE WHEN n_stations < 3 OR max_offset > 600 THEN 'STALE' WHEN one_sided > 0 THEN 'NEAREST_ONLY' ELSE 'EXACT_OR_BRACKETED' END AS temporal_uncertainty FROM i0{tag}),
idw{tag} AS (SELECT * REPLACE (CASE WHEN enough THEN u END AS u, CASE WHEN enough THEN v END AS v),
        CASE WHEN NOT enough THEN 'INSUFFICIENT_STATIONS' WHEN n_calm >= ceil(n_stations / 2) THEN 'CALM / LOW_DIRECTION_CONFIDENCE' WHEN spatial_uncertainty = 'high' OR temporal_uncertainty = 'STALE' THEN 'HIGH_UNCERTAINTY'
             WHEN spatial_uncertainty = 'medium' OR temporal_uncertainty = 'NEAREST_ONLY' THEN 'MEDIUM_UNCERTAINTY' ELSE 'GOOD' END AS quality,
        CASE WHEN n_stations = 0 THEN NULL WHEN NOT enough THEN 0.0 ELSE round(greatest(0, least(1, least(1, n_stations / 8) * greatest(0, 1 - farthest_km / 30) / (1 + disagreement / 2)
             * CASE spatial_uncertainty WHEN 'low' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END * CASE temporal_uncertainty WHEN 'EXACT_OR_BRACKETED' THEN 1.0 WHEN 'NEAREST_ONLY' THEN 0.75 ELSE 0.45 END)), 3) END AS confidence FROM i1{tag})"""


GRID = """point AS (SELECT i, j, 25.0::DOUBLE + i * (6.0::DOUBLE / 110.54::DOUBLE) AS lat, 121.4::DOUBLE + j * (6.0::DOUBLE / (111.32::DOUBLE * cos(radians((25.0::DOUBLE + 25.12::DOUBLE) / 2)))) AS lon, at
          FROM range(4) a(i), range(4) b(j), times WHERE 25.0::DOUBLE + i * (6.0::DOUBLE / 110.54::DOUBLE) <= 25.12 + 1e-10 AND 121.4::DOUBLE + j * (6.0::DOUBLE / (111.32::DOUBLE * cos(radians((25.0::DOUBLE + 25.12::DOUBLE) / 2)))) <= 121.52 + 1e-10)"""
_DLAT, _DLON = "(1.0::DOUBLE / 110.54::DOUBLE)", f"(1.0::DOUBLE / (111.32::DOUBLE * cos(radians(({CORE[0]}::DOUBLE + {CORE[2]}::DOUBLE) / 2))))"
CORE_GRID = f"""point AS (SELECT i, j, {CORE[0]}::DOUBLE + i * {_DLAT} AS lat, {CORE[1]}::DOUBLE + j * {_DLON} AS lon, at FROM range(9) a(i), range(9) b(j), (SELECT max(at) AS at FROM times)
          WHERE {CORE[0]}::DOUBLE + i * {_DLAT} <= {CORE[2]} + 1e-10 AND {CORE[1]}::DOUBLE + j * {_DLON} <= {CORE[3]} + 1e-10)"""
TARGET = "point AS (SELECT w.station_id AS target, w.t AS at, lat, lon, w.u AS actual_u, w.v AS actual_v FROM weather w JOIN wstation USING (station_id)), times AS (SELECT at FROM point)"
_TO = "CASE WHEN sqrt({u} * {u} + {v} * {v}) > 1e-12 THEN ((degrees(atan2({u}, {v})) % 360) + 360) % 360 END"


def _errors_sql(tag: str = "") -> str:
    a, b = _TO.format(u="u", v="v"), _TO.format(u="actual_u", v="actual_v")
    return f"""e{tag} AS (SELECT *, sqrt(pow(u - actual_u, 2) + pow(v - actual_v, 2)) AS vector_error, abs(sqrt(u * u + v * v) - sqrt(actual_u * actual_u + actual_v * actual_v)) AS speed_error,
        CASE WHEN sqrt(actual_u * actual_u + actual_v * actual_v) >= 0.5 THEN least(((({a}) - ({b})) % 360 + 360) % 360, 360 - ((({a}) - ({b})) % 360 + 360) % 360) END AS direction_error FROM idw{tag})"""


METRICS = """count(*) AS n, count(vector_error) AS predicted, round(avg(vector_error), 6) AS vector_mae, round(sqrt(avg(vector_error * vector_error)), 6) AS vector_rmse, round(quantile_cont(vector_error, 0.5), 6) AS vector_median,
    round(quantile_cont(vector_error, 0.9), 6) AS vector_p90, round(avg(speed_error), 6) AS speed_mae, round(quantile_cont(direction_error, 0.5), 6) AS direction_median, round(avg(u - actual_u), 6) AS bias_u, round(avg(v - actual_v), 6) AS bias_v"""
LOSO = with_("weather", "wstation", TARGET, SELECT) + ",\n"
_NOT_OWN = "s.station_id <> p.target"
_SWEEP = [(r, p, f"_{int(r)}_{int(p)}") for r in RADII for p in POWERS]

_PLAIN = {
    "dbscan_clusters": (dbscan_clusters, cluster_sql(" SELECT bucket, station_id, role, cluster_station FROM cl")),
    "cluster_stats": (cluster_stats, cluster_sql(f" SELECT bucket, cluster_station, member_count, seed_count, seed_count > 0 AS eligible, {_sr(*STATS)} FROM cs")),
    "event_lifecycle": (event_lifecycle, None),
    "event_membership": (event_membership, None),
    "event_stream": (event_stream, None),
    "event_path": (event_path, cluster_sql(f""", pp AS (SELECT cluster_station, bucket, lat, lon, lag(lat) OVER w AS l1, lag(lon) OVER w AS o1, lag(bucket) OVER w AS t1 FROM cs WINDOW w AS (PARTITION BY cluster_station ORDER BY bucket)),
        dd AS (SELECT *, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - l1) / 2), 2) + cos(radians(l1)) * cos(radians(lat)) * pow(sin(radians(lon - o1) / 2), 2)))) AS d,
               ((degrees(atan2(sin(radians(lon - o1)) * cos(radians(lat)), cos(radians(l1)) * sin(radians(lat)) - sin(radians(l1)) * cos(radians(lat)) * cos(radians(lon - o1)))) % 360) + 360) % 360 AS brg FROM pp)
        SELECT cluster_station, bucket, round(CASE WHEN d < 0.1 THEN 0.0 ELSE d END, 6) AS displacement_km, round(CASE WHEN d >= 0.1 THEN brg END, 6) AS bearing_deg,
               round(CASE WHEN d < 0.1 THEN 0.0 ELSE d / (greatest(bucket - t1, 21600) / 3600) END, 6) AS speed_kmh FROM dd""")),
    "wind_vectors": (wind_vectors, with_("weather") + f" SELECT station_id, t, calm, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(sqrt(u * u + v * v), 6) AS speed, round({_TO.format(u='u', v='v')}, 6) AS toward FROM weather"),
    "wind_temporal_select": (wind_temporal_select, with_("weather", TIMES, SELECT) + " SELECT station_id, at, calm, CAST(offset_s AS BIGINT) AS offset_s, kind, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM sel"),
    "wind_idw": (wind_idw, with_("weather", "wstation", TIMES, SELECT, GRID, _idw_sql("i, j, at")) + f" SELECT i, j, at, {', '.join(OUT)}, {_sr(*ROUND)} FROM idw"),
    "wind_grid": (wind_grid, with_("weather", "wstation", TIMES, SELECT, CORE_GRID, _idw_sql("i, j, at")) + f" SELECT i, j, at, round(lat, 6) AS lat, round(lon, 6) AS lon, {', '.join(OUT)}, {_sr(*ROUND)} FROM idw"),
    "wind_loso": (wind_loso, LOSO + _idw_sql("target, at", _NOT_OWN) + ",\n" + _errors_sql() + f" SELECT target, at, n_stations, {_sr('vector_error', 'speed_error', 'direction_error')} FROM e"),
    "wind_loso_strata": (wind_loso_strata, LOSO + _idw_sql("target, at", _NOT_OWN) + ",\n" + _errors_sql() + f", me AS (SELECT CASE WHEN nearest_km IS NULL THEN 'unavailable' WHEN nearest_km <= 3 THEN '≤3 km' WHEN nearest_km <= 5 THEN '3–5 km' WHEN nearest_km <= 10 THEN '5–10 km' ELSE '>10 km' END AS bucket, {METRICS} FROM e GROUP BY 1) SELECT * REPLACE (coalesce(n, 0) AS n, coalesce(predicted, 0) AS predicted) FROM (SELECT unnest({wind.DISTANCES}) AS bucket) LEFT JOIN me USING (bucket)"),
    "residual_table": (residual_table, LOSO + _idw_sql("target, at", _NOT_OWN) + """ SELECT target, at, CASE WHEN nearest_km IS NULL THEN 'unavailable' WHEN nearest_km <= 3 THEN '≤3 km' WHEN nearest_km <= 5 THEN '3–5 km' WHEN nearest_km <= 10 THEN '5–10 km' ELSE '>10 km' END AS bucket, quality,
        round(actual_u - u, 6) + 0.0 AS du, round(actual_v - v, 6) + 0.0 AS dv FROM idw WHERE u IS NOT NULL"""),
    "trace_terminations": (trace_terminations, None),
    "trace_surface": (trace_surface, None),
    "trace_regions": (trace_regions, None),
    "movement_consistency": (movement_consistency, None),
    "wind_param_sweep": (wind_param_sweep, LOSO + ",\n".join(f"{_idw_sql('target, at', _NOT_OWN, r, p, t)},\n{_errors_sql(t)}" for r, p, t in _SWEEP) + " UNION ALL ".join(f" SELECT {r}::DOUBLE AS radius_km, {p}::DOUBLE AS power, {METRICS} FROM e{t}" for r, p, t in _SWEEP)),
}

#: "at" is a keyword in SQL.
QUERIES = {k: (f, sql and re.sub(r"\bat\b", '"at"', sql)) for k, (f, sql) in _PLAIN.items()}
