"""Queries of diagnostics, current state, merges, streaming and plain relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import in_bbox
from ..functions.text import has_bad_time, tokens, valid_pm25
from ..operators import diagnostics, evidence, spatial, state
from ..operators.graph import shared_dir
from ..sources.readers import time_range
from ..streaming.ingest import current, present, running_bins, sliding, write_changes
from . import views
from .anomaly_queries import smoothed_bins
from .views import BINNED, hav, table, with_

BOX = (25.03, 121.42, 25.09, 121.48)
#: South, west, north, east of the monitors.
COVERED = (24.8, 121.2, 25.43, 121.83)
HOUR, LAGS = 3600, [-4, -3, -2, -1, 0, 1, 2, 3, 4]


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def fire_response(spark, d):
    fires = views.fires(spark, d)
    out = diagnostics.response(views.obs(spark, d), fires, views.stations(spark), 3.0, 24 * HOUR, 12 * HOUR, 12 * HOUR)
    return out.select("fire_id", "station_id", "n", "response", *_r("baseline", "during", "post", "peak", "delta"))


def windy_fires(spark, d):
    """Fires with a wind of their own, from their key; every tenth is still."""
    f = views.fires(spark, d).select("fire_id", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"), F.col("frp"))
    still = F.col("fire_id") % 10 == 0
    return f.withColumns({"toward_deg": F.when(~still, ((F.col("fire_id") * 47) % 360).cast("double")), "speed_mps": F.when(still, 0.0).otherwise(F.col("frp") / 20)})


def fire_wind_relation(spark, d):
    f = windy_fires(spark, d)
    a = f.withColumns({"a_lat": F.col("f_lat"), "a_lon": F.col("f_lon")})
    b = views.stations(spark).withColumns({"b_lat": F.col("lat"), "b_lon": F.col("lon")})
    out = diagnostics.wind_relation(spatial.distance_join(a, b, 3.0).where("distance_km > 0.01"))
    return out.select("fire_id", "station_id", "relation", *_r("distance_km", "off_deg", "travel_minutes"))


def _fire_responses(spark, d):
    fires = windy_fires(spark, d)
    out = diagnostics.event_response(views.obs(spark, d), views.fires(spark, d), views.stations(spark), 3.0, 6.0, 24 * HOUR, 12 * HOUR, 24 * HOUR)
    sides = diagnostics.wind_relation(out.join(fires, "fire_id").join(views.stations(spark), "station_id"))
    return sides.drop("f_lat", "f_lon", "lat", "lon", "frp")


def fire_response_windows(spark, d):
    out = _fire_responses(spark, d)
    return out.select("fire_id", "station_id", "local", "peak_t", *_r("baseline", "during", "post", "post_first", "post_second", "post_last", "peak", "excess", "delta", "percent"))


def fire_classes(spark, d):
    return diagnostics.classify_fires(_fire_responses(spark, d))


def stream_sliding(spark, d):
    """Sliding windows of a day, every six hours, over the stream; readings flagged as from the future are left out before the watermark sees them."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumns({"ts": F.col("ts").cast("timestamp"), "station_id": F.pmod("user_id", F.lit(48)), "quality_flags": views.flags(F.col("event_id"))})
    path = shared_dir(spark)
    write_changes(sliding(present(stream), "1 day", "6 hours"), f"{path}/windows", f"{path}/checkpoint").awaitTermination()
    return current(spark.read.parquet(f"{path}/windows"), ["w", "station_id"]).select("station_id", F.unix_seconds("w.start").alias("start"), "n", F.round("mean", 6).alias("mean"), "high")


def live_window(spark, d):
    """The last two days of the table, found from its latest time, and how many rows each station has there."""
    o = views.obs(spark, d)
    return state.window_of(o, "t", latest_hours=48).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"))


def facility_monitored(spark, d):
    """Facilities with a flag that their control number, as written or normalised, is among the monitored ones."""
    f = table(spark, d, "supplier").select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, " a ").otherwise("A"), F.col("s_suppkey").cast("string")).alias("number"))
    monitored = table(spark, d, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("number"))
    return evidence.flagged(f, monitored, "number", "monitored").select("s_suppkey", "monitored")


def ring_baseline(spark, d):
    pairs = spatial.neighbor_pairs(views.stations(spark), 5.0)
    values = smoothed_bins(spark, d).select(F.col("station_id").alias("b"), "bucket", F.col("smoothed").alias("value"))
    return diagnostics.ring_medians(pairs, values).select("a", "bucket", "ring", "n", *_r("median"))


def ring_contrasts(spark, d):
    pairs = spatial.neighbor_pairs(views.stations(spark), 5.0)
    bins = smoothed_bins(spark, d).select("station_id", "bucket", F.col("smoothed").alias("value"))
    medians = diagnostics.ring_medians(pairs, bins.withColumnRenamed("station_id", "b"))
    return diagnostics.ring_contrasts(medians, bins.withColumnRenamed("station_id", "a")).select("a", "bucket", *_r("value", "near", "far", "over_near", "over_far", "gradient"))


def reference_nearest(spark, d):
    """The fifteen nearest stations of each within 50 km."""
    return spatial.nearest_within(views.monitors(spark, d), 15, 50.0).select("a", "b", "rank", *_r("distance_km"))


def regional_outliers(spark, d):
    """Bins whose value is far from those of all stations in the same bin."""
    return state.regional_outliers(smoothed_bins(spark, d).select("station_id", "bucket", "value"), "bucket", "value").select("station_id", "bucket", "side", *_r("value"))


def prior_peaks(spark, d):
    bins = smoothed_bins(spark, d)
    base = bins.groupBy("station_id").agg(F.percentile("value", F.lit(0.7)).alias("base"))
    return diagnostics.prior_peaks(diagnostics.peaks(bins.join(base, "station_id"), refractory=43_200), 7 * 86_400)


def lagged_corr(spark, d):
    pairs = spatial.neighbor_pairs(views.stations(spark), 3.0)
    out = diagnostics.lagged_correlation(pairs, smoothed_bins(spark, d).select("station_id", "bucket", F.col("smoothed").alias("value")), 21_600, LAGS)
    return out.select("a", "b", "lag", "n", *_r("r"))


def spike_morphology(spark, d):
    bins = smoothed_bins(spark, d)
    base = bins.groupBy("station_id").agg(F.percentile("value", F.lit(0.9)).alias("base"))
    return diagnostics.morphology(bins.join(base, "station_id"), step=21_600)


def coverage_grid(spark, d):
    return diagnostics.coverage(views.monitors(spark, d), *COVERED, *spatial.grid_shape(*COVERED, 2500.0)).withColumn("gap", F.coalesce("gap", F.lit(-1)))


#: South, west, north, east of the customers' places.
HOMES = (25.0, 121.4, 25.12, 121.52)


def core_zone(spark, d):
    """The core that the customers in credit suggest, machinery and cars being industrial."""
    c = views.place(table(spark, d, "customer").withColumn("k", F.col("c_custkey")), "k")
    points = c.select("lat", "lon", (F.col("c_acctbal") > 6000).alias("fresh"), F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE").alias("industrial"))
    return diagnostics.core_zone(points, HOMES, *spatial.grid_shape(*HOMES)).select("basis", "grown", "cells", "fresh", "industrial", *_r("south", "west", "north", "east", "coverage"))


def nn_spacing(spark, d):
    one = spatial.nearest_within(views.monitors(spark, d), 1, 10.0)
    return one.agg(F.count(F.lit(1)).alias("stations"), F.round(F.percentile("distance_km", F.lit(0.5)), 6).alias("median_km"), F.round(F.percentile("distance_km", F.lit(0.9)), 6).alias("p90_km"))


def live_state(spark, d):
    o = views.obs(spark, d)
    now = o.agg(F.max("t").alias("now"))
    st = views.stations(spark).where(in_bbox("lat", "lon", *BOX))
    last = state.latest(o, "station_id")
    out = st.join(last, "station_id", "left").join(F.broadcast(now)).withColumn("age_s", F.col("now") - F.col("t"))
    return out.select("station_id", "obs_id", "t", "value", "age_s", state.freshness(F.col("age_s"), 7200, 43_200).alias("freshness"))


def historical_state_at(spark, d):
    return state.latest(views.obs(spark, d), "station_id", 1_704_800_000).select("station_id", "obs_id", "t", "value")


def latest_per_key(spark, d):
    return state.latest(views.obs(spark, d), "station_id").select("station_id", "obs_id", "t")


def recorder_status(spark, d):
    o = views.obs(spark, d)
    o = o.join(o.groupBy("event_type").agg(F.max("t").alias("last")), "event_type").withColumn("recent", F.col("t") >= F.col("last") - 86_400)
    return o.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if("recent").alias("rows_24h"), F.countDistinct(F.when(F.col("recent"), F.col("station_id"))).alias("stations_24h"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def radius_counts(spark, d):
    return spatial.counts_within(views.monitors(spark, d), [0.5, 1.0, 2.0, 5.0])


def topk_industries(spark, d):
    return views.facilities(spark, d).groupBy("industry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "industry").limit(3)


def scan_time_range(spark, d):
    e = table(spark, d, "events")
    return time_range(e, "ts", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"), closed=False).select("event_id", "user_id", "value")


def span_stats(spark, d):
    e = views.events(spark, d)
    return e.groupBy("event_type").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))


def flag_tokens(spark, d):
    e = views.events(spark, d)
    flags = F.concat(F.when(F.col("event_id") % 7 == 0, "invalid_pm25;").otherwise(""), F.when(F.col("event_id") % 5 == 0, "future_timestamp_ahead_seconds=12.0;").otherwise(""), F.lit("ok;ok"))
    e = e.withColumn("tok", tokens(flags))
    return e.select("event_id", F.size("tok").cast("long").alias("n_tokens"), F.array_join("tok", "|").alias("tokens"), (valid_pm25(F.col("value"), F.col("tok")) & ~has_bad_time(F.col("tok"))).alias("usable"))


def upsert_dims(spark, d):
    e = views.events(spark, d)
    make = lambda x: x.groupBy("user_id").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.max_by("event_type", F.struct("t", "event_id")).alias("last_type"))
    cut = 1_705_000_000
    return state.upsert_dimension(make(e.where(F.col("t") < cut)), make(e.where(F.col("t") >= cut)), "user_id")


def insert_dedupe(spark, d):
    o = views.obs(spark, d).select("station_id", "t", "obs_id")
    old, new = o.where("obs_id % 3 = 0"), o.where("obs_id % 2 = 0").unionByName(o.where("obs_id % 4 = 0"))
    return old.unionByName(state.insert_absent(old, new, ["station_id", "t"]))


def unpivot_hours(spark, d):
    e = views.events(spark, d).withColumns({"day": F.floor(F.col("t") / 86_400), "hour": F.floor(F.col("t") % 86_400 / 3600)})
    wide = e.groupBy("day").pivot("hour", list(range(24))).agg(F.max("value"))
    return diagnostics.unpivot_hours(wide.select("day", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)]), ["day"], "h")


def hourly_reference(spark, d):
    e = views.events(spark, d).withColumn("hour", F.floor(F.col("t") / 3600))
    q = lambda p: F.percentile("value", F.lit(p))
    return e.groupBy("hour").agg(F.count("value").alias("n"), F.round(q(0.5), 6).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(q(0.75) - q(0.25), 6).alias("iqr"))


def stream_bin_dedupe(spark, d):
    """The stream of events, read as one, through tumbling six-hour bins; the final table after all that is there has been read."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumns({"ts": F.col("ts").cast("timestamp"), "station_id": F.pmod("user_id", F.lit(48))})
    path = shared_dir(spark)
    write_changes(running_bins(stream, 360), f"{path}/bins", f"{path}/checkpoint").awaitTermination()
    return current(spark.read.parquet(f"{path}/bins"), ["w", "station_id"]).select("station_id", F.unix_seconds("w.start").alias("bucket"), "last_value", "n")


def rel_semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    big = o.where("o_totalprice > 100000")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def rel_rollup(spark, d):
    li = table(spark, d, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def rel_set_ops(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("k"))
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.subtract(b).withColumn("kind", F.lit("only"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


_BRG = "((degrees(atan2(sin(radians(s.lon - f.lon)) * cos(radians(s.lat)), cos(radians(f.lat)) * sin(radians(s.lat)) - sin(radians(f.lat)) * cos(radians(s.lat)) * cos(radians(s.lon - f.lon)))) % 360) + 360) % 360"
_RESPONSES = f""", rp AS (SELECT f.fire_id, f.t AS ft, s.station_id, {hav('f', 's')} AS km, {_BRG} AS brg, CASE WHEN f.fire_id % 10 <> 0 THEN ((f.fire_id * 47) % 360)::DOUBLE END AS toward FROM fire f, station s),
        rm AS (SELECT p.*, o.value, o.t, o.t - p.ft AS d FROM (SELECT * FROM rp WHERE km <= 6.0) p JOIN obs o ON o.station_id = p.station_id AND o.t - p.ft >= -86400 AND o.t - p.ft < 129600),
        rg AS (SELECT fire_id, station_id, any_value(km) <= 3.0 AS local, any_value(brg) AS brg, any_value(toward) AS toward, quantile_cont(value, 0.5) FILTER (WHERE d < 0) AS baseline, quantile_cont(value, 0.5) FILTER (WHERE d >= 0 AND d < 43200) AS during,
            quantile_cont(value, 0.5) FILTER (WHERE d >= 43200) AS post, quantile_cont(value, 0.5) FILTER (WHERE d >= 43200 AND d < 64800) AS post_first, quantile_cont(value, 0.5) FILTER (WHERE d >= 64800 AND d < 86400) AS post_second,
            quantile_cont(value, 0.5) FILTER (WHERE d >= 86400) AS post_last, max(value) FILTER (WHERE d >= 0) AS peak, arg_max(t, (value, -t)) FILTER (WHERE d >= 0) AS peak_t FROM rm GROUP BY 1, 2),
        rs AS (SELECT *, peak - baseline AS excess, during - baseline AS delta, least((brg - toward + 720) % 360, 360 - (brg - toward + 720) % 360) AS off_deg FROM rg)"""
_ROWS, _COLS = spatial.grid_shape(*COVERED, 2500.0)
_GAP = f"""dn AS (SELECT i // {_COLS} AS "row", i % {_COLS} AS col FROM range({_ROWS * _COLS}) r(i)),
hv AS (SELECT CAST(least(floor((lat - {COVERED[0]}::DOUBLE) / (({COVERED[2]}::DOUBLE - {COVERED[0]}::DOUBLE) / {_ROWS})), {_ROWS - 1}) AS INTEGER) AS "row", CAST(least(floor((lon - {COVERED[1]}::DOUBLE) / (({COVERED[3]}::DOUBLE - {COVERED[1]}::DOUBLE) / {_COLS})), {_COLS - 1}) AS INTEGER) AS col, count(*) AS n
    FROM monitor WHERE lat BETWEEN {COVERED[0]} AND {COVERED[2]} AND lon BETWEEN {COVERED[1]} AND {COVERED[3]} GROUP BY 1, 2),
fu AS (SELECT dn."row", dn.col, coalesce(n, 0) AS n FROM dn LEFT JOIN hv USING ("row", col)), em AS (SELECT "row" * {_COLS} + col AS id, "row", col FROM fu WHERE n = 0),
eg AS (SELECT a.id AS u, b.id AS v FROM em a JOIN em b ON abs(a."row" - b."row") + abs(a.col - b.col) = 1),
rr(id, r) AS (SELECT id, id FROM em UNION SELECT eg.v, rr.r FROM rr JOIN eg ON eg.u = rr.id), ga AS (SELECT id, min(r) AS gap FROM rr GROUP BY 1)"""
_RING = "(VALUES ('1_2', 1.0, 2.0, false), ('1_3', 1.0, 3.0, false), ('2_3', 2.0, 3.0, false), ('2_5', 2.0, 5.0, true)) r(ring, lo, hi, closed)"
_PAIR = f"pr AS (SELECT a.station_id AS a, b.station_id AS b, {hav('a', 'b')} AS d FROM station a, station b WHERE a.station_id <> b.station_id)"
_MPAIR = _PAIR.replace("FROM station a, station b", "FROM monitor a, monitor b")
_LATEST = "la AS (SELECT * FROM obs {where} QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY t DESC, obs_id) = 1)"

_HR, _HC = spatial.grid_shape(*HOMES)
_ZONE = f"""pt AS (SELECT 25.0::DOUBLE + ((c_custkey * 37) % 121) / 1000.0::DOUBLE AS lat, 121.4::DOUBLE + ((c_custkey * 53) % 121) / 1000.0::DOUBLE AS lon, c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') AS ind FROM customer WHERE c_acctbal > 6000),
ce AS (SELECT CAST(least(floor((lat - {HOMES[0]}::DOUBLE) / (({HOMES[2]}::DOUBLE - {HOMES[0]}::DOUBLE) / {_HR})), {_HR - 1}) AS INTEGER) AS r, CAST(least(floor((lon - {HOMES[1]}::DOUBLE) / (({HOMES[3]}::DOUBLE - {HOMES[1]}::DOUBLE) / {_HC})), {_HC - 1}) AS INTEGER) AS c, count(*) AS n, count(*) FILTER (WHERE ind) AS k
    FROM pt WHERE lat BETWEEN {HOMES[0]} AND {HOMES[2]} AND lon BETWEEN {HOMES[1]} AND {HOMES[3]} GROUP BY 1, 2),
ca AS (SELECT *, n >= 2 AND (k >= 2 OR k / n >= 0.5) AS aff FROM ce), cl AS (SELECT bool_or(aff) AS anyone, quantile_cont(n, 0.75) AS p FROM ca),
ch AS (SELECT r, c, n, k, r * {_HC} + c AS id, CASE WHEN anyone THEN 'industrial' ELSE 'dense' END AS basis FROM ca, cl WHERE CASE WHEN anyone THEN aff ELSE n >= greatest(2, floor(p)) END),
zr(id, root) AS (SELECT id, id FROM ch UNION SELECT b.id, zr.root FROM zr JOIN ch a ON a.id = zr.id JOIN ch b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
zl AS (SELECT id, min(root) AS root FROM zr GROUP BY 1),
zb AS (SELECT root, basis, sum(k) AS industrial, sum(n) AS fresh, count(*) AS size, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM ch JOIN zl USING (id) GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 5 DESC, 1 LIMIT 1),
zg AS (SELECT greatest(r0 - 1, 0) AS r0, least(r1 + 1, {_HR - 1}) AS r1, greatest(c0 - 1, 0) AS c0, least(c1 + 1, {_HC - 1}) AS c1 FROM zb),
zw AS (SELECT count(*) AS h, sum(n) AS f, sum(k) AS i, any_value((r1 - r0 + 1) * (c1 - c0 + 1)) AS area FROM ce, zg WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1),
zf AS (SELECT basis, h / area >= 0.75 AS wide, size, fresh, industrial, h, f, i, area, CASE WHEN h / area >= 0.75 THEN zg.r0 ELSE zb.r0 END AS r0, CASE WHEN h / area >= 0.75 THEN zg.r1 ELSE zb.r1 END AS r1, CASE WHEN h / area >= 0.75 THEN zg.c0 ELSE zb.c0 END AS c0, CASE WHEN h / area >= 0.75 THEN zg.c1 ELSE zb.c1 END AS c1 FROM zb, zg, zw)"""

QUERIES = {
    "core_zone": (core_zone, "WITH RECURSIVE " + _ZONE + f""" SELECT basis, wide::INTEGER AS grown, CAST(CASE WHEN wide THEN area ELSE size END AS BIGINT) AS cells, CAST(CASE WHEN wide THEN f ELSE fresh END AS BIGINT) AS fresh, CAST(CASE WHEN wide THEN i ELSE industrial END AS BIGINT) AS industrial,
        round({HOMES[0]} + r0 * ({HOMES[2]}::DOUBLE - {HOMES[0]}::DOUBLE) / {_HR}, 6) AS south, round({HOMES[1]} + c0 * ({HOMES[3]}::DOUBLE - {HOMES[1]}::DOUBLE) / {_HC}, 6) AS west, round({HOMES[0]} + (r1 + 1) * ({HOMES[2]}::DOUBLE - {HOMES[0]}::DOUBLE) / {_HR}, 6) AS north, round({HOMES[1]} + (c1 + 1) * ({HOMES[3]}::DOUBLE - {HOMES[1]}::DOUBLE) / {_HC}, 6) AS east,
        round(CASE WHEN wide THEN h / area ELSE 1.0 END, 6) AS coverage FROM zf"""),
    "fire_response": (fire_response, with_("obs", "station", "fire") + f""", p AS (SELECT f.fire_id, f.t AS ft, s.station_id FROM fire f, station s WHERE {hav('f', 's')} <= 3.0),
        m AS (SELECT p.fire_id, p.station_id, o.value, o.t - p.ft AS d FROM p JOIN obs o ON o.station_id = p.station_id AND o.t - p.ft >= -86400 AND o.t - p.ft < 86400),
        g AS (SELECT fire_id, station_id, quantile_cont(value, 0.5) FILTER (WHERE d < 0) AS baseline, quantile_cont(value, 0.5) FILTER (WHERE d >= 0 AND d < 43200) AS during, quantile_cont(value, 0.5) FILTER (WHERE d >= 43200) AS post,
              max(value) FILTER (WHERE d >= 0) AS peak, count(value) FILTER (WHERE d >= 0) AS n FROM m GROUP BY 1, 2)
        SELECT fire_id, station_id, n, CASE WHEN peak - baseline IS NULL THEN 'no_data' WHEN peak - baseline >= 5 THEN 'clear' WHEN peak - baseline >= 2 THEN 'weak' ELSE 'none' END AS response,
               round(baseline, 6) AS baseline, round(during, 6) AS during, round(post, 6) AS post, round(peak, 6) AS peak, round(peak - baseline, 6) AS delta FROM g"""),
    "fire_wind_relation": (fire_wind_relation, with_("station", "fire") + f""", p AS (SELECT f.fire_id, s.station_id, {hav('f', 's')} AS d, CASE WHEN f.fire_id % 10 <> 0 THEN ((f.fire_id * 47) % 360)::DOUBLE END AS toward, CASE WHEN f.fire_id % 10 = 0 THEN 0.0 ELSE f.frp / 20 END AS speed,
        ((degrees(atan2(sin(radians(s.lon - f.lon)) * cos(radians(s.lat)), cos(radians(f.lat)) * sin(radians(s.lat)) - sin(radians(f.lat)) * cos(radians(s.lat)) * cos(radians(s.lon - f.lon)))) % 360) + 360) % 360 AS brg FROM fire f, station s),
        q AS (SELECT *, least((brg - toward + 720) % 360, 360 - (brg - toward + 720) % 360) AS off_deg FROM p WHERE d <= 3.0 AND d > 0.01)
        SELECT fire_id, station_id, CASE WHEN toward IS NULL THEN 'unknown' WHEN off_deg <= 45 THEN 'downwind' WHEN off_deg < 135 THEN 'crosswind' ELSE 'upwind' END AS relation, round(d, 6) AS distance_km,
               round(CASE WHEN toward IS NOT NULL THEN off_deg END, 6) AS off_deg, round(CASE WHEN speed > 0 THEN d * 1000 / speed / 60 END, 6) AS travel_minutes FROM q"""),
    "fire_response_windows": (fire_response_windows, with_("obs", "station", "fire") + _RESPONSES + """ SELECT fire_id, station_id, local, peak_t, round(baseline, 6) AS baseline, round(during, 6) AS during, round(post, 6) AS post, round(post_first, 6) AS post_first, round(post_second, 6) AS post_second,
        round(post_last, 6) AS post_last, round(peak, 6) AS peak, round(excess, 6) AS excess, round(delta, 6) AS delta, round(100 * delta / greatest(abs(baseline), 1.0), 6) AS percent FROM rs"""),
    "fire_classes": (fire_classes, with_("obs", "station", "fire") + _RESPONSES + """, cl AS (SELECT fire_id, count(*) FILTER (WHERE local AND excess IS NOT NULL) AS measured, count(*) FILTER (WHERE local AND excess >= 2) AS positive, count(*) FILTER (WHERE local AND excess >= 5) AS clear,
        count(*) FILTER (WHERE local AND excess >= 5 AND off_deg <= 45) AS downwind_clear, count(*) FILTER (WHERE NOT local AND delta IS NOT NULL) AS around, count(*) FILTER (WHERE NOT local AND delta >= 2) AS around_up FROM rs GROUP BY 1)
        SELECT fire_id, measured, positive, clear, downwind_clear, CASE WHEN measured = 0 THEN 'INSUFFICIENT_SENSOR_COVERAGE' WHEN around > 0 AND around_up >= 0.5 * around AND positive >= 0.5 * measured THEN 'AMBIGUOUS_REGIONAL_BACKGROUND'
             WHEN clear >= 3 OR (clear >= 2 AND downwind_clear >= 2) THEN 'CLEAR_SENSOR_RESPONSE' WHEN positive > 0 THEN 'WEAK_SENSOR_RESPONSE' ELSE 'NO_MEASURABLE_RESPONSE' END AS class FROM cl"""),
    "stream_sliding": (stream_sliding, with_("obs") + """, w AS (SELECT station_id, value, (t // 21600 - k) * 21600 AS start FROM obs, range(4) r(k) WHERE NOT contains(quality_flags, 'future_timestamp'))
        SELECT station_id, start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high FROM w GROUP BY 1, 2"""),
    "live_window": (live_window, with_("obs") + " SELECT station_id, count(*) AS n, min(t) AS first_t FROM obs WHERE t >= (SELECT max(t) FROM obs) - 172800 GROUP BY 1"),
    "facility_monitored": (facility_monitored, "SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49 AND l_suppkey = s_suppkey) AS monitored FROM supplier"),
    "ring_baseline": (ring_baseline, with_("obs", "station", BINNED, _PAIR) + f" SELECT a, bucket, ring, count(*) AS n, round(quantile_cont(smoothed, 0.5), 6) AS median FROM pr JOIN {_RING} ON d >= lo AND (d < hi OR (closed AND d <= hi)) JOIN smoothed ON station_id = b GROUP BY 1, 2, 3"),
    "ring_contrasts": (ring_contrasts, with_("obs", "station", BINNED, _PAIR) + f""", rm AS (SELECT a, bucket, ring, quantile_cont(smoothed, 0.5) AS m FROM pr JOIN {_RING} ON d >= lo AND (d < hi OR (closed AND d <= hi)) JOIN smoothed ON station_id = b GROUP BY 1, 2, 3),
        rc AS (SELECT station_id AS a, s.bucket, smoothed AS value, (SELECT m FROM rm WHERE rm.a = station_id AND rm.bucket = s.bucket AND ring = '1_2') AS near, (SELECT m FROM rm WHERE rm.a = station_id AND rm.bucket = s.bucket AND ring = '2_5') AS far FROM smoothed s)
        SELECT a, bucket, round(value, 6) AS value, round(near, 6) AS near, round(far, 6) AS far, round(value - near, 6) AS over_near, round(value - far, 6) AS over_far, round(near - far, 6) AS gradient FROM rc"""),
    "reference_nearest": (reference_nearest, with_("monitor", _MPAIR) + " SELECT a, b, CAST(row_number() OVER (PARTITION BY a ORDER BY d, b) AS INTEGER) AS rank, round(d, 6) AS distance_km FROM pr WHERE d <= 50 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 15"),
    "regional_outliers": (regional_outliers, with_("obs", BINNED) + """, f AS (SELECT bucket, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM binned GROUP BY 1)
        SELECT station_id, b.bucket, CASE WHEN value > q3 + 1.5 * (q3 - q1) THEN 'high' ELSE 'low' END AS side, round(value, 6) AS value FROM binned b JOIN f USING (bucket) WHERE n >= 4 AND (value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1))"""),
    "prior_peaks": (prior_peaks, None),
    "lagged_corr": (lagged_corr, with_("obs", "station", BINNED, _PAIR) + """, c AS (SELECT a, b, lag, count(*) AS n, corr(x.smoothed, y.smoothed) AS r FROM pr JOIN smoothed x ON x.station_id = a, range(-4, 5) l(lag), smoothed y
        WHERE d <= 3.0 AND y.station_id = b AND y.bucket = x.bucket + lag * 21600 GROUP BY 1, 2, 3) SELECT a, b, lag, n, round(CASE WHEN n >= 5 AND NOT isnan(r) THEN r END, 6) AS r FROM c"""),
    "spike_morphology": (spike_morphology, None),
    "coverage_grid": (coverage_grid, with_("monitor", _GAP).replace("WITH ", "WITH RECURSIVE ", 1) + ' SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, n, coalesce(gap, -1) AS gap FROM fu LEFT JOIN ga ON ga.id = "row" * ' + f"{_COLS} + col"),
    "nn_spacing": (nn_spacing, with_("monitor", _MPAIR) + ", m AS (SELECT a, min(d) AS d FROM pr GROUP BY 1) SELECT count(*) AS stations, round(quantile_cont(d, 0.5), 6) AS median_km, round(quantile_cont(d, 0.9), 6) AS p90_km FROM m WHERE d <= 10"),
    "live_state": (live_state, with_("obs", "station", _LATEST.format(where="")) + f""", j AS (SELECT s.station_id, obs_id, t, value, (SELECT max(t) FROM obs) - t AS age_s FROM station s LEFT JOIN la ON la.station_id = s.station_id
        WHERE lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]}) SELECT *, CASE WHEN age_s IS NULL THEN 'offline' WHEN age_s < -60 THEN 'future_timestamp' WHEN age_s <= 7200 THEN 'fresh' WHEN age_s <= 43200 THEN 'stale' ELSE 'offline' END AS freshness FROM j"""),
    "historical_state_at": (historical_state_at, with_("obs", _LATEST.format(where="WHERE t <= 1704800000")) + " SELECT station_id, obs_id, t, value FROM la"),
    "latest_per_key": (latest_per_key, with_("obs", _LATEST.format(where="")) + " SELECT station_id, obs_id, t FROM la"),
    "recorder_status": (recorder_status, with_("obs") + """, x AS (SELECT *, t >= max(t) OVER (PARTITION BY event_type) - 86400 AS recent FROM obs)
        SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE recent) AS rows_24h, count(DISTINCT station_id) FILTER (WHERE recent) AS stations_24h, min(t) AS first_t, max(t) AS last_t FROM x GROUP BY 1"""),
    "radius_counts": (radius_counts, with_("monitor", _MPAIR) + ' SELECT a, count(*) FILTER (WHERE d <= 0.5) AS "within_0.5km", count(*) FILTER (WHERE d <= 1) AS within_1km, count(*) FILTER (WHERE d <= 2) AS within_2km, count(*) FILTER (WHERE d <= 5) AS within_5km FROM pr WHERE d <= 5 GROUP BY 1'),
    "topk_industries": (topk_industries, "SELECT c_mktsegment AS industry, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, industry LIMIT 3"),
    "scan_time_range": (scan_time_range, "SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'"),
    "span_stats": (span_stats, with_("obs") + " SELECT event_type, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM obs GROUP BY 1"),
    "flag_tokens": (flag_tokens, """WITH k AS (SELECT event_id, value, (event_id % 7 = 0)::INT + (event_id % 5 = 0)::INT + 1 AS n, CASE WHEN event_id % 7 = 0 THEN 'invalid_pm25|' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN 'future_timestamp_ahead_seconds=12.0|' ELSE '' END || 'ok' AS tokens FROM events)
        SELECT event_id, CAST(n AS BIGINT) AS n_tokens, tokens, value >= 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0 AS usable FROM k"""),
    "upsert_dims": (upsert_dims, "WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT user_id, arg_max(event_type, (t, event_id)) AS last_type, min(t) AS first_seen, max(t) AS last_seen FROM e GROUP BY 1"),
    "insert_dedupe": (insert_dedupe, with_("obs") + """, old AS (SELECT station_id, t, obs_id FROM obs WHERE obs_id % 3 = 0), new AS (SELECT station_id, t, min(obs_id) AS obs_id FROM obs WHERE obs_id % 2 = 0 GROUP BY 1, 2)
        SELECT * FROM old UNION ALL SELECT new.* FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.station_id = new.station_id AND old.t = new.t)"""),
    "unpivot_hours": (unpivot_hours, with_("obs") + " SELECT t // 86400 AS day, CAST(t % 86400 // 3600 AS INTEGER) AS hour, max(value) AS value FROM obs GROUP BY 1, 2"),
    "hourly_reference": (hourly_reference, with_("obs") + " SELECT t // 3600 AS hour, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM obs GROUP BY 1"),
    "stream_bin_dedupe": (stream_bin_dedupe, "WITH e AS (SELECT *, user_id % 48 AS station_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT station_id, t - t % 21600 AS bucket, arg_max(value, ts) AS last_value, count(*) AS n FROM e GROUP BY 1, 2"),
    "rel_semi_anti": (rel_semi_anti, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) GROUP BY 1"),
    "rel_rollup": (rel_rollup, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "rel_set_ops": (rel_set_ops, """WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000)
        SELECT kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT k, 'both' AS kind FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'only' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) GROUP BY 1"""),
}
