"""Queries of parsers, labels, geometry and plain selections, over every row of the event table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels, parse, text
from ..functions.geo import from_deg, toward_deg
from ..operators import events, state
from . import views
from .anomaly_queries import smoothed_bins
from .views import BINNED, with_

LAT0, LON0 = 25.06, 121.45


def _r(*pairs):
    return [F.round(c, 6).alias(n) for n, c in pairs]


def wind_status(spark, d):
    """Raw directions and speeds of all kinds, from the event's number."""
    k = F.col("event_id")
    direction = F.when(k % 10 == 0, "x").when(k % 10 == 1, "-99").when(k % 10 == 2, "990").when(k % 10 == 3, "0").when(k % 10 == 4, "1000").otherwise((k * 37 % 361).cast("string"))
    speed = F.when(k % 7 == 0, "").when(k % 11 == 0, "0").when(k % 13 == 0, " -1").otherwise((k % 9).cast("string"))
    out = views.events(spark, d).select("event_id", parse.wind(direction, speed).alias("w"))
    return out.select("event_id", "w.status", F.array_join("w.flags", ";").alias("flags"), *_r(("u", F.col("w.u")), ("v", F.col("w.v"))))


def parsed_times(spark, d):
    """A time in five layouts, and texts that are none."""
    e = views.events(spark, d)
    k, ts = F.col("event_id"), F.timestamp_seconds("t")
    local = F.timestamp_seconds(F.col("t") + 8 * 3600)
    text = (
        F.when(k % 6 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k % 6 == 1, F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")))
        .when(k % 6 == 2, F.date_format(local, "yyyy/MM/dd HH:mm"))
        .when(k % 6 == 3, F.date_format(local, "yyyy-MM-dd HH:mm:ss"))
        .when(k % 6 == 4, F.concat(F.lit("2020-01-01T00:00:00Z/"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .otherwise("not a time")
    )
    return e.select("event_id", parse.utc_seconds(text).alias("at"))


def parsed_points(spark, d):
    """A place as GeoJSON, as a list, as text, out of range, and at zero."""
    k = F.col("event_id")
    lon, lat = (k % 340 - 170).cast("string"), (k % 170 - 85).cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit('{"type":"Point","coordinates":['), lon, F.lit(","), lat, F.lit("]}")))
        .when(k % 5 == 1, F.concat(F.lit("["), lon, F.lit(", "), lat, F.lit("]")))
        .when(k % 5 == 2, F.concat(lon, F.lit(" "), lat))
        .when(k % 5 == 3, F.concat(lon, F.lit(" 9"), F.abs(k % 90 + 10).cast("string")))
        .otherwise("0 0")
    )
    out = views.events(spark, d).select("event_id", parse.point(text).alias("p"))
    return out.select("event_id", "p.lat", "p.lon")


def field_lookup(spark, d):
    k = F.col("event_id")
    key = F.when(k % 4 == 0, "PM2.5_AVG").when(k % 4 == 1, "pm25avg").when(k % 4 == 2, "Pm-2.5 Avg").otherwise("o3")
    record = F.concat(F.lit('{"Site":"s","'), key, F.lit('":"'), k.cast("string"), F.lit('","pm2.5":""}'))
    out = views.events(spark, d).select("event_id", parse.field(record, "pm2.5", "pm2.5_avg").alias("value"), parse.is_fine_dust(key).alias("hourly"))
    return out


def emission_validity(spark, d):
    words = ["normal", "Calibration", "校正中", "Maint.", "ok", "invalid"]
    status = F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % 6 + 1).cast("int"))
    return views.events(spark, d).select("event_id", parse.valid_emission(status, F.when(F.col("event_id") % 9 == 0, "CAL-1")).alias("valid"))


def label_ladders(spark, d):
    k, v = F.col("event_id"), F.col("value")
    km = F.when(k % 10 > 0, (k % 70).cast("double") / 10)
    age = F.when(k % 12 > 0, k * 37 % 4000 - 900)
    fresh = labels.feed_freshness(age)
    e = views.events(spark, d).withColumn("m", labels.margin(v, 50))
    return e.select(
        "event_id",
        labels.station_bucket(k % 12).alias("stations"),
        labels.speed_bucket(F.when(k % 8 > 0, (k % 60).cast("double") / 10)).alias("speed"),
        labels.fire_bucket(km).alias("fire"),
        fresh.alias("freshness"),
        labels.inventory_status(fresh, age < -600, F.when(age.isNotNull(), k)).alias("inventory"),
        F.col("m.pass").alias("passes"),
        *_r(("margin", F.col("m.margin")), ("relative", labels.relative_delta(v - 50, v / 100))),
        labels.hotspot_source(k % 2 == 0, F.when(k % 3 == 0, F.array(F.lit("key not set"))).when(k % 5 == 0, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>")), k % 4).alias("hotspots"),
        labels.emission_source(k % 3, F.when(k % 4 > 0, k % 4 == 1)).alias("emissions"),
    )


def local_geometry(spark, d):
    """Local metres and back, degrees' lengths, cells and compass of every event's place."""
    e = views.place(views.events(spark, d), "event_id")
    x, y = labels.local_metres(F.col("lat"), F.col("lon"), LAT0, LON0)
    e = e.withColumns({"x": x, "y": y})
    back_lat, back_lon = labels.from_local(F.col("x"), F.col("y"), LAT0, LON0)
    per_lat, per_lon = labels.metres_per_degree(F.col("lat"))
    cell = labels.query_key(F.col("lat"), F.col("lon"), F.col("t"), 500.0, LAT0, LON0)
    return e.withColumn("c", cell).select("event_id", *_r(("x", F.col("x")), ("y", F.col("y")), ("lat", back_lat), ("lon", back_lon), ("per_lat", per_lat), ("per_lon", per_lon)), F.col("c.a").cast("long").alias("ci"), F.col("c.b").cast("long").alias("cj"), F.col("c.t").alias("ct"), labels.compass(F.col("lat"), F.col("lon"), 25.0, 121.4, 25.12, 121.52).alias("direction"))


def local_extent(spark, d):
    """The box of all places with ten kilometres around it, in local metres."""
    e = views.place(views.events(spark, d), "event_id")
    x, y = labels.local_metres(F.col("lat"), F.col("lon"), LAT0, LON0)
    return e.agg(*_r(("west", F.min(x) - 10_000), ("east", F.max(x) + 10_000), ("south", F.min(y) - 10_000), ("north", F.max(y) + 10_000)))


def weather_state(spark, d):
    """The latest wind of each station, and over all of them the mean vector and what it is worth."""
    last = state.latest(views.weather(spark, d).withColumn("obs_id", F.lit(0)), "station_id")
    mean = last.agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("u"), F.avg("v").alias("v"), F.max("t").alias("latest"))
    u, v = F.col("u"), F.col("v")
    return mean.select("n", "latest", *_r(("u", u), ("v", v), ("speed", F.hypot(u, v)), ("toward", toward_deg(u, v)), ("comes_from", F.pmod(toward_deg(u, v) + 180, F.lit(360.0)))), F.when(F.col("n") >= 3, "GOOD").otherwise("INSUFFICIENT_STATIONS").alias("quality"))


def step_changes(spark, d):
    """Per station the cadence and the changes between usable observations up to two days apart: gaps, jumps over 50, steepest rise and fall a minute."""
    w = Window.partitionBy("station_id").orderBy("t", "obs_id")
    o = views.obs(spark, d).withColumns({"dt": F.col("t") - F.lag("t").over(w), "dv": F.col("value") - F.lag("value").over(w)})
    soon = (F.col("dt") > 0) & (F.col("dt") <= 2 * 86_400)
    rate = F.when(soon, F.col("dv") / (F.col("dt") / 60))
    return o.groupBy("station_id").agg(F.max("dt").alias("longest_gap"), F.count_if(F.abs("dv") > 50).alias("jumps"), F.round(F.max(rate), 6).alias("rise"), F.round(F.min(rate), 6).alias("fall"))


def isolated_spikes(spark, d):
    """Elevated bins whose neighbours right before and right after are there and are not."""
    w = Window.partitionBy("station_id").orderBy("bucket")
    b = smoothed_bins(spark, d).withColumn("high", F.col("value") > 60)
    calm = lambda f, step: f("bucket").over(w).eqNullSafe(F.col("bucket") + step) & ~f("high").over(w)
    return b.withColumn("alone", F.col("high") & calm(F.lag, -21_600) & calm(F.lead, 21_600)).where("alone").select("station_id", "bucket")


def bin_coverage(spark, d):
    """Percent of the expected bins that a station has, a hundred at most."""
    o = views.obs(spark, d)
    span = o.agg(F.min("t").alias("a"), F.max("t").alias("b")).select((F.floor(F.col("b") / 21_600) - F.floor(F.col("a") / 21_600) + 1).alias("expected"))
    have = o.groupBy("station_id").agg(F.countDistinct(F.floor(F.col("t") / 21_600)).alias("bins"))
    return have.join(F.broadcast(span)).select("station_id", "bins", F.round(F.least(F.lit(100.0), 100.0 * F.col("bins") / F.col("expected")), 6).alias("percent"))


def outside_intervals(spark, d):
    """Bins that lie in no interval of six hours from a fire: a join on time slots, then an anti join."""
    bins = smoothed_bins(spark, d).select("station_id", "bucket")
    fires = views.fires(spark, d).select(F.explode(F.array(F.floor(F.col("t") / 21_600), F.floor(F.col("t") / 21_600) + 1)).alias("slot"), "t").withColumn("bucket", F.col("slot") * 21_600)
    inside = fires.where((F.col("bucket") >= F.col("t")) & (F.col("bucket") <= F.col("t") + 21_600)).select("bucket").distinct()
    return bins.join(inside, "bucket", "left_anti").select("station_id", "bucket")


def month_selection(spark, d):
    e = views.events(spark, d)
    return e.where(F.date_format(F.timestamp_seconds("t"), "yyyy-MM") == "2024-01").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def above_the_mean(spark, d):
    """Observations of users that spent more than the mean order: a join on the user under a scalar subquery."""
    orders = views.table(spark, d, "orders")
    mean = orders.agg(F.avg("o_totalprice").alias("mean"))
    rich = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top")).join(F.broadcast(mean)).where("top > mean").select(F.col("o_custkey").alias("user_id"))
    return views.events(spark, d).join(rich, "user_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def emission_upsert(spark, d):
    """Records by source and hour: a later table replaces values; records without a time are dropped."""
    e = views.events(spark, d).select((F.col("user_id") % 100).alias("source"), F.when(F.col("event_id") % 17 > 0, F.floor(F.col("t") / 3600)).alias("hour"), "value", "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return state.upsert_newest(old, new, ["source", "hour"], "event_id").select("source", "hour", F.round("value", 6).alias("value"))


def first_of_the_best(spark, d):
    """Of each station the observation with the largest value, the first of equals; stations without any are absent."""
    best = views.obs(spark, d).groupBy("station_id").agg(F.max_by(F.struct("obs_id", "t", "value"), F.struct("value", (-F.col("t")).alias("a"), (-F.col("obs_id")).alias("b"))).alias("m"))
    return best.select("station_id", "m.*")


def _pick(x, pairs, other):
    return "CASE " + " ".join(f"WHEN {x} = {k} THEN {v}" for k, v in pairs) + f" ELSE {other} END"


_AGE = "CASE WHEN event_id % 12 > 0 THEN event_id * 37 % 4000 - 900 END"
_FRESH = f"CASE WHEN {_AGE} IS NULL THEN 'missing_observation' WHEN {_AGE} < -300 THEN 'suspicious_future_timestamp' WHEN {_AGE} < 0 THEN 'clock_ahead' WHEN {_AGE} <= 600 THEN 'fresh' WHEN {_AGE} <= 1800 THEN 'stale' ELSE 'offline' END"
_PLACE = "pl AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, 25.0::DOUBLE + ((event_id * 37) % 121) / 1000.0::DOUBLE AS lat, 121.4::DOUBLE + ((event_id * 53) % 121) / 1000.0::DOUBLE AS lon FROM events)"
_LOCAL = f"lo AS (SELECT *, (lon - {LON0}::DOUBLE) * (111320.0::DOUBLE * cos(radians({LAT0}::DOUBLE))) AS x, (lat - {LAT0}::DOUBLE) * 110540.0::DOUBLE AS y FROM pl)"

def checked_numbers(spark, d):
    """Raw fields as numbers, with a flag for those that are no number or out of bounds."""
    k = F.col("event_id") % 7
    raw = F.when(k == 0, " N/A ").when(k == 1, "--").when(k == 2, "12,5").when(k == 3, "nan").otherwise(F.concat(F.lit(" "), F.round("value", 2).cast("string")))
    out = views.events(spark, d).withColumn("c", text.checked_number(raw, 0.0, 60.0))
    return out.select("event_id", "c.value", "c.invalid")


def incident_names(spark, d):
    """Names of fires from their times, numbered within the second."""
    f = views.fires(spark, d)
    n = F.row_number().over(Window.partitionBy("t").orderBy("fire_id"))
    return f.withColumn("n", n).select("fire_id", labels.incident_name("FIRE", F.col("t"), F.col("n")).alias("incident"), labels.cluster_name(F.col("t") - F.col("t") % 21_600, F.col("n")).alias("cluster"))


def wind_from(spark, d):
    """Where every measured wind comes from."""
    return views.weather(spark, d).select("station_id", "t", F.round(from_deg("u", "v"), 6).alias("from_deg"))


def named_orders(spark, d):
    """The orders of the suppliers' numbers, as events that are asked for by name: those that no order has are told."""
    orders = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_totalprice")
    asked = views.table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("event_id"))
    return events.named(orders, asked, "event_id").select("event_id", "found", "o_totalprice")


QUERIES = {
    "checked_numbers": (checked_numbers, """WITH r AS (SELECT event_id, event_id % 7 AS k, round(value, 2) AS v FROM events)
        SELECT event_id, CASE WHEN k > 3 AND v <= 60 THEN v END AS value, k IN (2, 3) OR (k > 3 AND v > 60) AS invalid FROM r"""),
    "incident_names": (incident_names, with_("fire") + """, n AS (SELECT fire_id, t, row_number() OVER (PARTITION BY t ORDER BY fire_id) AS n FROM fire)
        SELECT fire_id, 'FIRE_' || strftime(make_timestamp(t * 1000000), '%Y%m%d%H%M%S') || '_' || lpad(n::VARCHAR, 3, '0') AS incident, strftime(make_timestamp((t - t % 21600) * 1000000), '%Y%m%dT%H%M%SZ') || '-c' || lpad(n::VARCHAR, 2, '0') AS cluster FROM n"""),
    "wind_from": (wind_from, with_("weather") + " SELECT station_id, t, round(CASE WHEN sqrt(u * u + v * v) > 1e-12 THEN ((degrees(atan2(u, v)) + 180) % 360 + 360) % 360 END, 6) AS from_deg FROM weather"),
    "named_orders": (named_orders, "SELECT a.event_id, o_orderkey IS NOT NULL AS found, o_totalprice FROM (SELECT DISTINCT s_suppkey * 3 AS event_id FROM supplier) a LEFT JOIN orders ON o_orderkey = a.event_id"),
    "wind_status": (wind_status, f"""WITH r AS (SELECT event_id, {_pick("event_id % 10", [(0, "NULL"), (1, "NULL"), (2, "990.0"), (3, "0.0"), (4, "NULL")], "(event_id * 37 % 361)::DOUBLE")} AS dir,
        CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 9)::DOUBLE END AS sp FROM events),
        s AS (SELECT *, CASE WHEN dir IS NULL OR sp IS NULL THEN 'invalid' WHEN dir = 990 THEN 'variable' WHEN dir = 0 AND sp > 0 THEN 'inconsistent' WHEN dir = 0 THEN 'calm' ELSE 'valid' END AS status FROM r)
        SELECT event_id, status, CASE status WHEN 'invalid' THEN 'invalid_wind' WHEN 'variable' THEN 'variable_wind' WHEN 'inconsistent' THEN 'inconsistent_calm_direction;invalid_wind' WHEN 'calm' THEN 'calm_wind' ELSE '' END AS flags,
               round(CASE WHEN status = 'valid' THEN -sp * sin(radians(dir)) END, 6) + 0.0 AS u, round(CASE WHEN status = 'valid' THEN -sp * cos(radians(dir)) END, 6) + 0.0 AS v FROM s"""),
    "parsed_times": (parsed_times, with_("obs") + """ SELECT obs_id AS event_id, CASE WHEN obs_id % 6 = 5 THEN NULL WHEN obs_id % 6 = 2 THEN t - t % 60 ELSE t END AS "at" FROM obs"""),
    "parsed_points": (parsed_points, "SELECT event_id, CASE WHEN event_id % 5 < 3 AND NOT (event_id % 170 = 85 AND event_id % 340 = 170) THEN (event_id % 170 - 85)::DOUBLE END AS lat, CASE WHEN event_id % 5 < 3 AND NOT (event_id % 170 = 85 AND event_id % 340 = 170) THEN (event_id % 340 - 170)::DOUBLE END AS lon FROM events"),
    "field_lookup": (field_lookup, "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(event_id AS VARCHAR) END AS value, event_id % 4 < 0 AS hourly FROM events"),
    "emission_validity": (emission_validity, "SELECT event_id, event_id % 6 IN (0, 4) AND event_id % 9 <> 0 AS valid FROM events"),
    "label_ladders": (label_ladders, f"""SELECT event_id, {_pick("event_id % 12", [(3, "'3–4'"), (4, "'3–4'"), (5, "'5–6'"), (6, "'5–6'"), (7, "'7–8'"), (8, "'7–8'")], "'other'")} AS stations,
        CASE WHEN event_id % 8 = 0 THEN 'unavailable' WHEN event_id % 60 < 5 THEN '<0.5' WHEN event_id % 60 < 20 THEN '0.5–2' WHEN event_id % 60 <= 50 THEN '2–5' ELSE '>5' END AS speed,
        CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN event_id % 70 <= 5 THEN '0.5km' WHEN event_id % 70 <= 10 THEN '1km' WHEN event_id % 70 <= 20 THEN '2km' WHEN event_id % 70 <= 30 THEN '3km' WHEN event_id % 70 <= 50 THEN '5km' ELSE '>5km' END AS fire,
        {_FRESH} AS freshness, CASE WHEN coalesce({_AGE} < -600, false) THEN 'suspicious/future' WHEN {_AGE} IS NULL THEN 'missing observation' ELSE {_FRESH} END AS inventory,
        value >= 50 AS passes, round(value - 50, 6) AS margin, round(100 * (value - 50) / greatest(abs(value / 100), 1.0), 6) AS relative,
        CASE WHEN event_id % 2 <> 0 AND event_id % 3 = 0 THEN 'NOT_QUERIED_MISSING_KEY' WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'PARTIAL / UNAVAILABLE' WHEN event_id % 4 = 0 THEN 'NO FIRMS HOTSPOT DETECTED' ELSE 'QUERIED' END AS hotspots,
        CASE WHEN event_id % 3 = 0 THEN 'CEMS_CONTEXT_UNAVAILABLE' WHEN event_id % 4 IN (2, 3) THEN 'PARTIAL / UNAVAILABLE' ELSE 'AVAILABLE' END AS emissions FROM events"""),
    "local_geometry": (local_geometry, f"""WITH {_PLACE}, {_LOCAL} SELECT event_id, round(x, 6) AS x, round(y, 6) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon,
        round(111132.92 - 559.82 * cos(2 * radians(lat)) + 1.175 * cos(4 * radians(lat)), 6) AS per_lat, round(111412.84 * cos(radians(lat)) - 93.5 * cos(3 * radians(lat)), 6) AS per_lon,
        CAST(floor(x / 500) AS BIGINT) AS ci, CAST(floor(y / 500) AS BIGINT) AS cj, t - t % 60 AS ct,
        CASE WHEN abs(lat - (25.0::DOUBLE + 25.12::DOUBLE) / 2) <= 0.01 AND abs(lon - (121.4::DOUBLE + 121.52::DOUBLE) / 2) <= 0.01 THEN 'central' ELSE concat_ws('-', CASE WHEN lat - (25.0::DOUBLE + 25.12::DOUBLE) / 2 > 0.01 THEN 'north' WHEN lat - (25.0::DOUBLE + 25.12::DOUBLE) / 2 < -0.01 THEN 'south' END,
             CASE WHEN lon - (121.4::DOUBLE + 121.52::DOUBLE) / 2 > 0.01 THEN 'east' WHEN lon - (121.4::DOUBLE + 121.52::DOUBLE) / 2 < -0.01 THEN 'west' END) END AS direction FROM lo"""),
    "local_extent": (local_extent, f"WITH {_PLACE}, {_LOCAL} SELECT round(min(x) - 10000, 6) AS west, round(max(x) + 10000, 6) AS east, round(min(y) - 10000, 6) AS south, round(max(y) + 10000, 6) AS north FROM lo"),
    "weather_state": (weather_state, with_("weather") + """, la AS (SELECT * FROM weather QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY t DESC) = 1), m AS (SELECT count(*) AS n, max(t) AS latest, avg(u) AS u, avg(v) AS v FROM la),
        w AS (SELECT *, CASE WHEN sqrt(u * u + v * v) > 1e-12 THEN ((degrees(atan2(u, v)) % 360) + 360) % 360 END AS toward FROM m)
        SELECT n, latest, round(u, 6) AS u, round(v, 6) AS v, round(sqrt(u * u + v * v), 6) AS speed, round(toward, 6) AS toward, round((toward + 180) % 360, 6) AS comes_from, CASE WHEN n >= 3 THEN 'GOOD' ELSE 'INSUFFICIENT_STATIONS' END AS quality FROM w"""),
    "step_changes": (step_changes, with_("obs") + """, x AS (SELECT station_id, t - lag(t) OVER w AS dt, value - lag(value) OVER w AS dv FROM obs WINDOW w AS (PARTITION BY station_id ORDER BY t, obs_id)),
        y AS (SELECT *, CASE WHEN dt > 0 AND dt <= 172800 THEN dv / (dt / 60) END AS rate FROM x) SELECT station_id, max(dt) AS longest_gap, count(*) FILTER (WHERE abs(dv) > 50) AS jumps, round(max(rate), 6) AS rise, round(min(rate), 6) AS fall FROM y GROUP BY 1"""),
    "isolated_spikes": (isolated_spikes, with_("obs", BINNED) + " SELECT a.station_id, a.bucket FROM binned a JOIN binned b ON b.station_id = a.station_id AND b.bucket = a.bucket - 21600 JOIN binned c ON c.station_id = a.station_id AND c.bucket = a.bucket + 21600 WHERE a.value > 60 AND b.value <= 60 AND c.value <= 60"),
    "bin_coverage": (bin_coverage, with_("obs") + ", s AS (SELECT max(t) // 21600 - min(t) // 21600 + 1 AS expected FROM obs) SELECT station_id, count(DISTINCT t // 21600) AS bins, round(least(100.0, 100.0 * count(DISTINCT t // 21600) / (SELECT expected FROM s)), 6) AS percent FROM obs GROUP BY 1"),
    "outside_intervals": (outside_intervals, with_("obs", "fire", BINNED) + " SELECT station_id, bucket FROM binned b WHERE NOT EXISTS (SELECT 1 FROM fire f WHERE b.bucket >= f.t AND b.bucket <= f.t + 21600)"),
    "month_selection": (month_selection, "SELECT event_type, count(*) AS n FROM events WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1"),
    "above_the_mean": (above_the_mean, "SELECT event_type, count(*) AS n FROM events JOIN (SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) USING (user_id) GROUP BY 1"),
    "emission_upsert": (emission_upsert, with_("obs") + """, e AS (SELECT e.user_id % 100 AS source, CASE WHEN event_id % 17 > 0 THEN CAST(floor(epoch(ts)) AS BIGINT) // 3600 END AS hour, value, event_id, event_id % 2 AS side FROM events e)
        SELECT source, hour, round(arg_max(value, (side, event_id)), 6) AS value FROM e WHERE hour IS NOT NULL GROUP BY 1, 2"""),
    "first_of_the_best": (first_of_the_best, with_("obs") + " SELECT station_id, obs_id, t, value FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY value DESC, t, obs_id) = 1"),
}
