"""Classes, margins and statuses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import M_PER_DEG_LAT, M_PER_DEG_LON


def station_bucket(n: Column) -> Column:
    return F.when(n.between(3, 4), "3–4").when(n.between(5, 6), "5–6").when(n.between(7, 8), "7–8").otherwise("other")


def speed_bucket(mps: Column) -> Column:
    return F.when(mps.isNull(), "unavailable").when(mps < 0.5, "<0.5").when(mps < 2, "0.5–2").when(mps <= 5, "2–5").otherwise(">5")


def fire_bucket(km: Column) -> Column:
    """The smallest of the known-fire radii that holds a distance."""
    out = F.when(km.isNull() | F.isnan(km), "unknown")
    for r in (0.5, 1.0, 2.0, 3.0, 5.0):
        out = out.when(km <= r, f"{r:g}km")
    return out.otherwise(">5km")


def margin(value: Column, threshold: float) -> Column:
    """struct(value, threshold, margin, pass) of a value against a least threshold; nothing passes without a value."""
    return F.struct(value.alias("value"), F.lit(float(threshold)).alias("threshold"), (value - threshold).alias("margin"), F.coalesce(value >= threshold, F.lit(False)).alias("pass"))


def relative_delta(delta: Column, base: Column) -> Column:
    """Percent of the base, which counts as one at least."""
    return 100 * delta / F.greatest(F.abs(base), F.lit(1.0))


def feed_freshness(age_s: Column) -> Column:
    """Freshness at ingest: readings from the future are clock drift up to five minutes, else suspicious."""
    return F.when(age_s.isNull(), "missing_observation").when(age_s < -300, "suspicious_future_timestamp").when(age_s < 0, "clock_ahead").when(age_s <= 600, "fresh").when(age_s <= 1800, "stale").otherwise("offline")


def inventory_status(freshness: Column, future: Column, observed: Column) -> Column:
    """Status of a station on a map: suspicious times first, then missing observations, then its freshness."""
    return F.when(F.coalesce(future, F.lit(False)) | F.coalesce(freshness == "future_timestamp", F.lit(False)), "suspicious/future").when(F.coalesce(freshness == "missing_observation", F.lit(False)) | observed.isNull(), "missing observation").otherwise(F.coalesce(F.when(freshness != "", freshness), F.lit("unknown")))


def compass(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Where a point lies from the middle of a box; up to a hundredth of a degree off is central."""
    dy, dx = lat - (south + north) / 2, lon - (west + east) / 2
    v = F.when(dy > 0.01, "north").when(dy < -0.01, "south")
    h = F.when(dx > 0.01, "east").when(dx < -0.01, "west")
    return F.coalesce(F.when(v.isNotNull() & h.isNotNull(), F.concat_ws("-", v, h)), v, h, F.lit("central"))


def hotspot_source(requested: Column, errors: Column, detections: Column) -> Column:
    """State of the hotspot feed from whether it was asked, its errors and what it found."""
    key = F.exists(errors, lambda e: F.lower(e).contains("missing") | F.lower(e).contains("not set"))
    return F.when(~requested & key, "NOT_QUERIED_MISSING_KEY").when(F.size(errors) > 0, "PARTIAL / UNAVAILABLE").when(F.coalesce(detections, F.lit(0)) == 0, "NO FIRMS HOTSPOT DETECTED").otherwise("QUERIED")


def emission_source(rows: Column, complete: Column) -> Column:
    return F.when(rows == 0, "CEMS_CONTEXT_UNAVAILABLE").when(F.coalesce(~complete, F.lit(False)), "PARTIAL / UNAVAILABLE").otherwise("AVAILABLE")


def cluster_name(t: Column, n: Column) -> Column:
    """A cluster's name from its bin's time (seconds) and its number within the bin."""
    return F.concat(F.date_format(F.timestamp_seconds(t), "yyyyMMdd'T'HHmmss'Z'"), F.lit("-c"), F.lpad(n.cast("string"), 2, "0"))


def incident_name(prefix: str, t: Column, n: Column) -> Column:
    """An incident's name from its time (seconds) and its number within the second."""
    return F.concat(F.lit(prefix + "_"), F.date_format(F.timestamp_seconds(t), "yyyyMMddHHmmss"), F.lit("_"), F.lpad(n.cast("string"), 3, "0"))


def local_metres(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north of an origin, in metres."""
    return (lon - lon0) * (M_PER_DEG_LON * F.cos(F.radians(F.lit(lat0)))), (lat - lat0) * M_PER_DEG_LAT


def from_local(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Latitude and longitude of metres east and north of an origin."""
    return lat0 + y / M_PER_DEG_LAT, lon0 + x / (M_PER_DEG_LON * F.cos(F.radians(F.lit(lat0))))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Of latitude and of longitude, by the usual series in the latitude."""
    p = F.radians(lat)
    return 111_132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p), 111_412.84 * F.cos(p) - 93.5 * F.cos(3 * p)


def query_key(lat: Column, lon: Column, t: Column, metres: float | None, lat0: float, lon0: float, seconds: int = 60) -> Column:
    """struct(a, b, t) under which a wind is kept: rounded degrees, or with ``metres`` the cell, and the time down to ``seconds``."""
    if metres is None:
        return F.struct(F.bround(lat, 6).alias("a"), F.bround(lon, 6).alias("b"), t.alias("t"))
    x, y = local_metres(lat, lon, lat0, lon0)
    return F.struct(F.floor(x / metres).cast("double").alias("a"), F.floor(y / metres).cast("double").alias("b"), (t - F.pmod(t, F.lit(seconds))).alias("t"))
