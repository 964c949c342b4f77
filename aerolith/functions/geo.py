"""Geometry as Column expressions: distances, bearings, wind vectors, local metres and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
M_PER_DEG_LAT, M_PER_DEG_LON = 110_540.0, 111_320.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    # least() passes over nulls, but a distance from nowhere is null
    return 2 * EARTH_KM * F.asin(F.when(h.isNotNull(), F.least(F.lit(1.0), F.sqrt(h))))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = map(_c, (lat1, lon1, lat2, lon2))
    y = F.sin(F.radians(d - b)) * F.cos(F.radians(c))
    x = F.cos(F.radians(a)) * F.sin(F.radians(c)) - F.sin(F.radians(a)) * F.cos(F.radians(c)) * F.cos(F.radians(d - b))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angle_between(a, b) -> Column:
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def wind_uv(speed, from_deg) -> tuple[Column, Column]:
    """East and north components of a wind that comes from a direction."""
    return -_c(speed) * F.sin(F.radians(_c(from_deg))), -_c(speed) * F.cos(F.radians(_c(from_deg)))


def toward_deg(u, v) -> Column:
    """Where the wind blows to; null for still air."""
    return F.when(F.hypot(_c(u), _c(v)) > 1e-12, F.pmod(F.degrees(F.atan2(_c(u), _c(v))), F.lit(360.0)))


def from_deg(u, v) -> Column:
    """Where the wind comes from; null for still air."""
    return F.pmod(toward_deg(u, v) + 180.0, F.lit(360.0))


def in_bbox(lat, lon, south, west, north, east) -> Column:
    return F.coalesce(_c(lat).between(south, north) & _c(lon).between(west, east), F.lit(False))


def cell(metres, size: float) -> Column:
    return F.floor(_c(metres) / size).cast("int")


def finite(x) -> Column:
    return F.coalesce(_c(x).isNotNull() & ~F.isnan(_c(x)) & (F.abs(_c(x)) < float("inf")), F.lit(False))


def clip(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))
