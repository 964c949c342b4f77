"""Batch sources: Parquet, ORC, CSV and JSON with fixed schemas, and nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse

OBSERVATION = "station_id string, datastream_id string, phenomenon_time_utc timestamp, pm25_ugm3 double, ingested_at_utc timestamp, source_status string, quality_flags string"
STATION = "thing_id string, station_id string, station_name string, lat double, lon double, city string, township string, area_type string"
FIRE = "latitude double, longitude double, acq_date string, acq_time string, satellite string, instrument string, confidence string, frp double, daynight string"


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """One reader for all formats; CSV has a header, JSON a document per line or file, gzip is read as is."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.csv(path, header=True) if kind == "csv" else r.json(path, multiLine=kind == "json_document") if kind.startswith("json") else r.format(kind).load(path)


def time_range(df: DataFrame, column: str, start, end, closed: bool = True) -> DataFrame:
    """Rows from start to end; without ``closed`` the end is left out. Both bounds reach the scan."""
    c = F.col(column)
    return df.where((c >= start) & (c <= end if closed else c < end))


def fires(raw: DataFrame) -> DataFrame:
    """Parsed hotspot rows: time from date and HHMM, confidence from words or percent, default one half."""
    at = F.try_to_timestamp(F.concat_ws(" ", "acq_date", F.lpad(F.split("acq_time", r"\.")[0], 4, "0")), F.lit("yyyy-MM-dd HHmm"))
    text = F.lower(F.trim("confidence"))
    percent = text.try_cast("double")
    share = F.when(text.isin("h", "high"), 1.0).when(text.isin("n", "nominal"), 0.6).when(text.isin("l", "low"), 0.3).when(percent.isNull(), 0.5).otherwise(F.least(F.greatest(percent / 100, F.lit(0.0)), F.lit(1.0)))
    return raw.withColumns({"acquired_at": at, "confidence_share": share})


def weather(raw: DataFrame, column: str = "value") -> DataFrame:
    """Weather stations' observations out of nested JSON documents: one row per station with place, time, wind and flags."""
    coordinate = "array<struct<CoordinateName:string,StationLatitude:string,StationLongitude:string>>"
    shape = f"records struct<Station:array<struct<StationId:string,StationName:string,ObsTime:struct<DateTime:string>,GeoInfo:struct<Coordinates:{coordinate}>,WeatherElement:struct<WindDirection:string,WindSpeed:string>>>>"
    s = raw.select(F.explode(F.from_json(column, shape)["records"]["Station"]).alias("s"))
    named = F.filter("s.GeoInfo.Coordinates", lambda c: F.lower(F.trim(c["CoordinateName"])) == "wgs84")
    place = parse.coordinates(F.get(named, F.lit(0))["StationLatitude"], F.get(named, F.lit(0))["StationLongitude"])
    out = s.select(F.col("s.StationId").alias("station_id"), F.col("s.StationName").alias("station_name"), place.alias("p"), parse.utc_seconds(F.col("s.ObsTime.DateTime")).alias("t"), parse.wind(F.col("s.WeatherElement.WindDirection"), F.col("s.WeatherElement.WindSpeed")).alias("w"))
    flags = F.concat(F.when(F.col("p").isNull(), F.array(F.lit("invalid_wgs84_coordinate"))).otherwise(F.array()), F.when(F.col("t").isNull(), F.array(F.lit("invalid_observation_timestamp"))).otherwise(F.array()), F.col("w.flags"))
    return out.select("station_id", "station_name", "p.lat", "p.lon", "t", F.col("w.status").alias("wind_status"), "w.u", "w.v", F.array_join(flags, ";").alias("quality_flags"))


def things(raw: DataFrame, column: str = "value") -> DataFrame:
    """Stations out of nested JSON documents: one row per thing, its first location and its datastream."""
    shape = "`@iot.id` string, name string, properties map<string,string>, Locations array<struct<location:string>>, Datastreams array<struct<`@iot.id`:string,name:string>>"
    t = F.from_json(column, shape)
    at = parse.point(F.get(t["Locations"], F.lit(0))["location"])
    one = raw.select(t["@iot.id"].alias("thing_id"), t["name"].alias("station_name"), at.alias("p"), t["Datastreams"].alias("d"))
    each = one.select("thing_id", "station_name", "p", F.explode_outer("d").alias("d"))
    return each.select("thing_id", "station_name", "p.lat", "p.lon", F.col("d.`@iot.id`").alias("datastream_id"), F.col("d.name").alias("datastream"))
