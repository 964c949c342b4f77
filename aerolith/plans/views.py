"""Sensor-network tables as deterministic views of the driver's tables, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with its time in whole seconds."""
    return table(spark, sf_dir, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))


def flags(k):
    return F.concat_ws(";", F.when(k % 29 == 0, "invalid_pm25"), F.when(k % 31 == 0, "future_timestamp_ahead_seconds=12.000"), F.when(k % 3 == 0, "clock_ahead"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.pmod("user_id", F.lit(48)).alias("station_id"), F.col("event_id").alias("obs_id"), "t", "value", "event_type", flags(F.col("event_id")).alias("quality_flags"))


def place(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.withColumns({"lat": 25.0 + F.pmod(k * 37, F.lit(121)) / 1000.0, "lon": 121.4 + F.pmod(k * 53, F.lit(121)) / 1000.0})


def stations(spark: SparkSession) -> DataFrame:
    return place(spark.range(48).withColumnRenamed("id", "station_id"), "station_id")


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_id, lat, lon): a monitor at each supplier, so that there are as many as the table has."""
    k = F.col("station_id")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("station_id"))
    return s.withColumns({"lat": 24.8 + F.pmod(k * 7919, F.lit(10_007)) / 16_000.0, "lon": 121.2 + F.pmod(k * 104_729, F.lit(10_009)) / 16_000.0})


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_id, t, u, v, calm) of 24 weather stations; one row per station and time."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("view", "click", "error"))
    calm = F.col("event_type") == "error"
    speed, direction = F.col("value") / 20, (F.col("event_id") * 47) % 360
    one = e.select(
        F.pmod("user_id", F.lit(24)).alias("station_id"),
        "t",
        "event_id",
        F.when(calm, 0.0).otherwise(-speed * F.sin(F.radians(direction.cast("double")))).alias("u"),
        F.when(calm, 0.0).otherwise(-speed * F.cos(F.radians(direction.cast("double")))).alias("v"),
        calm.alias("calm"),
    )
    return one.groupBy("station_id", "t").agg(*[F.min_by(c, "event_id").alias(c) for c in ("u", "v", "calm")])


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("facility_id"), F.col("c_mktsegment").alias("industry"))
    return place(c, "facility_id")


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'error' and value > 60")
    return place(e.select(F.col("event_id").alias("fire_id"), "t", F.col("value").alias("frp"), F.pmod(F.col("event_id"), F.lit(97)).alias("k")), "k")


#: Common table expressions with the same content in SQL.
SQL = {
    "obs": """obs AS (SELECT user_id % 48 AS station_id, event_id AS obs_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, value, event_type,
        concat_ws(';', CASE WHEN event_id % 29 = 0 THEN 'invalid_pm25' END, CASE WHEN event_id % 31 = 0 THEN 'future_timestamp_ahead_seconds=12.000' END, CASE WHEN event_id % 3 = 0 THEN 'clock_ahead' END) AS quality_flags FROM events)""",
    "station": "station AS (SELECT s AS station_id, 25.0::DOUBLE + ((s * 37) % 121) / 1000.0::DOUBLE AS lat, 121.4::DOUBLE + ((s * 53) % 121) / 1000.0::DOUBLE AS lon FROM range(48) r(s))",
    "monitor": "monitor AS (SELECT s_suppkey AS station_id, 24.8::DOUBLE + ((s_suppkey * 7919) % 10007) / 16000.0::DOUBLE AS lat, 121.2::DOUBLE + ((s_suppkey * 104729) % 10009) / 16000.0::DOUBLE AS lon FROM supplier)",
    "weather": """weather AS (SELECT station_id, t, arg_min(u, event_id) AS u, arg_min(v, event_id) AS v, arg_min(calm, event_id) AS calm FROM (
        SELECT user_id % 24 AS station_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id, event_type = 'error' AS calm,
               CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE -(value / 20) * sin(radians(((event_id * 47) % 360)::DOUBLE)) END AS u,
               CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE -(value / 20) * cos(radians(((event_id * 47) % 360)::DOUBLE)) END AS v
        FROM events WHERE event_type IN ('view', 'click', 'error')) GROUP BY station_id, t)""",
    "wstation": "wstation AS (SELECT s AS station_id, 25.0::DOUBLE + ((s * 37) % 121) / 1000.0::DOUBLE AS lat, 121.4::DOUBLE + ((s * 53) % 121) / 1000.0::DOUBLE AS lon FROM range(24) r(s))",
    "facility": "facility AS (SELECT c_custkey AS facility_id, c_mktsegment AS industry, 25.0::DOUBLE + ((c_custkey * 37) % 121) / 1000.0::DOUBLE AS lat, 121.4::DOUBLE + ((c_custkey * 53) % 121) / 1000.0::DOUBLE AS lon FROM customer)",
    "fire": "fire AS (SELECT event_id AS fire_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, value AS frp, 25.0::DOUBLE + (((event_id % 97) * 37) % 121) / 1000.0::DOUBLE AS lat, 121.4::DOUBLE + (((event_id % 97) * 53) % 121) / 1000.0::DOUBLE AS lon FROM events WHERE event_type = 'error' AND value > 60)",
}


def hav(a: str, b: str) -> str:
    """SQL of the distance in km between rows a and b with lat and lon."""
    return f"(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"


BINNED = """binned AS (SELECT *, t - t % 21600 AS bucket FROM obs WHERE value >= 0 AND value < 'inf'::DOUBLE AND NOT contains(quality_flags, 'invalid_pm25') AND NOT contains(quality_flags, 'future_timestamp') QUALIFY row_number() OVER (PARTITION BY station_id, t - t % 21600 ORDER BY t DESC, obs_id) = 1),
smoothed AS (SELECT *, avg(value) OVER (PARTITION BY station_id ORDER BY bucket RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS smoothed FROM binned),
hist AS (SELECT *, list(smoothed) OVER (PARTITION BY station_id ORDER BY bucket RANGE BETWEEN 432000 PRECEDING AND 1 PRECEDING) AS h FROM smoothed),
tb0 AS (SELECT *, coalesce(len(h), 0) AS history_count, list_median(h) AS t_median FROM hist),
tb1 AS (SELECT *, list_median(list_transform(h, lambda x: abs(x - t_median))) AS t_mad FROM tb0),
tb AS (SELECT *, smoothed - t_median AS temporal_excess, (smoothed - t_median) / greatest(1.4826 * t_mad, 1.5) AS z_t,
       CASE WHEN history_count >= 10 THEN 'sufficient' ELSE 'insufficient_history' END AS temporal_status FROM tb1)"""

ANOMALY = f"""pair AS (SELECT * FROM (SELECT a.station_id AS a, b.station_id AS b, {hav("a", "b")} AS d FROM station a, station b WHERE a.station_id <> b.station_id) WHERE d <= 4.5),
nb AS (SELECT x.station_id, x.bucket, p.d, o.smoothed AS v, coalesce(o.history_count >= 10 AND o.temporal_excess >= 5 AND o.z_t >= 3, false) AS pass
       FROM tb x JOIN pair p ON p.a = x.station_id JOIN tb o ON o.station_id = p.b AND o.bucket = x.bucket),
li AS (SELECT station_id, bucket, coalesce(list(v) FILTER (WHERE d <= 3.0), []) AS v1, list(v) AS v2, count(*) FILTER (WHERE d <= 3.0 AND pass) AS s1, count(*) FILTER (WHERE pass) AS s2 FROM nb GROUP BY 1, 2),
an0 AS (SELECT tb.*, coalesce(len(v1), 0) < 3 AS few, CASE WHEN coalesce(len(v1), 0) < 3 THEN coalesce(v2, []) ELSE v1 END AS vs,
        CASE WHEN coalesce(len(v1), 0) < 3 THEN coalesce(s2, 0) ELSE s1 END AS support_count FROM tb LEFT JOIN li USING (station_id, bucket)),
an1 AS (SELECT *, len(vs) AS neighbor_count, CASE WHEN few THEN 4.5::DOUBLE ELSE 3.0::DOUBLE END AS radius_km, list_median(vs) AS s_median FROM an0),
an2 AS (SELECT *, list_median(list_transform(vs, lambda x: abs(x - s_median))) AS s_mad, smoothed - s_median AS spatial_excess,
        CASE WHEN neighbor_count >= 3 THEN 'sufficient' ELSE 'insufficient_neighbors' END AS spatial_status,
        CASE WHEN neighbor_count > 0 THEN support_count / neighbor_count ELSE 0.0 END AS support_fraction FROM an1),
an3 AS (SELECT *, spatial_excess / greatest(1.4826 * s_mad, 1.5) AS z_s FROM an2),
an AS (SELECT *, CASE WHEN z_t IS NOT NULL AND z_s IS NOT NULL THEN round(least(10.0, 0.4 * greatest(0, least(10, z_t)) + 0.4 * greatest(0, least(10, z_s)) * greatest(0.25, least(1, support_fraction))
                   + 0.2 * least(greatest(abs(temporal_excess), abs(spatial_excess)) / 5, 10.0)), 6) END AS anomaly_score,
       coalesce(temporal_status = 'sufficient' AND spatial_status = 'sufficient' AND temporal_excess >= 5 AND z_t >= 3 AND spatial_excess >= 5 AND z_s >= 3 AND support_count >= 1, false) AS is_candidate,
       coalesce(temporal_status = 'sufficient' AND temporal_excess >= 5 AND z_t >= 3 AND NOT coalesce(spatial_excess >= 5 AND z_s >= 3, false), false) AS is_isolated FROM an3)"""


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL.get(n, n) for n in names)
