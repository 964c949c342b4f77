"""Queries of streams that are fed part by part: committed facts with their health rows, and windows that late rows correct."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from ..streaming import ingest
from ..streaming.commits import CommitLog
from . import views
from .views import with_

DAY, STEP, PARTS = 86_400, 21_600, 3
#: One in so many rows of the first part comes with the last one.
DELAYED = 50


def _fed(spark, d):
    """The observations with the part of the stream that each comes in: thirds of the time, some of the first third with the last."""
    o = views.obs(spark, d)
    span = o.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    part = F.least(F.floor((F.col("t") - span.low) * PARTS / F.lit((span.high or 0) - (span.low or 0) + 1)), F.lit(PARTS - 1))
    return o.withColumn("part", F.when((part == 0) & (F.col("obs_id") % DELAYED == 0), F.lit(PARTS - 1)).otherwise(part).cast("int"))


def _streams(spark, rows, path):
    """The stream of ``rows``, after each part has been written."""
    for k in range(PARTS):
        rows.where(F.col("part") == k).drop("part").write.parquet(f"{path}/in/{k}")
        yield spark.readStream.schema(rows.drop("part").schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def stream_corrected_windows(spark, d):
    """Six-hour windows of a stream, after the rows that came behind its watermark of a day have been merged into them."""
    path = shared_dir(spark)
    log = CommitLog(spark, f"{path}/log")
    for stream in _streams(spark, _fed(spark, d).select("station_id", "t", "value", "part"), path):
        ingest.bin_stream(stream, log, f"{path}/checkpoint", STEP, DAY).awaitTermination()
    return ingest.windows(log).select("station_id", "bucket", "n", F.round("mean", 6).alias("mean"), "high", "late_rows", "closed")


def _ingested(spark, d):
    path = shared_dir(spark)
    log = CommitLog(spark, f"{path}/log")
    for stream in _streams(spark, _fed(spark, d).select(F.pmod("station_id", F.lit(7)).alias("site"), F.floor(F.col("t") / 3600).alias("hour"), "obs_id", "part"), path):
        ingest.ingest(stream, log, f"{path}/checkpoint", ["site", "hour"]).awaitTermination()
    return log


def stream_facts(spark, d):
    """The first observation to come of each site and hour: a batch adds the keys that the table lacks, the smallest row of each."""
    return _ingested(spark, d).read("facts").select("site", "hour", "obs_id")


def stream_health(spark, d):
    """What each of the same stream's batches received and added, committed together with its rows."""
    return ingest.health(_ingested(spark, d)).select("batch_id", "received", "inserted", "duplicates")


_FED = f"""sp AS (SELECT min(t) AS low, max(t) AS high FROM obs), p0 AS (SELECT obs.*, least((t - low) * {PARTS} // (high - low + 1), {PARTS - 1}) AS third FROM obs, sp),
fed AS (SELECT *, CASE WHEN third = 0 AND obs_id % {DELAYED} = 0 THEN {PARTS - 1} ELSE third END AS part FROM p0)"""
_FACTS = """k AS (SELECT station_id % 7 AS site, t // 3600 AS hour, obs_id, part FROM fed), fa AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY site, hour ORDER BY part, obs_id) = 1)"""

QUERIES = {
    "stream_corrected_windows": (stream_corrected_windows, with_("obs", _FED) + f" SELECT station_id, t - t % {STEP} AS bucket, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high, count(*) FILTER (WHERE third = 0 AND part > 0) AS late_rows, t - t % {STEP} + {STEP} <= any_value(high) - {DAY} AS closed FROM fed, sp GROUP BY station_id, t - t % {STEP}".replace("any_value(high)", "(SELECT high FROM sp)").replace(" FROM fed, sp GROUP", " FROM fed GROUP")),
    "stream_facts": (stream_facts, with_("obs", _FED, _FACTS) + " SELECT site, hour, obs_id FROM fa"),
    "stream_health": (stream_health, with_("obs", _FED, _FACTS) + ", r AS (SELECT part, count(*) AS n FROM k GROUP BY 1), i AS (SELECT part, count(*) AS n FROM fa GROUP BY 1) SELECT CAST(r.part AS BIGINT) AS batch_id, r.n AS received, coalesce(i.n, 0) AS inserted, r.n - coalesce(i.n, 0) AS duplicates FROM r LEFT JOIN i USING (part)"),
}
