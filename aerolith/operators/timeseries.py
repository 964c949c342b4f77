"""Binning, smoothing and trailing robust baselines of irregular station series.

Frames are ranges of seconds over a bigint column, so a gap in a series is a gap in its frame. All windows
are partitioned by station; per-row lists hold one baseline's bins at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AnomalyConfig
from ..functions.robust import array_mad, array_median, sigma
from ..functions.text import has_bad_time, tokens, valid_pm25


def usable(obs: DataFrame) -> DataFrame:
    """Observations with a finite value of zero or more whose flags (``quality_flags``, where there is such a column) name neither an invalid value nor a bad time."""
    tok = tokens(F.col("quality_flags")) if "quality_flags" in obs.columns else F.array().cast("array<string>")
    return obs.where(valid_pm25(F.col("value"), tok) & ~has_bad_time(tok))


def bin_last(obs: DataFrame, seconds: int) -> DataFrame:
    """(station_id, t, value, ...) -> one row per station and bin, the latest usable observation; ties go to the smallest obs_id.

    An aggregate with partial results, not a sort. Rows without station or time make no bin; an empty table gives an empty table.
    """
    binned = usable(obs).where("station_id is not null and t is not null").withColumn("bucket", F.col("t") - F.pmod(F.col("t"), F.lit(seconds)))
    rest = [c for c in binned.columns if c not in ("station_id", "bucket")]
    last = F.max_by(F.struct(*rest), F.struct("t", (-F.col("obs_id")).alias("first")))
    return binned.groupBy("station_id", "bucket").agg(last.alias("last")).select("station_id", "bucket", "last.*")


def smooth(bins: DataFrame, seconds: int) -> DataFrame:
    """Adds ``smoothed``: the median of the bin and the one right before it."""
    w = Window.partitionBy("station_id").orderBy("bucket").rangeBetween(-seconds, 0)
    return bins.withColumn("smoothed", F.avg("value").over(w))


def temporal_baseline(bins: DataFrame, cfg: AnomalyConfig) -> DataFrame:
    """Adds history_count, t_median, t_mad, temporal_excess, z_t and temporal_status from the trailing baseline, the own bin left out."""
    w = Window.partitionBy("station_id").orderBy("bucket").rangeBetween(-cfg.baseline_seconds, -1)
    out = bins.withColumn("_h", F.collect_list("smoothed").over(w)).withColumn("history_count", F.size("_h").cast("long"))
    out = out.withColumn("t_median", array_median(F.col("_h")))
    out = out.withColumn("t_mad", array_mad(F.col("_h"), F.col("t_median"))).drop("_h")
    out = out.withColumn("temporal_excess", F.col("smoothed") - F.col("t_median"))
    out = out.withColumn("z_t", F.col("temporal_excess") / sigma(F.col("t_mad"), cfg.sigma_floor))
    return out.withColumn("temporal_status", F.when(F.col("history_count") >= cfg.min_history, "sufficient").otherwise("insufficient_history"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, columns: list[str], tolerance: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time (within ``tolerance`` seconds), null if there is none.

    Union and a running last value: one shuffle on the keys, no pairs. Of right rows with the same time the
    last by value counts.
    """
    a = left.select(*keys, F.col(left_t).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(right_t, *columns)).schema[0].dataType).alias("_r"))
    b = right.select(*keys, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(right_t, *columns).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    last = a.unionByName(b).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if tolerance is not None:
        last = last.withColumn("_m", F.when(F.col("_t") - F.col(f"_m.{right_t}") <= tolerance, F.col("_m")))
    return last.select("_l.*", F.col(f"_m.{right_t}").alias(f"matched_{right_t}"), *[F.col(f"_m.{c}").alias(f"matched_{c}") for c in columns])


def islands(rows: DataFrame, key: str, t: str, flag: str, step: int) -> DataFrame:
    """(key, island, start, n): runs of flagged rows that follow each other by exactly ``step`` seconds."""
    w = Window.partitionBy(key).orderBy(t)
    new = F.when((F.lag(F.col(flag)).over(w)) & (F.col(t) - F.lag(t).over(w) == step), 0).otherwise(1)
    marked = rows.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("island", F.sum("_new").over(w))
    return marked.where(F.col(flag)).groupBy(key, "island").agg(F.min(t).alias("start"), F.count(F.lit(1)).alias("n"))
