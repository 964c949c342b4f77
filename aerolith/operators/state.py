"""Views of the current state, and the merges that keep tables up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(obs: DataFrame, key: str, cutoff: int | None = None) -> DataFrame:
    """The last observation per key (at or before ``cutoff``): an aggregate with partial results, not a sort."""
    seen = obs if cutoff is None else obs.where(F.col("t") <= cutoff)
    rest = [c for c in seen.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct("t", (-F.col("obs_id")).alias("o")))
    return seen.groupBy(key).agg(best.alias("m")).select(key, "m.*")


def freshness(age_s, fresh: int = 600, stale: int = 1800):
    return F.when(age_s.isNull(), "offline").when(age_s < -60, "future_timestamp").when(age_s <= fresh, "fresh").when(age_s <= stale, "stale").otherwise("offline")


def upsert_dimension(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Newest attributes per key, with the earliest first_seen and the latest last_seen of both tables."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (key, "first_seen", "last_seen")]
    out = both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by(F.struct(*rest), F.struct("last_seen", *rest)).alias("m"))
    return out.select(key, "m.*", "first_seen", "last_seen")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` lacks, each key once (the smallest row)."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("m")).select(*keys, "m.*")
    return once.join(old.select(*keys), keys, "left_anti")


def counts_within(points: DataFrame, radii: list[float]) -> DataFrame:
    """Cumulative counts of rows (with distance_km) per key ``a``."""
    return points.groupBy("a").agg(*[F.count_if(F.col("distance_km") <= r).alias(f"within_{r:g}km") for r in radii])


def upsert_newest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both tables, one a key: those of ``new`` replace those of ``old``, and within a table the largest ``order`` counts. Rows with a null key are dropped."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1))).dropna(subset=keys)
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_side", order)).alias("m")).select(*keys, "m.*")


def regional_outliers(values: DataFrame, by: str, value: str) -> DataFrame:
    """Rows of ``values`` outside the Tukey fences (1.5 interquartile ranges) of all rows with the same ``by``; groups of under four have none."""
    q = lambda p: F.percentile(value, F.lit(p))
    fences = values.groupBy(by).agg(q(0.25).alias("q1"), q(0.75).alias("q3"), F.count(value).alias("n")).where("n >= 4")
    out = values.join(fences, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    side = F.when(F.col(value) > F.col("q3") + reach, "high").when(F.col(value) < F.col("q1") - reach, "low")
    return out.withColumn("side", side).where("side is not null").drop("q1", "q3", "n")


def window_of(rows: DataFrame, t: str, start: int | None = None, end: int | None = None, latest_hours: int | None = None) -> DataFrame:
    """Rows of an explicit window (replay), or of the last hours before the table's latest time (live); both bounds belong to it."""
    if start is not None and end is not None:
        if end < start:
            raise ValueError("end is before start")
        return rows.where(F.col(t).between(start, end))
    if not latest_hours or latest_hours < 0:
        raise ValueError("give start and end, or how many hours before the latest row")
    last = rows.agg(F.max(t).alias("_last"))
    return rows.join(F.broadcast(last), F.col(t) >= F.col("_last") - latest_hours * 3600).drop("_last")
