"""Robust statistics: exact medians and deviations of columns and of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_median(a: Column) -> Column:
    """Mean of the middle two, null for none."""
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def array_mad(a: Column, center: Column) -> Column:
    return array_median(F.transform(a, lambda x: F.abs(x - center)))


def pearson(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null where either column doesn't vary (``corr`` is an error there)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def sigma(mad: Column, floor: float = 1.5) -> Column:
    return F.greatest(1.4826 * mad, F.lit(floor))


def stats_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, median, MAD, sigma, quartiles, p90 and Tukey's high outliers of each group: two shuffles on the keys. Exact percentiles keep a group's different values, so a key of very many should be rounded first."""
    q = df.groupBy(*keys).agg(F.count(value).alias("n"), *[F.percentile(value, F.lit(p)).alias(name) for p, name in ((0.5, "median"), (0.25, "q1"), (0.75, "q3"), (0.9, "p90"))])
    joined = df.join(q, keys)
    more = joined.groupBy(*keys).agg(
        F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"),
        F.count_if(F.col(value) > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"),
    )
    out = q.join(more, keys).withColumn("sigma", sigma(F.col("mad")))
    return out.withColumn("outliers", F.when(F.col("n") >= 4, F.col("high")).otherwise(0))
