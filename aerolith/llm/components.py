"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its larger neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any orderable type -> (node, root), root being the smallest node reachable.

    Only nodes with an edge to another node are returned; self-loops and rows with a
    null end are ignored, an empty table gives an empty table. Rounds grow with the
    logarithm of a component's size. Each round is written to the shared folder;
    only a count and a checksum of the edges reach the driver. Star centres with
    very many leaves are summed before the shuffle, and the joins on them are ordinary joins, which adaptive execution splits where a key is hot.
    """
    now = materialise(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        after = materialise(_small_star(_large_star(now)))
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
