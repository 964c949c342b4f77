"""Connected components of edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; where that is unset, one of this machine, which only a local master can share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/aerolith-checkpoints"
    return f"{base.rstrip('/')}/aerolith-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the cluster's shared folder and reads them from there, once computed; a folder of this machine only where none is set, as in local tests.

    What comes back is a plain table: a checkpoint would keep the constraints of its plan, and those of iterated joins grow by themselves in the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) and undirected (u, v) -> (id, root), the smallest id reachable. Nodes without edges are their own root.

    Each round every node that isn't the smallest of its neighbourhood, by a hash that differs each round, goes into the smallest neighbour, and that one's into its own; what is left is a smaller graph.
    Hashed orders have short descending chains, so a fixed share of the nodes goes each round, however long and winding a component is. Only whether links are left reaches the driver.
    """
    links = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels, k = cut(nodes.select("id", F.col("id").alias("root")).distinct()), 0
    while links.limit(1).count():
        k += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        into = cut(links.groupBy("u").agg(F.min(order("v")).alias("m")).where(F.col("m") < order("u")).select("u", F.col("m.to").alias("to")))
        for _ in range(2):
            into = into.join(into.select(F.col("u").alias("to"), F.col("to").alias("next")), "to", "left").select("u", F.coalesce("next", "to").alias("to"))
        into = cut(into)
        there = lambda df, c: df.join(into.select(F.col("u").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        labels, links = cut(there(labels, "root").select("id", "root")), cut(there(there(links, "u"), "v").select("u", "v").where("u <> v").distinct())
    least = labels.groupBy("root").agg(F.min("id").alias("least"))
    return cut(labels.join(least, "root").select("id", F.col("least").alias("root")))
