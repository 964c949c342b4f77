"""Backward traces from receptors, the evidence surface they leave, and its regions."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TraceConfig
from ..functions.geo import M_PER_DEG_LAT, M_PER_DEG_LON, cell, haversine_km
from ..functions.robust import pearson
from .graph import components


def receptors(members: DataFrame) -> DataFrame:
    """One row per station: its first seed, else its first support; with role weight and normalised weight."""
    first = Window.partitionBy("station_id").orderBy(F.col("role") != "seed", "bucket")
    one = members.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    weight = F.when(F.col("role") == "seed", 1.0).otherwise(0.75) * (0.75 + 0.25 * F.least(F.col("anomaly_score") / 10, F.lit(1.0)))
    total = one.select(weight.alias("w")).agg(F.sum("w").alias("total"))
    return one.withColumn("weight", weight).join(F.broadcast(total)).withColumn("normalized_weight", F.col("weight") / F.col("total")).drop("total")


def project(df: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Adds x and y, metres east and north of an origin."""
    k = M_PER_DEG_LON * float(np.cos(np.radians(lat0)))
    return df.withColumns({"x": (F.col("lon") - lon0) * k, "y": (F.col("lat") - lat0) * M_PER_DEG_LAT})


#: Steps that one task makes: a file of receptors is small, their steps are not.
STEPS_A_TASK = 1_000_000


def uniform_steps(points: DataFrame, u: float, v: float, cfg: TraceConfig) -> DataFrame:
    """(receptor, step, x, y) of one particle per receptor in a constant wind, without residuals: a closed form, no loop. Receptors are counted, and dealt to as many tasks as their steps need."""
    steps = cfg.minutes * 60 // cfg.dt_seconds
    tasks = ceil(points.count() * steps / STEPS_A_TASK)
    points = points.repartition(tasks, "station_id") if tasks > 1 else points
    out = points.select(F.col("station_id").alias("receptor"), "x", "y", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return out.withColumns({"x": F.col("x") - u * cfg.dt_seconds * F.col("step"), "y": F.col("y") - v * cfg.dt_seconds * F.col("step")})


def deposit(steps: DataFrame, cfg: TraceConfig) -> DataFrame:
    return steps.groupBy("receptor", cell("x", cfg.cell_m).alias("ci"), cell("y", cfg.cell_m).alias("cj")).agg(F.count(F.lit(1)).alias("hits"))


def evidence_grid(hits: DataFrame, per_receptor: int, n_receptors: DataFrame) -> DataFrame:
    """(ci, cj, density, support_count, support_fraction, score) of cells; ``n_receptors`` is one row with ``n``.

    Score = density over its maximum times (1/4 + 3/4 support), over the maximum of that; both maxima are one-row aggregates.
    """
    grid = hits.groupBy("ci", "cj").agg((F.sum("hits") / per_receptor).alias("density"), F.countDistinct("receptor").alias("support_count"))
    top = grid.agg(F.max("density").alias("top"))
    out = grid.join(F.broadcast(top)).join(F.broadcast(n_receptors)).withColumn("support_fraction", F.col("support_count") / F.col("n"))
    out = out.withColumn("raw", F.col("density") / F.col("top") * (0.25 + 0.75 * F.col("support_fraction")))
    return out.join(F.broadcast(out.agg(F.max("raw").alias("most")))).withColumn("score", F.col("raw") / F.col("most")).drop("top", "n", "raw", "most")


def region_cells(grid: DataFrame, share: float = 0.6) -> DataFrame:
    """The cells that reach a share of the peak, with ``root``: the first cell of the region of touching cells (eight neighbours) that each belongs to."""
    high = grid.join(F.broadcast(grid.agg(F.max("score").alias("_top"))), F.col("score") >= share * F.col("_top")).drop("_top")
    key = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    around = F.explode(F.array(*[F.struct((F.col("ci") + a).cast("int").alias("i"), (F.col("cj") + b).cast("int").alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    ids = high.select(key("ci", "cj").alias("id"))
    edges = high.select(key("ci", "cj").alias("u"), around.alias("v")).join(ids.select(F.col("id").alias("v")), "v", "left_semi")
    return high.withColumn("id", key("ci", "cj")).join(components(ids, edges), "id").drop("id")


def ranked(cells: DataFrame, limit: int = 5, cell_m: float = 250.0) -> DataFrame:
    """The strongest regions of ``region_cells``."""
    out = cells.groupBy("root").agg(
        F.count(F.lit(1)).alias("cells"),
        F.max("score").alias("peak"),
        F.sum("score").alias("total"),
        (F.sum(F.col("score") * (F.col("ci") + 0.5) * cell_m) / F.sum("score")).alias("x"),
        (F.sum(F.col("score") * (F.col("cj") + 0.5) * cell_m) / F.sum("score")).alias("y"),
    )
    w = Window.orderBy(F.desc(F.round("peak", 9)), F.desc(F.round("total", 9)), "root")
    return out.orderBy(F.desc(F.round("peak", 9)), F.desc(F.round("total", 9)), "root").limit(limit).withColumn("rank", F.row_number().over(w)).select("rank", F.col("root.i").alias("ci"), F.col("root.j").alias("cj"), "cells", "peak", "total", "x", "y", (F.col("cells") * cell_m * cell_m / 1e6).alias("area_km2"))


def regions(grid: DataFrame, share: float = 0.6, limit: int = 5, cell_m: float = 250.0) -> DataFrame:
    """The strongest regions of touching cells (eight neighbours) that reach a share of the peak."""
    return ranked(region_cells(grid, share), limit, cell_m)


def match_regions(a: DataFrame, b: DataFrame, limit: int = 5, cell_m: float = 250.0) -> DataFrame:
    """(rank_a, rank_b, overlap, km): which of the strongest regions of two surfaces are the same, from their ``region_cells``.

    Pairs are taken one after the other, by most common cells and then by distance of their centroids, each region once. There are ``limit`` times ``limit`` pairs at most, so one row holds them.
    """
    sides = []
    for cells, tag in ((a, "a"), (b, "b")):
        top = ranked(cells, limit, cell_m).select(F.struct(F.col("ci").alias("i"), F.col("cj").alias("j")).alias("root"), F.col("rank").alias(f"rank_{tag}"), F.col("x").alias(f"x_{tag}"), F.col("y").alias(f"y_{tag}"))
        sides.append((top, cells.select("ci", "cj", "root").join(top.select("root", f"rank_{tag}"), "root").select("ci", "cj", f"rank_{tag}")))
    common = sides[0][1].join(sides[1][1], ["ci", "cj"]).groupBy("rank_a", "rank_b").agg(F.count(F.lit(1)).alias("overlap"))
    both = sides[0][0].drop("root").join(F.broadcast(sides[1][0].drop("root")), F.col("rank_a") + F.col("rank_b") > 0).join(common, ["rank_a", "rank_b"], "left")  # at most limit x limit pairs
    km = F.round(F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")) / 1000, 9)
    pair = F.struct((-F.coalesce("overlap", F.lit(0))).alias("o"), km.alias("km"), "rank_a", "rank_b")
    one = both.agg(F.array_sort(F.collect_list(pair)).alias("p"))
    free = lambda kept, x: ~F.exists(kept, lambda y: (y["rank_a"] == x["rank_a"]) | (y["rank_b"] == x["rank_b"]))
    empty = F.array().cast("array<struct<o:bigint,km:double,rank_a:int,rank_b:int>>")
    taken = F.aggregate("p", empty, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return one.select(F.explode(taken).alias("m")).select("m.rank_a", "m.rank_b", (-F.col("m.o")).alias("overlap"), "m.km")


def compare(a: DataFrame, b: DataFrame, lat0: float, lon0: float, cell_m: float = 250.0, close_km: float = 0.5, alike: float = 0.95) -> DataFrame:
    """One row on two surfaces: correlation over the union of cells (missing ones are zero), whether the peaks are in the same cell, both areas, how far the top region's centroid has moved, and
    whether it stayed ``close`` and the surfaces are ``alike``. A surface without cells has no peak and no region.
    """
    both = a.select("ci", "cj", F.col("score").alias("a")).join(b.select("ci", "cj", F.col("score").alias("b")), ["ci", "cj"], "full_outer").withColumns({"a0": F.coalesce("a", F.lit(0.0)), "b0": F.coalesce("b", F.lit(0.0))})
    at = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.round(c, 9).alias("s"), (-F.col("ci")).alias("i"), (-F.col("cj")).alias("j"))))
    area = lambda c: (F.count(c) * cell_m * cell_m / 1e6).alias(f"area_{c}")
    out = both.agg(F.count(F.lit(1)).alias("cells"), pearson("a0", "b0").alias("correlation"), at("a").alias("p"), at("b").alias("q"), area("a"), area("b"))
    k = M_PER_DEG_LON * float(np.cos(np.radians(lat0)))
    top = lambda g, t: regions(g, cell_m=cell_m).where("rank = 1").select((lat0 + F.col("y") / M_PER_DEG_LAT).alias(f"lat_{t}"), (lon0 + F.col("x") / k).alias(f"lon_{t}"))
    moved = out.join(F.broadcast(top(a, "a")), how="left").join(F.broadcast(top(b, "b")), how="left").withColumn("shift_km", haversine_km("lat_a", "lon_a", "lat_b", "lon_b"))
    same = F.coalesce((F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j")), F.lit(False))
    return moved.select("cells", "correlation", same.alias("same_peak"), "area_a", "area_b", "shift_km", F.coalesce(F.col("shift_km") < close_km, F.lit(False)).alias("close"), F.coalesce(F.col("correlation") >= alike, F.lit(False)).alias("alike"))
