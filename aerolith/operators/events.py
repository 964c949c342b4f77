"""Clusters of anomalous sensors in each bin, and events that live on through bins."""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, ceil, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EventConfig
from ..functions.geo import EARTH_KM, bearing_deg, finite, haversine_km
from .graph import components, cut
from .spatial import distance_join, neighbor_pairs


def roles(rows: DataFrame, cfg: EventConfig) -> DataFrame:
    """Usable rows that are seeds (candidates) or support (score and both excesses high enough)."""
    usable = (F.col("temporal_status") == "sufficient") & (F.col("spatial_status") == "sufficient") & finite("anomaly_score")
    for c in ("lat", "lon"):
        usable = usable & finite(c) if c in rows.columns else usable
    if "flags" in rows.columns:
        usable = usable & ~F.coalesce(F.col("flags").contains("stale_current_observation"), F.lit(False))
    support = (F.col("anomaly_score") >= cfg.support_score) & (F.col("temporal_excess") >= cfg.support_excess) & (F.col("spatial_excess") >= cfg.support_excess)
    return rows.where(usable).withColumn("role", F.when(F.col("is_candidate"), "seed").when(support, "support")).where("role is not null")


def clusters(members: DataFrame, stations: DataFrame, cfg: EventConfig) -> DataFrame:
    """Adds ``cluster_station`` to members: the smallest station of its density cluster in the bin.

    With two points as the least density every point with a neighbour is a core point, so clusters are the
    connected components of neighbours within eps. Lone support points are dropped, lone seeds stay.
    """
    key = lambda s: F.struct(F.col("bucket").alias("bucket"), F.col(s).alias("station_id"))
    members = cut(members)  # read three times below
    pairs = neighbor_pairs(stations, cfg.eps_km)
    a, b = members.select("bucket", F.col("station_id").alias("a")), members.select("bucket", F.col("station_id").alias("b"))
    edges = a.join(pairs.where("a < b"), "a").join(b, ["bucket", "b"]).select(key("a").alias("u"), key("b").alias("v"))
    roots = components(members.select(key("station_id").alias("id")), edges)
    out = members.join(roots.select("id.bucket", "id.station_id", F.col("root.station_id").alias("cluster_station")), ["bucket", "station_id"])
    size = F.count(F.lit(1)).over(Window.partitionBy("bucket", "cluster_station"))
    return out.withColumn("_n", size).where((F.col("_n") > 1) | (F.col("role") == "seed")).drop("_n")


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """One row per cluster: counts, centroids, spread, scores and strength. ``clustered`` has lat and lon."""
    key = ["bucket", "cluster_station"]
    w = F.greatest("anomaly_score", F.lit(0.001))
    seed = F.col("role") == "seed"
    base = clustered.groupBy(*key).agg(
        F.count(F.lit(1)).alias("member_count"),
        F.count_if(seed).alias("seed_count"),
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        (F.sum(w * F.col("lat")) / F.sum(w)).alias("weighted_lat"),
        (F.sum(w * F.col("lon")) / F.sum(w)).alias("weighted_lon"),
        F.max("anomaly_score").alias("max_score"),
        F.avg("temporal_excess").alias("mean_te"),
        F.avg("spatial_excess").alias("mean_se"),
        F.max("temporal_excess").alias("max_te"),
        F.max("spatial_excess").alias("max_se"),
        F.max("smoothed").alias("peak_value"),
        F.array_sort(F.collect_list(F.struct("station_id", F.col("lat").alias("lat"), F.col("lon").alias("lon")))).alias("points"),
    )
    far = clustered.join(base.select(*key, F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")), key)
    spread = far.groupBy(*key).agg(F.max(haversine_km("c_lat", "c_lon", "lat", "lon")).alias("spread_km"))
    part = lambda x, top, weight: weight * F.least(F.greatest(x, F.lit(0.0)) / top, F.lit(1.0))
    strength = part(F.col("seed_count").cast("double"), 3, 0.45) + part(F.col("member_count").cast("double"), 5, 0.2) + part(F.col("max_score"), 10, 0.2) + part(F.col("max_te"), 10, 0.075) + part(F.col("max_se"), 10, 0.075)
    alone = (F.col("member_count") == 1) & (F.col("seed_count") == 1)
    out = base.join(spread, key).withColumn("strength", F.when(alone, F.least(strength, F.lit(0.3))).otherwise(strength))
    return out.withColumn("eligible", F.col("seed_count") > 0).withColumn("members", F.transform("points", lambda p: p["station_id"]))


def _km(a: dict, b: dict) -> float:
    h = sin(radians(b["lat"] - a["lat"]) / 2) ** 2 + cos(radians(a["lat"])) * cos(radians(b["lat"])) * sin(radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * EARTH_KM * asin(min(1.0, sqrt(h)))


def linkable(earlier: DataFrame, later: DataFrame, cfg: EventConfig) -> DataFrame:
    """(u, v) of clusters ``v`` of ``later`` that may follow ``u`` of ``earlier``: up to ``max_gap_bins`` silent bins apart, with a shared member, close centroids or close members.

    All three are equi-joins on the bin: by station, and by cells of the two distances.
    """
    here = F.struct("bucket", "cluster_station")
    ahead = F.explode(F.array(*[F.col("bucket") + k * cfg.bin_seconds for k in range(1, cfg.max_gap_bins + 2)])).alias("at")
    points = later.select(here.alias("v"), F.col("bucket").alias("at"), F.explode("points").alias("p"))
    before = earlier.select(here.alias("u"), ahead, F.col("points")).select("u", "at", F.explode("points").alias("p"))
    shared = before.select("u", "at", "p.station_id").join(points.select("v", "at", "p.station_id"), ["at", "station_id"]).select("u", "v")
    near = distance_join(before.select("u", "at", F.col("p.lat").alias("a_lat"), F.col("p.lon").alias("a_lon")), points.select("v", "at", F.col("p.lat").alias("b_lat"), F.col("p.lon").alias("b_lon")), cfg.member_km, ["at"])
    first = earlier.select(here.alias("u"), ahead, F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    centres = distance_join(first, later.select(here.alias("v"), F.col("bucket").alias("at"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")), cfg.centroid_km, ["at"])
    return shared.union(near.select("u", "v")).union(centres.select("u", "v")).distinct()


class Linker:
    """The events of one family of clusters that a later cluster may still follow: what is over is forgotten.

    An event is named by the bin and station of its first cluster, so names sort by start. ``live`` has the last cluster of each.
    """

    def __init__(self, cfg: EventConfig):
        self.cfg, self.live, self.at = cfg, {}, {}

    def put(self, event: tuple, cluster: dict) -> None:
        old = self.live.get(event)
        if old is not None:
            self.at.pop((old["bucket"], old["cluster_station"]), None)
        self.live[event] = cluster
        self.at[cluster["bucket"], cluster["cluster_station"]] = event

    def drop(self, event: tuple) -> None:
        last = self.live.pop(event)
        self.at.pop((last["bucket"], last["cluster_station"]), None)

    def bin(self, bucket: int, found: list[dict]) -> tuple[list[tuple], list[tuple]]:
        """Links the clusters of one bin, whose ``near`` names the earlier clusters that each may follow.

        Returns (event, cluster) pairs, and the changes of the bin: (event, "merged_into" or "split_from", other event).
        """
        for k in [k for k, c in self.live.items() if bucket - c["bucket"] > (self.cfg.max_gap_bins + 1) * self.cfg.bin_seconds]:
            self.drop(k)
        links = {c["cluster_station"]: sorted(self.at[u] for u in c["near"] if u in self.at) for c in found}
        heirs: dict[tuple, dict] = {}
        for k in sorted({k for ks in links.values() for k in ks}):
            last, mine = self.live[k], [c for c in found if k in links[c["cluster_station"]]]
            heirs[k] = min(mine, key=lambda c: (-len(set(c["members"]) & set(last["members"])), _km(last, c), -c["strength"], c["cluster_station"]))
        out, changes = [], []
        for c in found:
            own = sorted(k for k, h in heirs.items() if h is c)
            lost = [k for k in links[c["cluster_station"]] if k not in own]
            keep = own[0] if own else (c["bucket"], c["cluster_station"])
            changes += [(k, "merged_into", keep) for k in own[1:]]
            if not own and lost:
                changes.append((keep, "split_from", max(lost)))
            out.append((keep, c, own))
        for keep, c, own in out:  # only now, as the events of a bin are linked to those of the bins before
            for k in own[1:]:
                self.drop(k)
        for keep, c, _ in out:
            self.put(keep, c)
        return [(k, c) for k, c, _ in out], changes


#: Clusters that one task links: they are few bytes, by which Spark would give them to one task.
CLUSTERS_A_TASK = 5_000
STATE = ["bucket", "cluster_station", "members", "points", "lat", "lon", "strength"]


def link_step(clusters: DataFrame, live: DataFrame | None, cfg: EventConfig) -> tuple[DataFrame, DataFrame]:
    """Links clusters to each other and to events that were live before them: (steps, live).

    ``steps`` has a row for each cluster (kind ``cluster``: event_id, bucket, cluster_station) and one for each merge or split (kind ``merged_into`` or ``split_from``:
    event_id, bucket, other). ``live`` has the events that clusters after these may still follow, each with its last cluster; it is what the next step starts from, and all
    that it needs of the past. All clusters must be of later bins than those of ``live``.

    Linking is a state machine over bins in order: an event takes the cluster that shares most members with its last one; the others it touches start events that split from
    it; events that take the same cluster merge into the earliest. Clusters that can't follow each other don't affect each other, so the state machine runs for each
    connected family by itself. A family's rows come to its task sorted by bin and are read as they come: however long it lives, the task holds its live events and one bin.
    """
    new = clusters.select(*STATE).withColumn("event_id", F.lit(None).cast("string"))
    both = new if live is None else new.unionByName(live.select(*STATE, "event_id"))
    both = cut(both)
    new = both.where("event_id is null")
    links = cut(linkable(both, new, cfg))
    here = F.struct("bucket", "cluster_station")
    families = components(both.select(here.alias("id")), links).select("id.bucket", "id.cluster_station", F.col("root").alias("family"))
    near = links.groupBy("v").agg(F.sort_array(F.collect_set("u")).alias("near")).select("v.bucket", "v.cluster_station", "near")
    rows = both.drop("points").join(families, ["bucket", "cluster_station"]).join(near, ["bucket", "cluster_station"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = lambda k: f"evt-{k[0]:012d}-{k[1]:06d}"
        key = lambda e: tuple(int(x) for x in e.split("-")[1:])
        linker, family, bucket, found = Linker(cfg), None, None, []

        def close() -> list[tuple]:
            if not found:
                return []
            linked, changes = linker.bin(bucket, found)
            return [("cluster", name(k), bucket, c["cluster_station"], None) for k, c in linked] + [(kind, name(k), bucket, None, name(o)) for k, kind, o in changes]

        def left() -> list[tuple]:
            return [("live", name(k), c["bucket"], c["cluster_station"], None) for k, c in linker.live.items()]

        for b in batches:
            out = []
            for r in b.to_dict("records"):
                of = (r["family"]["bucket"], r["family"]["cluster_station"])
                if of != family or r["bucket"] != bucket:
                    out += close()
                    found = []
                if of != family:
                    out += left()
                    linker, family = Linker(cfg), of
                bucket = int(r["bucket"])
                c = {"bucket": bucket, "cluster_station": int(r["cluster_station"]), "members": r["members"], "lat": r["lat"], "lon": r["lon"], "strength": r["strength"]}
                if r["event_id"] is not None:
                    linker.put(key(r["event_id"]), c)
                else:
                    found.append(c | {"near": [] if r["near"] is None else [(u["bucket"], u["cluster_station"]) for u in r["near"]]})
            yield pd.DataFrame(out, columns=COLUMNS).astype({"cluster_station": "Int64"})
        last = close() + left()
        yield pd.DataFrame(last, columns=COLUMNS).astype({"cluster_station": "Int64"})

    tasks = ceil(both.count() / CLUSTERS_A_TASK)
    dealt = (rows.repartition(tasks, "family") if tasks > 1 else rows.repartition("family")).sortWithinPartitions("family", "bucket", "cluster_station")
    made = cut(dealt.mapInPandas(run, "kind string, event_id string, bucket long, cluster_station long, other string"))
    # events that no cluster after the newest bin may follow are over
    newest = both.agg(F.max("bucket").alias("_newest"))
    kept = made.where("kind = 'live'").join(F.broadcast(newest), F.col("bucket") >= F.col("_newest") - cfg.max_gap_bins * cfg.bin_seconds)
    return made.where("kind <> 'live'"), kept.select("event_id", "bucket", "cluster_station").join(both.drop("event_id"), ["bucket", "cluster_station"])


COLUMNS = ["kind", "event_id", "bucket", "cluster_station", "other"]


def linked(steps: DataFrame) -> DataFrame:
    """(event_id, bucket, cluster_station, merged_into, split_from) of all ``steps``: every cluster with what became of its event, and what it came from."""
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("other"))).alias(k)
    changes = steps.where("kind <> 'cluster'").groupBy("event_id").agg(pick("merged_into"), pick("split_from"))
    return steps.where("kind = 'cluster'").select("event_id", "bucket", "cluster_station").join(changes, "event_id", "left")


def link_events(stats: DataFrame, cfg: EventConfig) -> DataFrame:
    """(event_id, bucket, cluster_station, merged_into, split_from) for every eligible cluster, all bins in one step; see ``link_step``."""
    return linked(link_step(stats.where("eligible"), None, cfg)[0])


def named(events: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows of ``events`` whose ``key`` is asked for, each asked key once or more: those that no event has are there with ``found`` false, so that a caller can warn of them. Null keys ask for nothing."""
    ids = asked.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.join(events.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def event_summary(linked: DataFrame, stats: DataFrame, cfg: EventConfig, final: DataFrame) -> DataFrame:
    """One row per event: span, bins, gaps, distinct sensors, peaks and status. ``final`` has one row, the last bin of the table (final_bucket)."""
    both = linked.join(stats, ["bucket", "cluster_station"])
    w = Window.partitionBy("event_id").orderBy("bucket")
    gaps = F.greatest(F.round((F.col("bucket") - F.lag("bucket").over(w)) / cfg.bin_seconds) - 1, F.lit(0))
    out = both.withColumn("gap", F.coalesce(gaps, F.lit(0))).groupBy("event_id", "merged_into", "split_from").agg(
        F.min("bucket").alias("start"),
        F.max("bucket").alias("last_seen"),
        F.count(F.lit(1)).alias("bins_seen"),
        F.sum("gap").cast("long").alias("gap_bins"),
        F.max("member_count").alias("peak_members"),
        F.max("strength").alias("strength"),
        F.max("max_score").alias("max_score"),
        F.max("peak_value").alias("peak_value"),
        F.max("mean_te").alias("max_te"),
        F.every((F.col("member_count") == 1) & (F.col("seed_count") == 1)).alias("isolated"),
    )
    sensors = both.select("event_id", F.explode("members").alias("s")).groupBy("event_id").agg(F.countDistinct("s").alias("sensors"))
    out = out.join(sensors, "event_id").join(F.broadcast(final))
    last = F.col("last_seen") == F.col("final_bucket")
    status = (
        F.when(F.col("merged_into").isNotNull(), "ended")
        .when(F.col("isolated"), "isolated")
        .when(F.col("strength") < 0.35, "weak")
        .when((F.col("bins_seen") == 1) & last, "emerging")
        .when(F.col("bins_seen") == 1, "transient")
        .when(last, "active")
        .otherwise("ended")
    )
    return out.withColumn("status", status).withColumn("duration_minutes", (F.col("last_seen") - F.col("start") + cfg.bin_seconds) / 60).drop("final_bucket")


def path(points: DataFrame, keys: list[str], cfg: EventConfig) -> DataFrame:
    """Adds displacement_km, bearing_deg and speed_kmh from the point before; null at the first, still below the movement floor."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    out = points.withColumns({"_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w), "_t": F.lag("bucket").over(w)})
    d = haversine_km("_lat", "_lon", "lat", "lon")
    still = d < cfg.movement_km
    hours = F.greatest(F.col("bucket") - F.col("_t"), F.lit(cfg.bin_seconds)) / 3600
    return out.withColumns(
        {
            "displacement_km": F.when(still, 0.0).otherwise(d),
            "bearing_deg": F.when(~still, bearing_deg("_lat", "_lon", "lat", "lon")),
            "speed_kmh": F.when(still, 0.0).otherwise(d / hours),
        }
    ).drop("_lat", "_lon", "_t")
