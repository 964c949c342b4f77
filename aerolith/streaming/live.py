"""Events of a live stream of observations: anomalies, clusters and links of every bin as soon as it closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import AnomalyConfig, EventConfig
from ..operators import anomaly, events
from .commits import CommitLog
from .ingest import present

STEPS = "kind string, event_id string, bucket long, cluster_station long, other string"
OBS = "station_id long, obs_id long, t long, value double, quality_flags string"


class LiveEvents:
    """Keeps the events of a stream up to date under ``root``; all that it knows is in the committed batches there, so it can be started anew at any time.

    A bin closes when an observation comes that is ``late`` seconds newer than its end. Then its anomalies are found from the observations of
    the trailing baseline, its clusters are linked to the events that are live, and what changed is committed together with the events that may go on. Families
    of events merge as they meet: which clusters and live events belong together is found anew in every batch, over the bins that it closes, so no key has to hold a
    whole city's history. Observations of bins that have closed are kept apart, in ``late``: they change no event. Observations flagged as from the future don't close bins.
    """

    def __init__(self, spark: SparkSession, root: str, stations: DataFrame, find: AnomalyConfig, link: EventConfig, late: int):
        if find.bin_seconds != link.bin_seconds:
            raise ValueError("bins of anomalies and of events differ")
        self.spark, self.log, self.stations, self.find, self.link, self.late_seconds = spark, CommitLog(spark, root), stations, find, link, late

    def step(self, batch: DataFrame, batch_id: int, finish: bool = False) -> bool:
        """Takes a batch; False if it has been taken before. ``finish`` closes all bins."""
        past = self.log.manifests()
        if any(m["batch"] == batch_id for m in past):
            return False
        facts = past[-1]["facts"] if past else {"seen": None, "closed": None}
        rows = batch.select("station_id", "obs_id", F.col("t").cast("long").alias("t"), "value", "quality_flags")
        good = present(rows)
        span = good.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
        seen = max((x for x in (facts["seen"], span.high) if x is not None), default=None)
        closed, size = facts["closed"], self.find.bin_seconds
        until = closed
        if seen is not None:
            upto = seen + size if finish else seen - self.late_seconds
            until = max(x for x in (closed, upto - upto % size) if x is not None)
        behind = F.lit(False) if closed is None else F.coalesce(F.col("t") < closed, F.lit(False))
        frames = {"obs": rows.where(~behind), "late": rows.where(behind)}
        if until is not None and until != closed:
            stats = self._clusters(frames["obs"], closed, until)
            live = self.log.read("live", lambda m: m["batch"] == past[-1]["batch"]) if past else None
            frames["steps"], frames["live"] = events.link_step(stats.where("eligible"), live, self.link)
            frames["clusters"] = stats
        elif past and "live" in past[-1]["tables"]:  # no bin has closed: the live events stay
            frames["live"] = self.log.read("live", lambda m: m["batch"] == past[-1]["batch"])
        return self.log.write(batch_id, frames, {"seen": seen, "closed": until, "low": span.low, "high": span.high})

    def _clusters(self, obs: DataFrame, closed: int | None, until: int) -> DataFrame:
        """Clusters of the bins from ``closed`` to ``until``; of older observations only those of a baseline's length are read."""
        since = None if closed is None else closed - self.find.baseline_seconds - self.find.bin_seconds
        old = self.log.read("obs", lambda m: since is None or (m["facts"]["high"] is not None and m["facts"]["high"] >= since))
        every = obs if old is None else old.unionByName(obs)
        every = every.where(F.col("t") < until) if since is None else every.where(F.col("t").between(since, until - 1))
        rows = anomaly.anomaly_rows(every, self.stations, self.find)
        rows = rows if closed is None else rows.where(F.col("bucket") >= closed)
        return events.cluster_stats(events.clusters(events.roles(rows, self.link), self.stations, self.link).join(self.stations, "station_id"))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes all that the stream has, batch by batch; after a restart with the same checkpoint it goes on where it was."""
        return stream.writeStream.foreachBatch(lambda b, i: self.step(b, i) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def finish(self) -> None:
        """Closes all bins that are open, as at the end of a replay."""
        last = self.log.last()
        self.step(self.spark.createDataFrame([], OBS), last["batch"] + 1 if last else 0, finish=True)

    def events(self) -> DataFrame:
        """What ``events.link_events`` gives for the bins that have closed."""
        steps = self.log.read("steps")
        return events.linked(self.spark.createDataFrame([], STEPS) if steps is None else steps)
