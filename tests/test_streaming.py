"""Streams: commits that are whole or invisible, late rows, and events linked bin by bin."""

import random

import pytest
from aerolith.config import AnomalyConfig, EventConfig
from aerolith.operators import anomaly, events
from aerolith.plans.catalog import CATALOG
from aerolith.plans import event_queries, views
from aerolith.streaming import ingest
from aerolith.streaming.commits import CommitLog
from aerolith.streaming.live import OBS, LiveEvents


class Killed(Exception):
    pass


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """Killed after its rows are written and before its manifest: nothing is there; the same batch run again is there once, with its health row."""
    log = CommitLog(spark, str(tmp_path / "log"))
    one, two = (spark.createDataFrame([(i % 15, float(i)) for i in r], "id long, v double") for r in (range(20), range(10, 30)))
    publish = CommitLog._publish

    def killed(self, batch, manifest):
        if "failures" in self.root:
            return publish(self, batch, manifest)
        raise Killed("gone")

    monkeypatch.setattr(CommitLog, "_publish", killed)
    with pytest.raises(Killed):
        ingest.commit_facts(log, one, 0, ["id"])
    assert list((tmp_path / "log/data/facts").iterdir()) and log.read("facts") is None
    assert [(r.batch_id, r.inserted, r.error) for r in ingest.health(log).collect()] == [(0, 0, "gone")]
    monkeypatch.undo()
    assert ingest.commit_facts(log, one, 0, ["id"]) and not ingest.commit_facts(log, two, 0, ["id"])
    assert ingest.commit_facts(log, two, 1, ["id"])
    assert sorted(r.id for r in log.read("facts").collect()) == list(range(15))
    assert sorted((r.batch_id, r.received, r.inserted, r.duplicates) for r in ingest.health(log).where("error is null").collect()) == [(0, 20, 15, 5), (1, 20, 0, 20)]


def test_ingest_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, float(i)) for i in range(20)], "id long, v double")
    for k in range(3):
        rows.where(f"id <> {k}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    log = CommitLog(spark, f"file://{tmp_path}/log")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again with its checkpoint, it finds nothing new
        ingest.ingest(stream, log, str(tmp_path / "cp"), ["id"]).awaitTermination()
    assert sorted(r.id for r in log.read("facts").collect()) == list(range(7))
    assert [m["batch"] for m in log.manifests()] == [0, 1, 2]
    assert [(r.batch_id, r.received - r.inserted - r.duplicates) for r in ingest.health(log).orderBy("batch_id").collect()] == [(0, 0), (1, 0), (2, 0)]


def test_late_rows_correct_closed_windows(spark, tmp_path):
    """Rows behind the watermark go to the side, and the corrected windows are those of all rows at once."""
    rng = random.Random(5)
    rows = [(rng.randrange(4), t + rng.randrange(-300, 300), rng.random()) for t in range(1000, 5000, 7)]
    batches = [rows[i : i + 150] for i in range(0, len(rows), 150)]
    very_late = [(1, 400, 99.0), (1, 750, 5.0), (3, 751, 0.5), (None, 750, 1.0), (2, None, 1.0)]
    log = CommitLog(spark, str(tmp_path / "log"))
    assert ingest.windows(log).count() == 0
    shape = "station_id long, t long, value double"
    for i, b in enumerate([*batches[:4], very_late, *batches[4:]]):
        assert ingest.window_step(log, spark.createDataFrame(b, shape), i, 100, 700)
    assert not ingest.window_step(log, spark.createDataFrame(very_late, shape), 4, 100, 700)

    def plain(some):
        out = {}
        for s, t, v in some:
            out.setdefault((s, t - t % 100), []).append((t, v))
        return {k: (len(x), round(sum(v for _, v in x) / len(x), 9), max(v for _, v in x), max(x)[1]) for k, x in out.items()}

    read = lambda df: {(r.station_id, r.bucket): (r.n, round(r["mean"], 9), r.high, r.last_value) for r in df.collect()}
    assert read(ingest.windows(log, corrected=False)) == plain(rows)
    fixed = ingest.windows(log)
    assert read(fixed) == plain(rows + very_late[:3])
    assert {(r.station_id, r.bucket): r.late_rows for r in fixed.where("late_rows > 0").collect()} == {(1, 400): 1, (1, 700): 1, (3, 700): 1}
    newest = max(t for _, t, _ in rows)
    assert {r.closed for r in fixed.where(f"bucket + 100 <= {newest - 700}").collect()} == {True} and {r.closed for r in fixed.where(f"bucket + 100 > {newest - 700}").collect()} == {False}


FIND, LINK = AnomalyConfig(min_history=3, baseline_seconds=1800, min_neighbors=1, radius_km=1.5, wide_radius_km=3.0), EventConfig()


def network(spark, seed, bins=90):
    """Stations on a grid; spots of high values that wander, so that events begin, meet, part and end."""
    rng = random.Random(seed)
    places = {i: (24.0 + 0.006 * (i // 7), 121.0 + 0.006 * (i % 7)) for i in range(49)}
    spots, rows, k = [[24.005 + 0.007 * j, 121.03 - 0.006 * j] for j in range(5)], [], 0
    for b in range(bins):
        for s in spots:
            s[0] = min(max(s[0] + rng.gauss(0, 0.003), 24.0), 24.036)
            s[1] = min(max(s[1] + rng.gauss(0, 0.003), 121.0), 121.036)
        for i, (lat, lon) in places.items():
            near = min(abs(lat - x) + abs(lon - y) for x, y in spots)
            value = 10 + rng.random() + (35 if near < 0.007 and b % 12 > 6 else 0)
            k += 1
            rows.append((i, k, b * 180 + rng.randrange(180), value, "future_timestamp_ahead_seconds=9" if rng.random() < 0.01 else ""))
    st = spark.createDataFrame([(i, *p) for i, p in places.items()], "station_id long, lat double, lon double")
    return st, rows


def batch_events(obs, st):
    rows = anomaly.anomaly_rows(obs, st, FIND)
    stats = events.cluster_stats(events.clusters(events.roles(rows, LINK), st, LINK).join(st, "station_id"))
    return {tuple(r) for r in events.link_events(stats, LINK).collect()}


def test_live_events_equal_those_of_a_batch(spark, tmp_path):
    """A stream in several batches, out of order within the allowed time, stopped and started anew, gives the events of one batch query; rows that come too late change nothing and are kept."""
    st, rows = network(spark, 3)
    rng = random.Random(1)
    rows = sorted(rows, key=lambda r: r[2] + rng.randrange(400))
    want = batch_events(spark.createDataFrame(rows, OBS), st)
    assert len(want) > 60 and any(r[3] for r in want) and any(r[4] for r in want)
    third = len(rows) // 3
    source = str(tmp_path / "in")

    def feed(name, some):
        spark.createDataFrame(some, OBS).coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        live = LiveEvents(spark, f"file://{tmp_path}/live", st, FIND, LINK, late=400)
        stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        live.start(stream, str(tmp_path / "cp")).awaitTermination()
        return live

    feed("a", rows[:third])
    live = run()
    part = {tuple(r)[:3] for r in live.events().collect()}
    closed = live.log.last()["facts"]["closed"]
    assert part == {r[:3] for r in want if r[1] < closed} and 0 < len(part) < len(want)
    feed("b", rows[third : 2 * third] + [(5, 1_000_000, 7, 500.0, ""), (6, 1_000_001, 8, 500.0, "")])
    feed("c", rows[2 * third :])
    live = run()
    assert not live.step(spark.createDataFrame(rows[:50], OBS), 1)  # a batch that comes again
    live.finish()
    assert {tuple(r) for r in live.events().collect()} == want
    assert sorted(r.obs_id for r in live.log.read("late").collect()) == [1_000_000, 1_000_001]
    newest = max(r[1] for r in want)
    assert all(r.bucket >= newest - LINK.bin_seconds for r in live.log.read("live", lambda m: m["batch"] == live.log.last()["batch"]).collect())


def test_live_events_without_observations(spark, tmp_path):
    st, _ = network(spark, 1, bins=1)
    live = LiveEvents(spark, f"file://{tmp_path}/live", st, FIND, LINK, late=400)
    assert live.step(spark.createDataFrame([(1, 1, None, 5.0, ""), (None, 2, 100, 5.0, "")], OBS), 0)
    live.finish()
    assert live.events().count() == 0


def test_event_stream_on_the_tables(spark, sf_dir):
    """The registered stream against the registered batch."""
    got = {tuple(r) for r in CATALOG["event_stream"][0](spark, sf_dir).collect()}
    stats = events.cluster_stats(event_queries.clusters(spark, sf_dir))
    assert got == {tuple(r) for r in events.link_events(stats, event_queries.EVENTS).collect()} and got
    assert views.obs(spark, sf_dir).count()
