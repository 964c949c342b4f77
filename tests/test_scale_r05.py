"""Traces through measured winds: what is read, sorted and gathered must not grow faster than its input."""

import numpy as np
from aerolith.config import AnomalyConfig, TraceConfig, WindConfig
from aerolith.operators import anomaly, backtrace, events, wind
from pyspark.sql import functions as F

LAT0, LON0 = 25.0, 121.0


def network(spark, n=12, silent=()):
    rng = np.random.default_rng(4)
    st = spark.createDataFrame([(k, LAT0 + 0.02 * k, LON0 + 0.01 * (k % 3)) for k in range(n)] + [(99, None, LON0), (98, 26.5, LON0)], "station_id long, lat double, lon double")
    rows = [(k, 300 * j + 7 * k, *rng.normal(0, 3, 2).tolist(), bool(rng.random() < 0.2)) for k in [*range(n), 98, 99] for j in range(30) if not (k in silent and 5 < j < 25)]
    return st, spark.createDataFrame(rows, "station_id long, t long, u double, v double, calm boolean")


def test_receptors_of_one_time_share_its_winds(spark, monkeypatch):
    """The winds of a time were gathered for each receptor; now once, however receptors are listed, and cells are left out where they aren't asked for."""
    st, obs = network(spark)
    seeds = spark.createDataFrame([(f"e{i % 3}", i, 3000 if i < 20 else 6000, LAT0 + 0.003 * i, LON0, 1.0) for i in range(25)], "event_id string, station_id long, seed_t long, lat double, lon double, weight double")
    cfg, pool = TraceConfig(particles=10, dt_seconds=60, minutes=20, block_seconds=300), {("≤3 km", "GOOD"): np.array([[0.5, 0.1], [-0.5, 0.2]]), ("3–5 km", "HIGH_UNCERTAINTY"): np.array([[2.0, 1.0]])}
    asked, real = [], backtrace.Measured.fields
    monkeypatch.setattr(backtrace.Measured, "fields", lambda self, times, *rest: asked.append(times.count()) or real(self, times, *rest))
    row = lambda r: tuple(map(str, r))
    run = lambda **more: sorted(map(row, backtrace.trace(seeds, backtrace.Measured(obs, st, WindConfig()), pool, cfg, LAT0, LON0, (-300.0, -1e5, 1e5, 1e5), **more).collect()))
    whole = run()
    assert asked == [2] and len({r[6] for r in whole}) == 3
    monkeypatch.setattr(backtrace, "PARTICLES_AT_ONCE", 30)
    assert run() == whole and run(cells=False) == [r for r in whole if r[2] == "None"]


def test_observations_ask_their_nearest_stations(spark, monkeypatch):
    """All stations were asked for each observation. A silent station, one without a place, one far off and networks smaller than what is needed: the same rows as from all."""
    asked, real = [], getattr(wind, "_selected", None)
    monkeypatch.setattr(wind, "_selected", lambda reach, rows, *rest: asked.append(rows.count()) or real(reach, rows, *rest), raising=False)
    keys = ["target", "at", "lat", "lon", "actual_u", "actual_v"]
    for n, cfg in ((12, WindConfig(max_stations=4)), (12, WindConfig(max_stations=2, min_stations=3, preferred_km=4.0)), (3, WindConfig())):
        st, obs = network(spark, n, silent=(5, 6))
        asked.clear()
        got = wind.leave_one_out(obs, st, cfg)
        need, rows = max(cfg.max_stations, cfg.min_stations), obs.where("station_id < 98").count()
        assert asked[0] == rows * min(need, n - 1) and asked[1] < rows * (n - 1) and (n == 3 or asked[1] > 0)
        target = obs.join(st, "station_id").select(F.col("station_id").alias("target"), F.col("t").alias("at"), "lat", "lon", F.col("u").alias("actual_u"), F.col("v").alias("actual_v"))
        want = wind.idw(target, wind.temporal_select(obs, target, cfg), st, keys, cfg, exclude="target")
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_pool_is_found_in_parts(spark, monkeypatch):
    """Spark ranks within a whole pool in one task, where its limit is above a thousand."""
    monkeypatch.setattr(backtrace, "POOL", 20)
    rng = np.random.default_rng(3)
    rows = [(int(i), int(t), float(i), float(t), "≤3 km" if i % 3 else "3–5 km", "GOOD") for i, t in rng.integers(0, 90, (400, 2))] + [(1, 1, 0.0, 0.0, ">10 km", "GOOD")]
    df = spark.createDataFrame(rows, "target long, at long, du double, dv double, bucket string, quality string")
    plans, real = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or real(self))
    got = backtrace.pools(df)
    assert "_part" in plans[0] and "Sort [" not in plans[0]
    for (bucket, quality), some in got.items():
        order = df.where((F.col("bucket") == bucket) & (F.col("quality") == quality)).orderBy(F.xxhash64("target", "at"), "target", "at", "du", "dv").limit(20)
        assert some.tolist() == [[r.du, r.dv] for r in real(order)]
    assert len(got) == 3


def test_bins_and_clusters_are_dealt_by_their_number(spark, monkeypatch):
    """Spark counts bytes: all bins were measured, and all clusters linked, in one task."""
    rng = np.random.default_rng(6)
    st = spark.createDataFrame([(k, LAT0 + 0.005 * (k % 5), LON0 + 0.005 * (k // 5)) for k in range(20)], "station_id long, lat double, lon double")
    obs = spark.createDataFrame([(k, 180 * j + 5, float(5 + rng.exponential(3) + (40 if j % 17 == 0 and k < 6 else 0)), 1000 * k + j) for k in range(20) for j in range(80)], "station_id long, t long, value double, obs_id long")

    def run() -> tuple:
        rows = anomaly.anomaly_rows(obs, st, AnomalyConfig())
        stats = events.cluster_stats(events.clusters(events.roles(rows, events.EventConfig()), st, events.EventConfig()).join(st, "station_id"))
        linked = events.link_events(stats, events.EventConfig())
        return rows, sorted(map(str, rows.collect())), sorted(map(str, linked.collect()))

    _, want, links = run()
    assert links
    monkeypatch.setattr(anomaly, "BINS_A_TASK", 100, raising=False)
    monkeypatch.setattr(events, "CLUSTERS_A_TASK", 1, raising=False)
    rows, got, again = run()
    assert got == want and again == links and "RepartitionByExpression [station_id" in rows._jdf.queryExecution().optimizedPlan().toString()
