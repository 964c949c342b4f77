"""Results that are larger than their tables, and pools of residuals that no task holds."""

import numpy as np
from aerolith.config import TraceConfig, WindConfig
from aerolith.operators import backtrace, evidence, spatial
from pyspark.sql import functions as F


def test_annotations_are_dealt_by_their_number_and_follow_their_measurement(spark, monkeypatch):
    """All pairs of few bytes met in one task, event by event, so that files repeated every measurement for each event. Rows equal those of all pairs, whatever a row of events holds."""
    rng = np.random.default_rng(7)
    events = [(i, int(t)) for i, t in enumerate(rng.integers(0, 30_000, 120))] + [(500, 100), (501, 107_300), (502, None)]
    measured = [(f" a{i % 3}", f"p{i}", int(t), float(i), 2.0 * (i % 2), "Maintenance" if i % 5 == 0 else None, "") for i, t in enumerate(rng.integers(0, 40_000, 80))] + [("a1", "p80", 7300, 1.0, 3.0, None, ""), ("a1", "p81", None, 1.0, 3.0, None, "")]
    f = spark.createDataFrame([("A1",), ("A 2",), ("a 2",)], "number string")
    m = spark.createDataFrame(measured, "cno string, pollutant string, m_t long, value double, standard double, status string, code string")
    e = spark.createDataFrame(events, "event_id long, t long")
    number = {" a1": "A1", "a1": "A1", " a2": "A 2"}
    want = sorted((k, number[c], c, p, mt - t, v, round(v / s, 2) if s > 0 else None, st is None) for k, t in events for c, p, mt, v, s, st, _ in measured if t is not None and mt is not None and c in number and abs(mt - t) <= 7200)
    monkeypatch.setattr(spatial, "PAIRS_A_TASK", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (5_000, 3):
            monkeypatch.setattr(evidence, "EVENTS_A_ROW", most, raising=False)
            out = evidence.monitor_annotations(f, m, e, digits=2)
            rows = [[tuple(r) for r in part] for part in out.rdd.glom().collect()]
            assert sorted((r for part in rows for r in part), key=str) == sorted(want, key=str)
            assert sum(map(bool, rows)) > 4
            for part in rows:
                names = [r[3] for r in part]
                assert sum(a != b for a, b in zip(names, names[1:])) == max(0, len(set(names)) - 1)
                if most > 3:
                    assert all(a[3] != b[3] or a[4] >= b[4] for a, b in zip(part, part[1:]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def residuals(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(t), *rng.normal(0, 2, 2).tolist(), "≤3 km" if i % 3 else "3–5 km", "GOOD" if t % 4 else "MEDIUM_UNCERTAINTY") for i, t in rng.integers(0, 90, (n, 2))] + [(1, 1, 0.0, 0.0, ">10 km", "GOOD")]
    return spark.createDataFrame(rows, "target long, at long, du double, dv double, bucket string, quality string")


def whole(df):
    """All residuals of each pool in the pools' order."""
    out: dict = {}
    for r in df.orderBy("bucket", "quality", F.xxhash64("target", "at"), "target", "at", "du", "dv").collect():
        out.setdefault((r.bucket, r.quality), []).append((r.du, r.dv))
    return {k: np.array(v) for k, v in out.items()}


def test_a_pool_has_all_residuals(spark, monkeypatch):
    """The first 2,000 by hash stood for all; now the others have numbers too, and the parts that are numbered are many."""
    monkeypatch.setattr(backtrace, "POOL", 20)
    monkeypatch.setattr(backtrace, "ROWS_A_PART", 15, raising=False)
    df = residuals(spark)
    want, got = whole(df), backtrace.whole_pools(df)
    others = {(r.bucket, r.quality, r.r): (r.du, r.dv) for r in got.others.collect()}
    assert got.sizes == {k: len(v) for k, v in want.items()} and len(others) == sum(max(0, len(v) - 20) for v in want.values()) > 200
    for (bucket, quality), v in want.items():
        assert got.first[bucket, quality].tolist() == v[:20].tolist()
        assert [others[bucket, quality, i] for i in range(20, len(v))] == [tuple(x) for x in v[20:].tolist()]
    monkeypatch.setattr(backtrace, "POOL", 1_000)
    assert backtrace.whole_pools(df).others is None and backtrace.whole_pools(df.limit(0)).sizes == {}


def test_particles_draw_from_whole_pools(spark, monkeypatch):
    """Residuals that tasks ask for by number give the traces of pools that are at hand as a whole: several blocks, lists and pools, fallbacks, particles that end early, a seed without a place."""
    rng = np.random.default_rng(5)
    st = spark.createDataFrame([(k, 25.0 + 0.02 * k, 121.0 + 0.01 * (k % 3)) for k in range(12)], "station_id long, lat double, lon double")
    obs = spark.createDataFrame([(k, 300 * j + 7 * k, *rng.normal(0, 3, 2).tolist(), bool(rng.random() < 0.2)) for k in range(12) for j in range(30)], "station_id long, t long, u double, v double, calm boolean")
    seeds = spark.createDataFrame([(f"e{i % 3}", i, 3000 if i < 20 else 6000, 25.0 + 0.003 * i, 121.0) for i in range(25)] + [("e9", 1, 3000, None, 121.0), ("e9", 2, 3000, 70.0, 121.0)], "event_id string, station_id long, seed_t long, lat double, lon double")
    cfg, extent = TraceConfig(particles=10, dt_seconds=60, minutes=20, block_seconds=300), (-300.0, -1e5, 1e5, 1e5)
    row = lambda r: tuple(map(str, r))
    run = lambda pool, **more: sorted(map(row, backtrace.trace(seeds, backtrace.Measured(obs, st, WindConfig()), pool, cfg, 25.0, 121.0, extent, **more).select("event_id", "station_id", "ci", "cj", "at", "hits", "ended", "source").collect()))
    df = residuals(spark)
    want = run(whole(df))
    assert len({r[6] for r in want}) > 3 and len({r[7] for r in want}) > 2
    monkeypatch.setattr(backtrace, "PARTICLES_AT_ONCE", 40)
    for most in (20, 1):
        monkeypatch.setattr(backtrace, "POOL", most)
        pools = backtrace.whole_pools(df)
        assert pools.others is not None and run(pools) == want
        assert run(backtrace.Pools(pools.sizes, pools.first, pools.others), cells=False) == [r for r in want if r[2] == "None"]
    assert run(pools.first) != want
