"""Traces through measured wind: against closed forms, the relational estimate, and the limits."""

import numpy as np
import pytest
from aerolith.config import TraceConfig, WindConfig
from aerolith.operators import backtrace, trace, wind
from aerolith.plans import event_queries

LAT0, LON0 = 12.0, 33.0
K = 111_320.0 * float(np.cos(np.radians(LAT0)))
WIDE = (-1e5, -1e5, 1e5, 1e5)
CFG, WCFG = TraceConfig(particles=20, dt_seconds=60, minutes=30, block_seconds=600), WindConfig()


def network(spark, u, v, times=(0, 900, 1800), n=5):
    st = spark.createDataFrame([(i, LAT0 + 0.02 * i, LON0 - 0.01 * i) for i in range(n)], "station_id long, lat double, lon double")
    obs = spark.createDataFrame([(i, t, u, v, False) for i in range(n) for t in times], "station_id long, t long, u double, v double, calm boolean")
    return st, obs


def seeds(spark, *rows):
    return spark.createDataFrame([(e, s, t, LAT0, LON0, 1.0) for e, s, t in rows], "event_id string, station_id long, seed_t long, lat double, lon double, weight double")


def run(spark, u=1.0, v=0.5, pool=None, extent=WIDE, times=(0, 900, 1800), n=5, cfg=CFG, start=1800):
    st, obs = network(spark, u, v, times, n)
    return backtrace.trace(seeds(spark, ("e", 7, start)), backtrace.Measured(obs, st, WCFG), pool or {}, cfg, LAT0, LON0, extent).collect()


def test_even_wind_is_a_straight_line_back(spark):
    rows = run(spark)
    cells = {r["at"]: (r.ci, r.cj, r.hits) for r in rows if r.ci is not None}
    assert cells == {1800 - 60 * s: (int(np.floor(-1.0 * 60 * s / 250)), int(np.floor(-0.5 * 60 * s / 250)), 20) for s in range(1, 31)}
    assert [(r.ended, r.hits) for r in rows if r.ended] == [("time_limit", 20)]
    assert [(r.source, r.hits) for r in rows if r.source] == [("none", 60)]


def test_particles_stop_at_the_edge_and_without_wind(spark):
    rows = run(spark, u=10.0, extent=(-2000.0, -1e5, 1e5, 1e5))
    assert [(r.ended, r.hits) for r in rows if r.ended] == [("domain_limit", 20)] and min(r.ci for r in rows if r.ci is not None) >= -8
    assert sorted({r["at"] for r in rows if r.ci is not None}) == [1800 - 60 * s for s in (3, 2, 1)]
    rows = run(spark, n=2)
    assert [(r.ended, r.hits) for r in rows if r.ended] == [("wind_unavailable", 20)] and not [r for r in rows if r.ci is not None]
    # the only observations lie more than the tolerance before the last steps back
    rows = run(spark, times=(4000,), start=4000)
    assert {r.ended for r in rows if r.ended} == {"wind_unavailable"} and min(r["at"] for r in rows if r.ci is not None) == 4000 - 900 - 60


def test_errors_are_kept_for_a_block(spark):
    """Two residuals of opposite sign, five steps a block: every particle's way is made of whole blocks of one of them."""
    one = TraceConfig(particles=1, dt_seconds=60, minutes=30, block_seconds=300, cell_m=1.0)
    pool = {("≤3 km", "GOOD"): np.array([[0.5, 0.0], [-0.5, 0.0]])}
    rows = run(spark, pool=pool, cfg=one)
    x = [0] + [r.ci for r in sorted((r for r in rows if r.ci is not None), key=lambda r: -r["at"])]
    steps = [round((a - b) / 60, 1) for a, b in zip(x, x[1:], strict=False)]
    assert set(steps) == {0.5, 1.5} and all(len(set(steps[i : i + 5])) == 1 for i in range(0, 30, 5))
    assert rows == run(spark, pool=pool, cfg=one)


def test_a_given_wind(spark):
    """A constant function gives the closed form and what even measurements give; one that knows nothing ends the particles; each place and minute is asked once a task."""
    start = seeds(spark, ("e", 7, 1800))
    got = backtrace.trace(start, backtrace.even(1.0, 0.5), {}, CFG, LAT0, LON0, WIDE).collect()
    assert sorted(map(str, got)) == sorted(map(str, run(spark)))
    points = spark.createDataFrame([(7, 0.0, 0.0)], "station_id long, x double, y double")
    want = {(int(np.floor(r.x / 250)), int(np.floor(r.y / 250)), 1800 - 60 * r.step) for r in trace.uniform_steps(points, 1.0, 0.5, CFG).collect()}
    assert {(r.ci, r.cj, r["at"]) for r in got if r.ci is not None} == want
    nothing = backtrace.Given(lambda lat, lon, t: (np.full(len(lat), np.nan), np.zeros(len(lat))))
    assert [(r.ended, r.hits) for r in backtrace.trace(start, nothing, {}, CFG, LAT0, LON0, WIDE).collect() if r.ended] == [("wind_unavailable", 20)]
    asked = []

    def wind_of(lat, lon, t):
        asked.extend(zip(lat, lon, [t] * len(lat), strict=True))
        return 2.0 + 0 * lat, np.sin(lat)

    at = backtrace.Given(wind_of, decimals=3).at()
    for _ in range(3):
        u, v, _, _ = at(None, 0, np.array([1.00011, 1.0002, 2.0]), np.array([5.0, 5.0, 5.0]), 61)
    assert asked == [(1.0, 5.0, 60), (2.0, 5.0, 60)] and u.tolist() == [2.0] * 3 and v[0] == v[1] == np.sin(1.0)


def test_a_seed_without_a_place(spark):
    lost = spark.createDataFrame([("e", 1, None, LAT0, LON0), ("e", 2, 1800, None, LON0)], "event_id string, station_id long, seed_t long, lat double, lon double")
    rows = backtrace.trace(lost, backtrace.even(1.0, 0.0), {}, CFG, LAT0, LON0, WIDE).collect()
    assert sorted((r.station_id, r.ended, r.hits) for r in rows) == [(1, "wind_unavailable", 20), (2, "wind_unavailable", 20)]


def test_fallbacks():
    pool = {("≤3 km", "GOOD"): np.array([[1.0, 0]]), ("≤3 km", "HIGH_UNCERTAINTY"): np.array([[2.0, 0]]), (">10 km", "MEDIUM_UNCERTAINTY"): np.array([[3.0, 0]])}
    got = {k: (name, sorted(x[:, 0])) for k in ((0, "a"),) for name, x in [backtrace.fallback(pool, "≤3 km", "GOOD")]}
    assert got[0, "a"] == ("exact_bucket", [1.0])
    assert [(n, sorted(x[:, 0])) for n, x in (backtrace.fallback(pool, *k) for k in (("≤3 km", "CALM"), ("3–5 km", "MEDIUM_UNCERTAINTY"), ("3–5 km", "CALM")))] == [("distance_fallback", [1.0, 2.0]), ("quality_fallback", [3.0]), ("global_fallback", [1.0, 2.0, 3.0])]
    assert backtrace.fallback({}, "x", "y")[0] == "none"


def test_estimate_equals_the_relational_one(spark):
    rng = np.random.default_rng(8)
    st = [(i, LAT0 + rng.normal(0, 0.12), LON0 + rng.normal(0, 0.12)) for i in range(14)]
    obs = [(i, int(t), *rng.normal(0, 2, 2).tolist(), bool(rng.random() < 0.3)) for i in range(14) for t in rng.choice(4000, 4, replace=False)]
    points = [(k, LAT0 + rng.normal(0, 0.2), LON0 + rng.normal(0, 0.2), 2000) for k in range(80)]
    stations, o = spark.createDataFrame(st, "station_id long, lat double, lon double"), spark.createDataFrame(obs, "station_id long, t long, u double, v double, calm boolean")
    p = spark.createDataFrame(points, "k long, lat double, lon double, at long")
    selected = wind.temporal_select(o, p, WCFG)
    want = {r.k: r for r in wind.idw(p, selected, stations, ["k", "lat", "lon", "at"], WCFG).collect()}
    place = {i: (a, b) for i, a, b in st}
    then = np.array([[*place[r.station_id], r.u, r.v, r.calm, r.offset_s, r.kind == "nearest_only"] for r in sorted(selected.collect(), key=lambda r: r.station_id)], dtype=float)
    u, v, nearest, quality = backtrace.estimate(np.array([x[1] for x in points]), np.array([x[2] for x in points]), then, WCFG)
    for k in range(len(points)):
        w = want[k]
        assert w.quality == backtrace.QUALITIES[quality[k]]
        assert (w.u is None) == np.isnan(u[k]) and (w.u is None or (w.u, w.v, w.nearest_km) == pytest.approx((u[k], v[k], nearest[k])))
    assert len({w.quality for w in want.values()}) > 2


def test_surface_and_regions(spark):
    rows = [("e", 1, 0, 0, 10, 40, None, None), ("e", 2, 0, 0, 20, 40, None, None), ("e", 1, 1, 1, 20, 60, None, None), ("e", 2, 1, 1, 20, 60, None, None), ("e", 1, 9, 9, 30, 100, None, None), ("f", 3, 5, 5, 5, 1, None, None), ("e", 1, None, None, None, 20, "time_limit", None)]
    passed = spark.createDataFrame(rows, "event_id string, station_id long, ci int, cj int, at long, hits long, ended string, source string")
    s = spark.createDataFrame([("e", 1, 0.5), ("e", 2, 0.5), ("f", 3, 1.0)], "event_id string, station_id long, weight double")
    grid = backtrace.surface(passed, s, CFG)
    got = {(r.event_id, r.ci): (round(r.score, 6), r.support_count, r.times) for r in grid.collect()}
    assert got == {("e", 0): (round(40 / 60, 6), 2, [10, 20]), ("e", 1): (1.0, 2, [20]), ("e", 9): (round(50 / 60 * 0.625, 6), 1, [30]), ("f", 5): (1.0, 1, [5])}
    reg = {(r.event_id, r.rank): (r.cells, r.west, r.east, r.times, r.support) for r in backtrace.regions(grid, 0.6).collect()}
    assert reg == {("e", 1): (2, 0.0, 500.0, [10, 20], 2), ("f", 1): (1, 1250.0, 1500.0, [5], 1)}
    points = spark.createDataFrame([(1, "f", LAT0 + 1375 / 110_540, LON0 + 1375 / K), (2, "none", LAT0, LON0)], "point_id long, event_id string, lat double, lon double")
    near = {r.point_id: r.region_km for r in backtrace.top_region_distance(points, backtrace.regions(grid, 0.6), LAT0, LON0).collect()}
    assert near[1] < 1e-6 and near[2] is None


def test_movement(spark):
    st, obs = network(spark, 0.0, 2.0)
    path = [("north", 0, LAT0, LON0), ("north", 900, LAT0 + 0.01, LON0), ("east", 0, LAT0, LON0), ("east", 1800, LAT0, LON0 + 0.01), ("still", 0, LAT0, LON0), ("still", 900, LAT0, LON0), ("once", 0, LAT0, LON0), ("far", 0, 50.0, 0.0), ("far", 900, 51.0, 0.0)]
    out = {r.event_id: r for r in backtrace.movement(spark.createDataFrame(path, "event_id string, bucket long, lat double, lon double"), obs, st, WCFG).collect()}
    assert {k: r.status for k, r in out.items()} == {"north": "OK", "east": "OK", "still": "MOVEMENT_TOO_SMALL", "once": "INSUFFICIENT_CENTROID_PATH", "far": "WIND_UNAVAILABLE"}
    assert out["north"].difference_deg == pytest.approx(0, abs=1e-6) and out["east"].difference_deg == pytest.approx(90, abs=0.01)


def test_trace_queries_on_the_tables(spark, sf_dir):
    """Every receptor of every event sends all its particles, and the surfaces have no more than these."""
    ends = event_queries.trace_terminations(spark, sf_dir).collect()
    receptors = backtrace.event_receptors(event_queries._event_members(spark, sf_dir)).groupBy("event_id").count().collect()
    assert receptors
    for r in receptors:
        assert sum(e.particles for e in ends if e.event_id == r.event_id and e.ended) == 40 * r["count"]
    top = event_queries.trace_surface(spark, sf_dir).groupBy("event_id").agg({"score": "max", "density": "sum"}).collect()
    assert top and all(t["max(score)"] == 1.0 and t["sum(density)"] <= 1 + 1e-4 for t in top)
