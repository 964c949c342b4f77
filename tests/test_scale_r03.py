"""Steps whose work must not grow faster than their input."""

import numpy as np
from aerolith.operators import diagnostics, graph


def test_components_of_a_descending_chain_take_few_rounds(spark, monkeypatch):
    """A chain whose smallest node is at the wrong end: labels that go one step a round needed as many rounds as it has nodes."""
    calls, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: calls.append(1) or real(df))
    chain = [0, *range(150, 0, -1)]
    edges = spark.createDataFrame(list(zip(chain, chain[1:])) + [(900, 901), (7, 7)], "u long, v long")
    nodes = spark.createDataFrame([(k,) for k in [*chain, 900, 901, 950]], "id long")
    got = {r.id: r.root for r in graph.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(chain, 0), 900: 900, 901: 900, 950: 950}
    assert len(calls) < 60


def test_window_order_statistics_against_sorting():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 300):
        ranks = rng.permutation(n)
        low = rng.integers(0, n, 200)
        high = low + 1 + (rng.random(200) * (n - low)).astype(int)
        k = (rng.random(200) * (high - low)).astype(int)
        assert diagnostics.kth_ranks(ranks, low, high, k).tolist() == [sorted(ranks[a:b])[c] for a, b, c in zip(low, high, k)]


def test_responses_make_no_pairs_of_fires_and_observations(spark):
    """Nulls, NaN, ties and an empty window; and no step of the plan has a row for each pair of a fire and an observation of it."""
    nan = float("nan")
    obs = spark.createDataFrame([(1, 90, 5.0), (1, 95, None), (1, 100, 7.0), (1, 101, 9.0), (1, 102, 9.0), (2, 100, None), (3, 99, nan), (3, 100, nan), (4, 500, 1.0)], "station_id long, t long, value double")
    st = spark.createDataFrame([(k, 25.0, 121.0) for k in (1, 2, 3, 4)], "station_id long, lat double, lon double")
    fires = spark.createDataFrame([(f, 100, 25.0, 121.0) for f in (8, 9)], "fire_id long, t long, lat double, lon double")
    out = diagnostics.event_response(obs, fires, st, 3.0, 6.0, 20, 10, 8)
    got = {(r.fire_id, r.station_id): tuple(str(x) for x in (r.baseline, r.during, r.post, r.peak, r.peak_t)) for r in out.collect()}
    assert got == {(f, s): v for f in (8, 9) for s, v in ((1, ("5.0", "9.0", "None", "9.0", "101")), (2, ("None",) * 5), (3, ("nan", "nan", "None", "nan", "100")))}
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().executedPlan().toString()


def test_timelines_are_grouped_once_a_place(spark, monkeypatch):
    """Many fires of one place: the values of its sensors are met once, and not for each fire."""
    from aerolith.operators import controls

    met = []
    real = controls.met
    monkeypatch.setattr(controls, "met", lambda near, rows, *a, **k: met.append(rows.count()) or real(near, rows, *a, **k))
    st = spark.createDataFrame([(k, 25.0 + 0.004 * k, 121.0) for k in range(8)], "station_id long, lat double, lon double")
    bins = spark.createDataFrame([(k, b * 180, float(k * b)) for k in range(8) for b in range(30)], "station_id long, bucket long, value double")
    fires = spark.createDataFrame([(f, 2000 + f, 2900 + f, 25.0, 121.0) for f in range(50)], "fire_id long, start long, end long, lat double, lon double")
    out = controls.timeline(fires, st, bins, controls.ControlConfig(before=600, after=600), 180)
    assert out.count() == out.select("fire_id", "bucket").distinct().count() > 500 and met == [30]


def test_fires_between_the_same_bins_are_judged_once(spark):
    from aerolith.operators import forensics

    cfg = forensics.ForensicsConfig(step=100, before=200, after=300)
    near = spark.createDataFrame([(1, 1001, 1501, 5, 0.5), (2, 1099, 1599, 5, 0.5), (3, 1000, 1500, 5, 0.5), (4, 1001, 1501, 6, 0.5)], "fire_id long, start long, end long, station_id long, distance_km double")
    few, same = forensics.alike(near, cfg)
    assert {r.fire_id: r.as_id for r in same.collect()} == {1: 1, 2: 1, 3: 3, 4: 4} and sorted(r.fire_id for r in few.collect()) == [1, 3, 4]
    bins = spark.createDataFrame([(5, b * 100, b * 100, float(b % 7)) for b in range(30)], "station_id long, bucket long, t long, value double")
    row = lambda r: (r.fire_id, r.station_id, r.baseline, r.peak, r.peak_bucket)
    whole = sorted(map(row, forensics.responses(near, bins, cfg).collect()), key=str)
    assert sorted(map(row, forensics.each_fire(forensics.responses(few, bins, cfg).drop("start", "end"), same).collect()), key=str) == whole


def test_annotations_are_not_shuffled_after_they_are_met(spark):
    from aerolith.operators import evidence

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        f = spark.createDataFrame([("A1",)], "number string")
        m = spark.createDataFrame([("a 1", "x", 10, 1.0, 2.0, None, "")], "cno string, pollutant string, m_t long, value double, standard double, status string, code string")
        e = spark.createDataFrame([(k, 5) for k in range(3)], "event_id long, t long")
        out = evidence.monitor_annotations(f, m, e)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == 3 and plan.index("_slot#", plan.index("Join")) < plan.index("_id#", plan.index("Join"))


def test_nearest_in_growing_circles_equals_all_pairs(spark):
    """Sparse and crowded places and copies of one place; and the first circle must not hold all pairs."""
    from aerolith.operators import spatial

    rng = np.random.default_rng(3)
    at = [(25 + x * 0.4, 121 + y * 0.4) for x, y in rng.random((250, 2)).tolist()] + [(25.1 + x * 0.002, 121.1 + y * 0.002) for x, y in rng.random((100, 2)).tolist()] + [(25.3, 121.3)] * 40
    st = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "station_id long, lat double, lon double")
    for k, km in ((1, 3.0), (5, 30.0)):
        row = lambda r: (r.a, r.b, r["rank"], r.distance_km)
        want = sorted(map(row, spatial.nearest(spatial.neighbor_pairs(st, km), ["a"], k).collect()))
        assert sorted(map(row, spatial.nearest_within(st, k, km).collect())) == want


def test_settings_are_tried_on_the_nearest_stations_only(spark):
    """A row for each setting is made after the nearest stations have been found, so all that is sorted has one row a station."""
    from aerolith.config import WindConfig
    from aerolith.operators import wind

    st = spark.createDataFrame([(k, 25.0 + 0.03 * k, 121.0) for k in range(14)], "station_id long, lat double, lon double")
    obs = spark.createDataFrame([(k, 60 * k, float(k), 1.0, False) for k in range(14)], "station_id long, t long, u double, v double, calm boolean")
    cfg = WindConfig()
    out = wind.leave_one_out(obs, st, cfg, [(3.0, 1.0), (8.0, 2.0)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "preferred_km" in plan and "preferred_km" not in plan[plan.index("Window ["):].split("\n+- Join")[0].split("distinct")[0].split("Aggregate [")[0]
    for radius, power in ((3.0, 1.0), (8.0, 2.0)):
        alone = wind.leave_one_out(obs, st, WindConfig(preferred_km=radius, power=power))
        row = lambda r: (r.target, r.n_stations, r.u, r.quality)
        assert sorted(map(row, out.where((out.preferred_km == radius) & (out.power == power)).collect()), key=str) == sorted(map(row, alone.collect()), key=str)
