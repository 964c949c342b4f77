"""Steps whose tasks and tables must not grow faster than their input."""

import numpy as np
from aerolith.operators import spatial


def test_many_pairs_of_few_stations_are_dealt_to_many_tasks(spark, monkeypatch):
    """Spark counts bytes: all pairs of a small table were made in one task."""
    monkeypatch.setattr(spatial, "PAIRS_A_TASK", 2_000, raising=False)
    rng = np.random.default_rng(1)
    at = [(25 + x * 0.02, 121 + y * 0.02) for x, y in rng.random((150, 2)).tolist()] + [(25.3, 121.3), (25.3, 121.3), (25.5, 121.5)]
    st = spark.createDataFrame([(i, *p) for i, p in enumerate(at)] + [(990, None, 121.0)], "station_id long, lat double, lon double").coalesce(1)
    pairs = spatial.neighbor_pairs(st, 5.0)
    sizes = pairs.rdd.glom().map(len).collect()
    assert sum(sizes) == 150 * 149 + 2 and max(sizes) < 6_000
    counts = {r.a: (r["within_0.5km"], r.within_5km) for r in spatial.counts_within(st, [0.5, 5.0]).collect()}
    want: dict = {}
    for r in pairs.collect():
        near, far = want.get(r.a, (0, 0))
        want[r.a] = (near + (r.distance_km <= 0.5), far + 1)
    assert counts == want and counts[151] == (1, 1) and 152 not in counts


def test_fires_are_grouped_without_all_their_pairs(spark, monkeypatch):
    """Places that burn again and again, nulls, NaN, an id at two places: the same groups as from all pairs, from few links."""
    from aerolith.operators import evidence

    links, real = [], evidence.components
    monkeypatch.setattr(evidence, "components", lambda nodes, edges: links.append(edges.count()) or real(nodes, edges))
    rng = np.random.default_rng(7)
    spots = [(25.0, 121.0), (25.0, 121.008), (25.02, 121.0), (25.026, 121.0), (25.2, 121.0)]
    rows = [(i, int(t), *spots[s]) for i, (t, s) in enumerate(zip(rng.integers(0, 4_000, 60) * 100, rng.integers(0, 5, 60), strict=True))]
    rows += [(1000 + i, 900_000, 25.4, 121.4) for i in range(150)] + [(70, None, 25.0, 121.0), (71, 5, None, 121.0), (72, 900_000, float("nan"), 121.4), (3, 2_000_000, 25.0, 121.0), (74, 2_000_100, 25.0, 121.0)]
    got = {r.fire_id: r.group_id for r in evidence.fire_groups(spark.createDataFrame(rows, "fire_id long, t long, lat double, lon double"), 1.0, 3600).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = lambda a, b: None not in a and None not in b and abs(a[1] - b[1]) <= 3600 and 111.195 * np.hypot(a[2] - b[2], (a[3] - b[3]) * np.cos(np.radians(25))) <= 1.0
    for a in rows:
        for b in rows:
            if near(a, b):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    assert got == {k: find(k) for k in root} and links[0] < 300


def test_clashes_of_times_equal_all_pairs_without_making_them(spark):
    """Fires that touch, overlap, lie in one another, burn on the moved day themselves, or end where others begin; many at one place."""
    from aerolith.operators import controls

    rng = np.random.default_rng(9)
    day, spots = 86_400, [(25.0, 121.0), (25.0, 121.007), (25.02, 121.0), (25.3, 121.0)]
    rows = [(i, int(s) * 3600, int(s + n) * 3600, *spots[p]) for i, (s, n, p) in enumerate(zip(rng.integers(0, 150, 40), rng.integers(0, 60, 40), rng.integers(0, 4, 40), strict=True))]
    rows += [(90, 20 * day, 21 * day, 25.3, 121.0), (91, 22 * day, 23 * day, 25.3, 121.0), (92, 40 * day, 45 * day, 25.3, 121.0)]
    fires = spark.createDataFrame([*rows, rows[-1]], "fire_id long, start long, end long, lat double, lon double")
    moved = [(i, d, s + d * day, e + d * day, y, x) for i, s, e, y, x in rows for d in (-2, 1, 2)]
    out = controls.clashes(fires, spark.createDataFrame(moved, "fire_id long, day int, start long, end long, lat double, lon double"), 1.0)
    near = lambda a, b: 111.195 * np.hypot(a[0] - b[0], (a[1] - b[1]) * np.cos(np.radians(25))) <= 1.0
    want = {(m[0], m[1]) for m in moved for f in rows if f[0] != m[0] and m[2] < m[3] and f[1] < m[3] and f[2] > m[2] and near(m[4:], f[3:])}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(moved)


def test_percentiles_equal_the_builtin_and_keep_no_group_in_one_task(spark):
    """Ties, nulls, NaN, infinities, groups of one value and of none; the plan has no aggregate that collects a group's values."""
    from aerolith.operators import wind
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = [("a", float(x), float(round(x))) for x in rng.exponential(5, 999)] + [("b", 2.5, None), ("c", None, None), ("d", 1.0, float("nan")), ("d", float("inf"), 3.0), ("d", -4.0, 2.0), *[("e", 7.0, 7.0)] * 20]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    asked = {"p": ("x", 0.5), "q": ("x", 0.9), "r": ("y", 0.25)}
    out = wind.percentiles(df, ["k"], asked, bins=16)
    want = df.groupBy("k").agg(*[F.percentile(c, F.lit(s)).alias(n) for n, (c, s) in asked.items()])
    row = lambda r: (r.k, *[None if r[n] is None else str(round(r[n], 9)) for n in asked])
    assert sorted(map(row, out.collect())) == sorted(row(r) for r in want.collect() if r.k != "c")
    errors = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0)], "k string, vector_error double, speed_error double, direction_error double, u double, v double, actual_u double, actual_v double")
    assert "percentile(" not in wind.error_metrics(errors, ["k"])._jdf.queryExecution().optimizedPlan().toString()


def test_validation_takes_more_tasks_for_more_rows(spark, monkeypatch):
    """A task's rows grew with the table, for the number of shuffle partitions is fixed."""
    from aerolith.config import WindConfig
    from aerolith.operators import wind

    st = spark.createDataFrame([(k, 25.0 + 0.01 * k, 121.0) for k in range(6)], "station_id long, lat double, lon double")
    obs = spark.createDataFrame([(k % 6, 60 * k, float(k), 1.0, False) for k in range(200)], "station_id long, t long, u double, v double, calm boolean")
    row = lambda r: (r.target, r["at"], r.n_stations, r.u, r.quality)
    want = sorted(map(row, wind.leave_one_out(obs, st, WindConfig()).collect()))
    monkeypatch.setattr(wind, "ROWS_A_TASK", 100, raising=False)
    out = wind.leave_one_out(obs, st, WindConfig())
    assert sorted(map(row, out.collect())) == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") >= 2


def test_points_of_one_place_meet_cells_once(spark, monkeypatch):
    """A point without a place has zeros; the distance join has a row for each place, not for each point."""
    from aerolith.operators import evidence

    met, real = [], evidence.distance_join
    monkeypatch.setattr(evidence, "distance_join", lambda a, b, km: met.append(a.count()) or real(a, b, km))
    points = spark.createDataFrame([(i, "x", 25.0, 121.0) for i in range(50)] + [(90, "y", 25.1, 121.0), (91, "y", None, 121.0)], "k long, kind string, lat double, lon double")
    cells = spark.createDataFrame([(25.001, 121.0, 0.5, 0.2), (25.002, 121.0, 1.0, 0.1)], "lat double, lon double, score double, support_fraction double")
    got = {r.k: (r.kind, r.local_max, r.support, r.nearest_km and round(r.nearest_km, 3)) for r in evidence.surface_metrics(points, cells, "k").collect()}
    assert got == {**{i: ("x", 1.0, 0.2, 0.111) for i in range(50)}, 90: ("y", 0.0, 0.0, None), 91: ("y", 0.0, 0.0, None)} and met == [3]


def test_steps_are_made_by_many_tasks(spark, monkeypatch):
    from aerolith.config import TraceConfig
    from aerolith.operators import trace

    monkeypatch.setattr(trace, "STEPS_A_TASK", 600, raising=False)
    points = spark.range(200).selectExpr("id as station_id", "cast(id as double) as x", "0.0D as y").coalesce(1)
    sizes = trace.uniform_steps(points, 1.0, 0.5, TraceConfig()).rdd.glom().map(len).collect()
    assert sum(sizes) == 12_000 and max(sizes) < 3_000
