"""Reports with zones and stale values, core zones, fires and monitors of events, surfaces and sensor forensics, on values set by hand."""

import random

import pytest
from aerolith.config import AnomalyConfig
from aerolith.operators import anomaly, controls, diagnostics, evidence, forensics, trace
from pyspark.sql import functions as F

PLACE = "station_id long, lat double, lon double"
OBS = "station_id long, obs_id long, t long, value double, quality_flags string"


def test_report_zones_and_ages(spark):
    """Twelve close stations with two hours of history; the last values are of different ages and one rises."""
    st = spark.createDataFrame([(i, 24.0 + 0.001 * i, 121.0) for i in range(12)] + [(90, 24.5, 121.0), (91, 30.0, 121.0)], PLACE)
    end, rows, k = 7200, [], 0
    for i in range(12):
        for t in range(i, end, 180):
            k += 1
            # of two stations the last four minutes are missing
            if i in (5, 6) and t > end - 420:
                continue
            rows.append((i, k, t, 60.0 if i in (2, 3, 6) and t > end - 800 else 10.0 + (t // 180 + i) % 3 * 0.1, ""))
    rows.append((7, 9999, end + 100, 500.0, ""))
    obs = spark.createDataFrame(rows, OBS)
    cfg = AnomalyConfig(max_age_seconds=200)
    core, context = (24.0, 120.9, 24.0045, 121.1), (23.9, 120.9, 24.6, 121.1)
    out = {r.station_id: r for r in anomaly.report_at(obs, st, end, cfg, core, context, lookback=7200).collect()}
    assert sorted(out) == [*range(12), 90]
    assert {i for i, r in out.items() if r.zone == "core"} == set(range(5))
    assert {i: r.status for i, r in out.items() if r.status != "usable"} == {5: "stale", 6: "stale", 90: "missing"}
    assert (out[5].flags, out[90].flags, out[0].flags) == ("stale_current_observation", "missing_current_value", "")
    # the core's edge cuts off no neighbours, stale ones are nobody's
    assert (out[0].neighbor_count, out[2].neighbor_count, out[6].neighbor_count) == (6, 8, 10)
    assert out[2].is_candidate and out[3].is_candidate and not out[6].is_candidate and not out[6].is_isolated and out[6].anomaly_score > 5
    assert out[7].value < 20  # what comes after the cutoff isn't seen
    zones = {r.zone: r for r in anomaly.report_summary(anomaly.report_at(obs, st, end, cfg, core, context, lookback=7200)).collect()}
    assert (zones["core"].sensors, zones["core"].usable, zones["core"].candidates) == (5, 5, 2)
    assert (zones["context"].sensors, zones["context"].usable, zones["context"].stale, zones["context"].missing) == (13, 10, 2, 1)
    short = {r.station_id: r.history_count for r in anomaly.report_at(obs, st, end, cfg, core, context, lookback=1000).collect()}
    assert max(short.values()) == 4
    ahead = {r.station_id: r.flags for r in anomaly.report_at(obs, st, end + 200, cfg, core, context, now=end - 210).collect()}
    assert ahead[7] == "suspicious_future_timestamp"
    assert anomaly.report_at(obs.limit(0), st, end, cfg, core, context).where("status <> 'missing'").count() == 0


def test_core_zone(spark):
    """A grid of four by five cells of one degree: industrial cells in a component, the fallback to dense cells, and growing."""
    box = (0.0, 0.0, 4.0, 5.0)

    def points(cells):
        rows = [(r + 0.5, c + 0.5, True, i < k) for (r, c), (n, k) in cells.items() for i in range(n)] + [(0.5, 4.5, False, True)] * 9
        return spark.createDataFrame(rows, "lat double, lon double, fresh boolean, industrial boolean")

    get = lambda cells: [tuple(r) for r in diagnostics.core_zone(points(cells), box, 4, 5).collect()]
    full = {(r, c): (1, 0) for r in range(4) for c in range(5)}
    assert get({**full, (1, 1): (4, 2), (1, 2): (3, 2), (3, 4): (3, 3)}) == [("industrial", 1, 0.0, 0.0, 3.0, 4.0, 12, 17, 4, 1.0)]
    # too much of the wider window is empty, so the component stays as it is
    assert get({(1, 1): (4, 2), (1, 2): (3, 2), (3, 4): (3, 3)}) == [("industrial", 0, 1.0, 1.0, 2.0, 3.0, 2, 7, 4, 1.0)]
    assert get({**full, (0, 0): (9, 0), (0, 1): (5, 0), (3, 3): (9, 0)})[0][:2] == ("dense", 1)
    assert get({(0, 0): (1, 0)}) == [] and diagnostics.core_zone(points({}), box, 4, 5).count() == 0


def test_fires_of_events(spark):
    """Ranks with ties by id, a cap, the window, the extent, and a confidence that is missing."""
    cells = spark.createDataFrame([("a", 10.0, 20.0, 1.0, 0.5), ("a", 10.01, 20.0, 0.4, 1.0), ("b", 50.0, 20.0, 1.0, 1.0)], "event_id string, lat double, lon double, score double, support_fraction double")
    events = spark.createDataFrame([("a", 100_000), ("b", 100_000), ("c", 100_000)], "event_id string, t long")
    fires = [(1, 100_000, 10.0, 20.0, 1.0), (2, 100_000, 10.0, 20.0, 1.0), (3, 100_000 + 6 * 3600, 10.01, 20.0, None), (4, 100_000 + 13 * 3600, 10.0, 20.0, 1.0), (5, 100_000, 11.0, 20.0, 1.0), (6, 100_000 - 12 * 3600, 10.05, 20.0, 0.0)]
    groups = spark.createDataFrame(fires, "group_id long, first_t long, lat double, lon double, confidence double")
    out = [(r.event_id, r["rank"], r.group_id, r.found, round(r.match_score, 6)) for r in evidence.event_fires(groups, events, cells, limit=3).orderBy("event_id", "rank").collect()]
    assert out == [("a", 1, 1, 4, 0.9), ("a", 2, 2, 4, 0.9), ("a", 3, 3, 4, round(0.55 * 0.4 + 0.2 + 0.1 + 0.025, 6))]
    assert evidence.event_fires(groups.limit(0), events, cells).count() == 0


def test_monitors_of_facilities(spark):
    facilities = spark.createDataFrame([("A 1",), ("a1",), ("B2",), (None,)], "number string")
    rows = [(" a1 ", "NOx", 1000, 5.0, 10.0, "", ""), ("A1", "SOx", 9000, 5.0, 0.0, "Calibration", ""), ("b2", "NOx", 1000 + 7200, 1.0, None, None, None), ("c3", "NOx", 1000, 1.0, 1.0, "", ""), (None, "NOx", 1000, 1.0, 1.0, "", "")]
    measured = spark.createDataFrame(rows, "cno string, pollutant string, m_t long, value double, standard double, status string, code string")
    events = spark.createDataFrame([(7, 1000)], "event_id long, t long")
    out = {(r.number, r.pollutant, r.age_s, r.ratio, r.usable) for r in evidence.monitor_annotations(facilities, measured, events).collect()}
    assert out == {("A 1", "NOx", 0, 0.5, True), ("B2", "NOx", 7200, None, True)}


def test_regions_of_two_surfaces(spark):
    """Regions pair by common cells first, then by distance, each once; an empty surface compares as nothing."""
    shape = "ci int, cj int, score double"
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.9), (10, 0, 0.8), (20, 0, 0.7)], shape)
    b = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (12, 0, 1.0), (30, 30, 0.7)], shape)
    out = [tuple(r) for r in trace.match_regions(trace.region_cells(a), trace.region_cells(b)).orderBy("rank_a").collect()]
    assert [(r[0], r[1], r[2]) for r in out] == [(1, 2, 1), (2, 1, 0), (3, 3, 0)] and out[1][3] == pytest.approx(0.5)
    one = trace.compare(a, b, 25.0, 121.0).first()
    assert (one.cells, one.same_peak, one.area_a, one.close, one.alike) == (7, False, 0.25, False, False) and one.shift_km == pytest.approx(12 * 0.25, rel=0.02)
    same = trace.compare(a, a, 25.0, 121.0).first()
    assert (same.correlation, same.same_peak, same.shift_km, same.close, same.alike) == (pytest.approx(1.0), True, 0.0, True, True)
    none = trace.compare(a, a.limit(0), 25.0, 121.0).first()
    assert (none.same_peak, none.shift_km, none.close, none.area_b) == (False, None, False, 0.0)


CFG = forensics.ForensicsConfig()
START, END = 72_000, 73_800


def sensors_around(spark, series, places=None):
    """One fire at the origin; sensor i has ``series[i]``: bin index relative to the start -> value, all others 10."""
    places = places or {i: 0.0015 * (i + 1) for i in series}
    fires = spark.createDataFrame([(1, START, END, 0.0, 100.0)], "fire_id long, start long, end long, lat double, lon double")
    st = spark.createDataFrame([(i, lat, 100.0) for i, lat in places.items()], PLACE)
    rows = [(i, b, b + 5, float(values.get((b - START) // 180, 10.0)), b + 65) for i, values in series.items() for b in range(START - 36_000, END + 14_400, 180) if values.get((b - START) // 180, 10.0) is not None]
    return fires, st, spark.createDataFrame(rows, "station_id long, bucket long, t long, value double, received long")


def test_shapes_against_a_plain_version(spark):
    rng = random.Random(8)
    series = {i: {k: rng.choice([10, 10, 10, 12, 14, 14, 25, None]) for k in range(0, 70)} for i in range(40)}
    series[40], series[41] = {}, {k: None for k in range(-40, 0)}
    fires, st, bins = sensors_around(spark, series, {i: 0.0005 * (i + 1) for i in series})
    out = {r.station_id: r for r in forensics.shapes(forensics.responses(controls.around(fires, st, 5.0), bins, CFG), CFG).collect()}
    assert len(out) == 42
    for i, values in series.items():
        points = [(START + 180 * k, float(values.get(k, 10.0))) for k in range(70) if values.get(k, 10.0) is not None]
        high = [v > 13 for _, v in points]
        longest = run = 0
        for j, (t, _) in enumerate(points):
            run = (run + 1 if j and high[j - 1] and t - points[j - 1][0] == 180 else 1) if high[j] else 0
            longest = max(longest, run)
        kept = []
        for j, (t, v) in enumerate(points):
            if v > 13 and all(v >= points[n][1] for n in (j - 1, j + 1) if 0 <= n < len(points)) and (not kept or t - kept[-1] >= 360):
                kept.append(t)
        r, n = out[i], sum(high)
        if i == 41:
            assert r.baseline is None and r.excess is None and r["shape"] == "NO_CLEAR_SPIKE"
            continue
        want = "NO_CLEAR_SPIKE" if not n else "MULTI_PEAK" if len(kept) >= 2 else "SINGLE_BIN_SPIKE" if n == 1 else "SUSTAINED_RISE" if longest >= 3 else "SHORT_PULSE"
        top = max(v for _, v in points)
        assert (r.over_3, r.longest, r.peaks, r["shape"], r.peak, r.peak_bucket) == (n, longest, len(kept), want, top, next(t for t, v in points if v == top))


def test_classes_of_sensors_and_fires(spark):
    """Each rule of the ladder: coherent neighbours, a plume downwind, a lone spike that has happened before at a fixed interval, and nothing."""
    up = {k: 30 for k in range(5, 9)}
    series = {0: up, 1: up, 2: up, 3: {4: 60, **{k: 70 for k in range(-120, -20, 20)}}, 4: {}, 5: {k: 40 for k in range(3, 12)}, 6: {2: 30}}
    places = {0: 0.0, 1: 0.0015, 2: 0.0030, 3: 0.02, 4: 0.028, 5: 0.036, 6: 0.0369}
    fires, st, bins = sensors_around(spark, series, places)
    near = controls.around(fires, st, CFG.km)
    shaped = forensics.shapes(forensics.responses(near, bins, CFG), CFG)
    prior, banded, signs = forensics.history(shaped, bins, fires, CFG), forensics.bands(shaped, st, CFG), forensics.faults(shaped, bins, st, CFG, "received")
    wind = near.select("fire_id", "station_id", (F.col("station_id") == 5).alias("plausible"))
    out = {r.station_id: r for r in forensics.classify(shaped, banded, prior, signs, wind, CFG).collect()}
    assert {i: r["class"] for i, r in out.items()} == {0: "COHERENT_LOCAL_RESPONSE", 1: "COHERENT_LOCAL_RESPONSE", 2: "COHERENT_LOCAL_RESPONSE", 3: "ISOLATED_SENSOR_SPIKE", 4: "NO_SIGNIFICANT_RESPONSE", 5: "NARROW_POSSIBLE_PLUME", 6: "AMBIGUOUS"}
    assert (out[3].prior_similar, out[3].interval, out[3].interval_share, out[3].history, out[3].clock, out[3].cadence) == (5, 20, 1.0, "SUFFICIENT_HISTORY", "NORMAL_OR_UNKNOWN", 3.0)
    assert (out[1].corroborating, out[6].seen, out[3].seen) == (2, 2, 1)
    band = {(r.station_id, r.band): r for r in banded.collect()}
    assert band[0, "band_2"].sensors == 1 and band[0, "band_3"].over_10 == 1 and band[0, "band_3"].max_median == 20.0
    rows = bins.select("station_id", "bucket", F.lit(1.0).alias("anomaly_score"), F.col("value").alias("z_t"), F.lit(None).cast("double").alias("z_s"))
    top = forensics.top_sensors(shaped, rows, CFG)
    assert {r.station_id for r in top.collect()} == {0, 3}
    sensors = spark.createDataFrame([(1, i, r["class"]) for i, r in out.items()], "fire_id long, station_id long, class string")

    def fire_class(*ids):
        return forensics.classify_fires(sensors, spark.createDataFrame([(1, i) for i in ids], "fire_id long, station_id long")).first()["class"]

    assert [fire_class(*i) for i in ((4,), (0, 1, 5), (0, 5), (3, 4), (3, 6))] == ["NO_MEASURABLE_RESPONSE", "MULTI_SENSOR_FIRE_RESPONSE", "NARROW_RESPONSE_ONLY", "SENSOR_ARTIFACT_LIKELY", "AMBIGUOUS"]


def test_coherence_finds_the_lag(spark):
    rng = random.Random(3)
    wave = {k: 10 + rng.random() * 20 for k in range(-60, 90)}
    series = {0: wave, 1: {k + 2: v for k, v in wave.items()}, 2: {k: 10 + rng.random() for k in range(-60, 90)}}
    fires, st, bins = sensors_around(spark, series, {0: 0.0, 1: 0.002, 2: 0.004})
    r = {x.station_id: x for x in forensics.coherence(controls.around(fires, st, CFG.km), bins, st, CFG).collect()}
    assert (r[0].best_neighbor, r[0].best_lag, r[0].neighbors) == (1, 2, 2) and r[0].best_r == pytest.approx(1.0) and (r[1].best_neighbor, r[1].best_lag) == (0, -2)


def test_forensics_of_empty_tables(spark):
    fires, st, bins = sensors_around(spark, {0: {}})
    none = bins.limit(0)
    shaped = forensics.shapes(forensics.responses(controls.around(fires, st, CFG.km), none, CFG), CFG)
    wind = shaped.select("fire_id", "station_id", F.lit(True).alias("plausible"))
    out = forensics.classify(shaped, forensics.bands(shaped, st, CFG), forensics.history(shaped, none, fires, CFG), forensics.faults(shaped, none, st, CFG), wind, CFG).collect()
    assert [(r["class"], r["shape"], r.clock, r.history) for r in out] == [("NO_SIGNIFICANT_RESPONSE", "NO_CLEAR_SPIKE", "UNAVAILABLE", "LIMITED_HISTORY")]
    assert forensics.responses(controls.around(fires.limit(0), st, 5.0), bins, CFG).count() == 0


def test_report_files(spark, tmp_path):
    """Context columns first, a banner line, and no file for numbers that are not finite."""
    from aerolith.sources import sinks

    df = spark.createDataFrame([(1, 2.5, "a,b", 0), (2, None, None, 0)], "id long, v double, s string, x int")
    sinks.write_report(df, str(tmp_path / "a"), ["s", "id", "v"], banner="diagnostic only", context={"zone": "core"})
    lines = next((tmp_path / "a").glob("part-*")).read_text().splitlines()
    assert lines == ["# diagnostic only", "zone,s,id,v", 'core,"a,b",1,2.5', "core,,2,"]
    sinks.write_report(df, str(tmp_path / "b"), ["id"], kind="json")
    assert spark.read.json(str(tmp_path / "b")).count() == 2
    with pytest.raises(Exception, match="not finite"):
        sinks.write_report(spark.createDataFrame([(float("nan"),)], "v double"), str(tmp_path / "c"), ["v"])
    assert not list(tmp_path.glob("c/part-*"))
