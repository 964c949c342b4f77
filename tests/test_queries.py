"""Every query that has SQL against DuckDB on the small tables, and the semantics that SQL can't state."""

import math
import os
import random

import duckdb
import pytest
from aerolith.config import AnomalyConfig, EventConfig
from aerolith.operators import anomaly, diagnostics, events, spatial, timeseries
from aerolith.plans import event_queries, views
from aerolith.plans.catalog import CATALOG
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SMALL}/{f}')")
    return c


def cells(row):
    return tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", [k for k, (_, sql) in CATALOG.items() if sql])
def test_query_equals_its_sql(spark, duck, name):
    run, sql = CATALOG[name]
    got = run(spark, SMALL)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = want.fetchall()
    assert sorted(map(cells, got.select(*[f"`{c}`" for c in names]).collect()), key=str) == sorted(map(cells, rows), key=str)


def plain_peaks(points, rise, least):
    """Accepted peaks of one series (bucket, value, base), one after the other."""
    kept = []
    for i, (t, v, base) in enumerate(points):
        beside = [points[j][1] for j in (i - 1, i + 1) if 0 <= j < len(points)]
        if v > base + rise and all(v >= x for x in beside) and (not kept or t - kept[-1] >= least):
            kept.append(t)
    return kept


def plain_shape(points, rise, step):
    high = [v > base + rise for _, v, base in points]
    runs, longest = 0, 0
    for i, (t, _, _) in enumerate(points):
        runs = (runs + 1 if i and high[i - 1] and t - points[i - 1][0] == step else 1) if high[i] else 0
        longest = max(longest, runs)
    n = len(plain_peaks(points, rise, 2 * step))
    shape = "NO_CLEAR_SPIKE" if not any(high) else "MULTI_PEAK" if n >= 2 else "SINGLE_BIN_SPIKE" if sum(high) == 1 else "SUSTAINED_RISE" if longest >= 3 else "SHORT_PULSE"
    return sum(high), n, longest, shape


def test_spike_shapes_against_a_plain_version(spark):
    """Random series with plateaus and missing bins: peaks count from the last accepted one."""
    rng = random.Random(4)
    series = {}
    for s in range(300):
        buckets = sorted(rng.sample(range(40), rng.randint(1, 14)) if s % 2 else range(rng.randint(1, 12)))
        series[s] = [(b * 180, float(rng.choice([1, 1, 1, 6, 6, 9, 20])), 2.0) for b in buckets]
    df = spark.createDataFrame([(s, *p) for s, ps in series.items() for p in ps], "station_id long, bucket long, value double, base double").repartition(5)
    got = {r.station_id: (r.elevated, r.peaks, r.longest, r["shape"]) for r in diagnostics.morphology(df).collect()}
    assert got == {s: plain_shape(ps, 3.0, 180) for s, ps in series.items()}
    assert len({x[3] for x in got.values()}) == 5


def test_spike_morphology_on_the_tables(spark, duck):
    rows = duck.execute("WITH " + views.SQL["obs"] + ", " + views.BINNED + " SELECT station_id, bucket, value, quantile_cont(value, 0.9) OVER (PARTITION BY station_id) FROM binned ORDER BY 1, 2").fetchall()
    series: dict = {}
    for s, *p in rows:
        series.setdefault(s, []).append(tuple(p))
    got = {r.station_id: (r.elevated, r.peaks, r.longest, r["shape"]) for r in CATALOG["spike_morphology"][0](spark, SMALL).collect()}
    assert got == {s: plain_shape(ps, 3.0, 21_600) for s, ps in series.items()}


def test_prior_peaks_on_the_tables(spark, duck):
    rows = duck.execute("WITH " + views.SQL["obs"] + ", " + views.BINNED + " SELECT station_id, bucket, value, quantile_cont(value, 0.7) OVER (PARTITION BY station_id) FROM binned ORDER BY 1, 2").fetchall()
    series: dict = {}
    for s, *p in rows:
        series.setdefault(s, []).append(tuple(p))
    want = []
    for s, points in series.items():
        kept = plain_peaks(points, 3.0, 43_200)
        want += [(s, t, sum(t - 7 * 86_400 <= k < t for k in kept), t - kept[i - 1] if i else None) for i, t in enumerate(kept)]
    assert sorted((r.station_id, r.bucket, r.prior, r.since) for r in CATALOG["prior_peaks"][0](spark, SMALL).collect()) == sorted(want) and len(want) > 50


def test_distances(spark):
    st = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0)], "station_id long, lat double, lon double")
    got = {(r.a, r.b): r.distance_km for r in spatial.neighbor_pairs(st, 112.0).collect()}
    assert set(got) == {(1, 2), (2, 1), (1, 3), (3, 1)} and all(abs(v - 111.195) < 0.2 for v in got.values())


def test_candidate_needs_support(spark):
    """Six stations on a line of 200 m steps, a jump at the third: a candidate only where neighbours rise too."""
    st = spark.createDataFrame([(k, 10.0 + 0.0018 * k, 20.0) for k in range(6)], "station_id long, lat double, lon double")

    def rows(beside):
        obs = [(k, b * 180, 12.0, b) for k in range(6) for b in range(15)] + [(k, 15 * 180, 52.0 if k == 2 else beside, 15) for k in range(6)]
        out = anomaly.anomaly_rows(spark.createDataFrame(obs, "station_id long, t long, value double, obs_id long"), st, AnomalyConfig())
        return out.where("station_id = 2 and bucket = 2700").first()

    alone, backed = rows(12.0), rows(24.0)
    assert not alone.is_candidate and alone.support_count == 0 and alone.z_s > 3
    assert backed.support_count == 5 and backed.smoothed == 32.0 and backed.is_candidate


def test_bins_take_no_unusable_observation(spark):
    flags = ["", None, "clock_ahead", "invalid_pm25", "x;future_timestamp_ahead_seconds=1.0", "invalid_timestamp"]
    rows = [(1, 10 + i, float(i), i, f) for i, f in enumerate(flags)] + [(2, 5, float("nan"), 1, ""), (2, 6, -1.0, 2, ""), (2, 7, float("inf"), 3, ""), (2, 8, None, 4, ""), (None, 9, 1.0, 5, ""), (3, None, 1.0, 6, ""), (4, 200, 0.0, 8, ""), (4, 200, 3.0, 7, "")]
    df = spark.createDataFrame(rows, "station_id long, t long, value double, obs_id long, quality_flags string")
    assert sorted((r.station_id, r.bucket, r.value) for r in timeseries.bin_last(df, 180).collect()) == [(1, 0, 2.0), (4, 180, 3.0)]


def test_rows_for_stations_without_a_value(spark):
    st = spark.createDataFrame([(k, 10.0, 20.0 + k) for k in range(3)], "station_id long, lat double, lon double")
    obs = spark.createDataFrame([(0, 0, 1.0, 1), (1, 0, 1.0, 2), (1, 180, 2.0, 3)], "station_id long, t long, value double, obs_id long")
    out = anomaly.with_absent(anomaly.anomaly_rows(obs, st, AnomalyConfig()), st).collect()
    assert sorted((r.bucket, r.station_id, r.status, r.flags) for r in out) == [(b, k, *(("usable", "") if (k, b) in ((0, 0), (1, 0), (1, 180)) else ("missing", "missing_current_value"))) for b in (0, 180) for k in range(3)]
    assert not any(r.is_candidate for r in out) and {r.temporal_status for r in out} == {"insufficient_history"}


def plain_events(bins, cfg):
    """Events over all clusters of all bins, written from the description: links, heirs, splits and merges one bin after the other."""
    def km(p, q):
        x = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(x)))

    events, owner = {}, {}
    for index in sorted(bins):
        touching = {}
        for c in bins[index]:
            for name, e in events.items():
                if e["into"] is None and index - e["at"] <= cfg.max_gap_bins + 1:
                    old = e["cluster"]
                    if set(old["who"]) & set(c["who"]) or km(old["mid"], c["mid"]) <= cfg.centroid_km or min(km(p, q) for p in old["who"].values() for q in c["who"].values()) <= cfg.member_km:
                        touching.setdefault(name, []).append(c)
        taken, split = {}, {}
        for name in sorted(touching):
            old = events[name]["cluster"]
            best = sorted(touching[name], key=lambda c: (-len(set(old["who"]) & set(c["who"])), km(old["mid"], c["mid"]), -c["strength"], c["id"]))[0]
            taken.setdefault(best["id"], []).append(name)
            for c in touching[name]:
                if c is not best:
                    split[c["id"]] = name
        for c in bins[index]:
            names = taken.get(c["id"], [])
            first = min(names) if names else (index * cfg.bin_seconds, c["id"])
            for name in names:
                if name != first:
                    events[name]["into"] = first
            if not names:
                events[first] = {"into": None, "from": split.get(c["id"])}
            events[first] |= {"cluster": c, "at": index}
            owner[index, c["id"]] = first
    return {k: (v, events[v]["into"], events[v]["from"]) for k, v in owner.items()}


@pytest.mark.parametrize("seed", range(6))
def test_events_against_a_plain_version(spark, seed):
    """Clusters that wander, meet, part and pause: many families, gaps, splits and merges."""
    rng, cfg = random.Random(seed), EventConfig()
    bins: dict = {}
    for walk in range(12):
        lat, lon = 10 + rng.random() * (0.08 if walk < 6 else 2), 20 + rng.random() * 0.08
        for index in range(30):
            lat, lon = lat + rng.gauss(0, 0.004), lon + rng.gauss(0, 0.004)
            if rng.random() < 0.7:
                first = 100 * walk + index
                who = {first + 10_000 * k if rng.random() < 0.5 else 500 + walk: (lat + rng.gauss(0, 0.003), lon + rng.gauss(0, 0.003)) for k in range(rng.randint(1, 4))}
                mid = tuple(sum(p[j] for p in who.values()) / len(who) for j in (0, 1))
                bins.setdefault(index, []).append({"id": min(who), "who": who, "mid": mid, "strength": round(rng.random(), 2)})
    for cs in bins.values():
        cs[:] = sorted({c["id"]: c for c in cs}.values(), key=lambda c: c["id"])
    rows = [(i * 180, c["id"], sorted(c["who"]), [(s, *c["who"][s]) for s in sorted(c["who"])], *c["mid"], c["strength"], True) for i, cs in bins.items() for c in cs]
    rows += [(180 * i, 999_999, [500], [(500, 10.0, 20.0)], 10.0, 20.0, 0.9, False) for i in range(0, 30, 3)]
    df = spark.createDataFrame(rows, "bucket long, cluster_station long, members array<long>, points array<struct<station_id:long,lat:double,lon:double>>, lat double, lon double, strength double, eligible boolean")
    name = lambda k: k and f"evt-{k[0]:012d}-{k[1]:06d}"
    got = {(r.bucket // 180, r.cluster_station): (r.event_id, r.merged_into, r.split_from) for r in events.link_events(df, cfg).collect()}
    want = {k: tuple(map(name, v)) for k, v in plain_events(bins, cfg).items()}
    assert got == want
    assert {v[1] is None for v in got.values()} == {True, False} and {v[2] is None for v in got.values()} == {True, False}


def test_event_status(spark):
    """One event of each kind, at a table whose last bin is 10."""
    cfg = EventConfig()
    step, shape = cfg.bin_seconds, "event_id string, bucket long, cluster_station long, merged_into string, split_from string"
    runs = {"a": ([9, 10], 2, 0.9, None), "b": ([3, 4], 2, 0.9, None), "c": ([10], 2, 0.9, None), "d": ([2], 2, 0.9, None), "e": ([2, 4], 2, 0.2, None), "f": ([5, 6], 1, 0.3, None), "g": ([1], 3, 0.9, "a")}
    linked = spark.createDataFrame([(k, b * step, i, m, None) for i, (k, (bs, _, _, m)) in enumerate(runs.items()) for b in bs], shape)
    stats = spark.createDataFrame([(b * step, i, [i, i + 100][:n], n, 1, s, 1.0, 1.0, 1.0) for i, (bs, n, s, _) in enumerate(runs.values()) for b in bs], "bucket long, cluster_station long, members array<long>, member_count long, seed_count long, strength double, max_score double, peak_value double, mean_te double")
    out = {r.event_id: (r.status, r.gap_bins, r.sensors) for r in events.event_summary(linked, stats, cfg, spark.createDataFrame([(10 * step,)], "final_bucket long")).collect()}
    assert out == {"a": ("active", 0, 2), "b": ("ended", 0, 2), "c": ("emerging", 0, 2), "d": ("transient", 0, 2), "e": ("weak", 1, 2), "f": ("isolated", 0, 1), "g": ("ended", 0, 2)}


def test_event_queries_on_the_tables(spark, sf_dir):
    """The registered queries against the plain version, over the clusters that the tables give."""
    stats = event_queries.events.cluster_stats(event_queries.clusters(spark, sf_dir)).where("eligible").collect()
    bins: dict = {}
    for r in sorted(stats, key=lambda r: (r.bucket, r.cluster_station)):
        bins.setdefault(r.bucket // 21_600, []).append({"id": r.cluster_station, "who": {p.station_id: (p.lat, p.lon) for p in r.points}, "mid": (r.lat, r.lon), "strength": r.strength})
    want = plain_events(bins, event_queries.EVENTS)
    name = lambda k: k and f"evt-{k[0]:012d}-{k[1]:06d}"
    member = sorted((name(want[i, c["id"]][0]), i * 21_600, s) for i, cs in bins.items() for c in cs for s in c["who"])
    assert sorted(tuple(r) for r in CATALOG["event_membership"][0](spark, sf_dir).collect()) == member and member
    life = {r.event_id: (r.merged_into, r.split_from, r.bins_seen) for r in CATALOG["event_lifecycle"][0](spark, sf_dir).collect()}
    names = [v[0] for v in want.values()]
    assert life == {name(v[0]): (name(v[1]), name(v[2]), names.count(v[0])) for v in want.values()}


def test_as_of_takes_the_latest_within_tolerance(spark):
    left = spark.createDataFrame([("k", 100, 1), ("k", 500, 2), ("z", 5, 3)], "key string, t long, id int")
    right = spark.createDataFrame([("k", 100, 1.0), ("k", 90, 2.0), ("k", 101, 3.0)], "key string, rt long, v double")
    out = {r.id: (r.matched_rt, r.matched_v) for r in timeseries.as_of(left, right, ["key"], "t", "rt", ["v"], 50).collect()}
    assert out == {1: (100, 1.0), 2: (None, None), 3: (None, None)}


def test_empty_tables(spark):
    obs = spark.createDataFrame([], "station_id long, t long, value double, obs_id long")
    st = spark.createDataFrame([], "station_id long, lat double, lon double")
    assert anomaly.anomaly_rows(obs, st, AnomalyConfig()).count() == 0


def test_stream_insert_is_idempotent(spark, tmp_path):
    from aerolith.streaming.ingest import read_stream, write_facts

    rows = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, v double")
    rows.write.parquet(str(tmp_path / "in"))
    for run in (1, 2):
        write_facts(read_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / f"cp{run}"), ["id"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count("id"), F.countDistinct("id")).first() == (20, 20)


def test_readers_and_sinks(spark, tmp_path):
    from aerolith.sources import readers, sinks

    raw = spark.createDataFrame([("2026-09-03", "5", "high", 1.0), ("2026-09-03", "1230", "77", 2.0), ("bad", "x", None, 3.0)], "acq_date string, acq_time string, confidence string, frp double")
    for kind in ("parquet", "orc", "csv", "json"):
        sinks.write(raw, str(tmp_path / kind), kind)
        back = readers.read(spark, str(tmp_path / kind), kind, raw.schema.simpleString()[7:-1].replace(":", " "))
        out = {r.frp: (str(r.acquired_at), r.confidence_share) for r in readers.fires(back).collect()}
        assert out == {1.0: ("2026-09-03 00:05:00", 1.0), 2.0: ("2026-09-03 12:30:00", 0.77), 3.0: ("None", 0.5)}


def test_weather_documents(spark):
    from aerolith.sources import readers

    doc = """{"records": {"Station": [
        {"StationId": "A", "StationName": "a", "ObsTime": {"DateTime": "2026-03-01T08:00:00+08:00"}, "GeoInfo": {"Coordinates": [{"CoordinateName": "TWD67", "StationLatitude": "1", "StationLongitude": "2"}, {"CoordinateName": " wgs84", "StationLatitude": "24.5", "StationLongitude": "121.0"}]}, "WeatherElement": {"WindDirection": "90", "WindSpeed": "2.0"}},
        {"StationId": "B", "ObsTime": {}, "GeoInfo": {"Coordinates": []}, "WeatherElement": {"WindDirection": "990", "WindSpeed": "-99"}}]}}"""
    a, b = readers.weather(spark.createDataFrame([(doc,), ("{}",), (None,)], "value string")).orderBy("station_id").collect()
    assert (a.lat, a.lon, a.t, a.wind_status, round(a.u, 9), round(a.v, 9), a.quality_flags) == (24.5, 121.0, 1_772_323_200, "valid", -2.0, 0.0, "")
    assert (b.lat, b.t, b.wind_status, b.quality_flags) == (None, None, "invalid", "invalid_wgs84_coordinate;invalid_observation_timestamp;invalid_wind")


def test_thing_documents(spark):
    from aerolith.sources import readers

    doc = '{"@iot.id": 7, "name": "n", "Locations": [{"location": %s}], "Datastreams": [{"@iot.id": 1, "name": "PM2.5"}, {"@iot.id": 2, "name": "T"}]}'
    rows = [(doc % x,) for x in ('{"type": "Point", "coordinates": [121.5, 25.0]}', "[121.5, 25.0]", '"121.5 25.0"', '"nowhere"')]
    got = readers.things(spark.createDataFrame(rows, "value string")).collect()
    assert len(got) == 8 and [(r.lat, r.lon) for r in got[::2]] == [(25.0, 121.5)] * 3 + [(None, None)] and {r.thing_id for r in got} == {"7"}


def test_runs_and_snapshots(spark, tmp_path):
    from aerolith.sources import sinks

    name = sinks.run_id("2026-03-01T00:00:00Z", "2026-03-02T00:00:00Z", "core")
    assert name == sinks.run_id("2026-03-01T00:00:00Z", "2026-03-02T00:00:00Z", "core") != sinks.run_id("2026-03-01T00:00:00Z", "2026-03-02T00:00:00Z", "wide")
    sinks.write_run(spark, str(tmp_path / "runs"), name, {"good": lambda: spark.range(3), "bad": lambda: spark.range(1).selectExpr("raise_error('no')"), "after": lambda: spark.range(1)})
    assert [(r.run, r.stage, r.status, r.rows) for r in sinks.runs(spark, str(tmp_path / "runs"), str(tmp_path / "r*")).collect()] == [(name, "after", "ok", 1), (name, "bad", "failed", None), (name, "good", "ok", 3)]
    raw = spark.createDataFrame([("2026-03-01 10:00:00", 1), ("2026-03-02 10:00:00", 2)], "ingested_at string, v int").withColumn("ingested_at", F.to_timestamp("ingested_at"))
    for _ in range(2):
        sinks.snapshot(raw, str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).groupBy("dt").count().orderBy("dt").collect()[0]["count"] == 2


def test_distance_join_against_all_pairs(spark):
    """Random places up to 60 degrees, some at the date line; a place beyond is an error."""
    rng = random.Random(6)
    places = [(i, rng.uniform(-60, 60) if i % 3 else rng.uniform(-1, 1), rng.choice([179.99, -179.99, 0.0]) + rng.uniform(-0.009, 0.009)) for i in range(300)] + [(300, None, 1.0)]

    def km(p, q):
        x = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(x)))

    for limit in (0.5, 40.0, 6000.0):
        a = spark.createDataFrame(places, "a long, a_lat double, a_lon double")
        b = spark.createDataFrame(places, "b long, b_lat double, b_lon double")
        got = sorted((r.a, r.b) for r in spatial.distance_join(a, b, limit).collect())
        assert got == sorted((p[0], q[0]) for p in places[:300] for q in places[:300] if km(p, q) <= limit)
    far = spark.createDataFrame([(1, 70.0, 0.0)], "a long, a_lat double, a_lon double")
    with pytest.raises(Exception, match="beyond 60"):
        spatial.distance_join(far, b, 1.0).collect()
