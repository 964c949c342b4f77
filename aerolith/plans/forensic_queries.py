"""Queries of the forensics of sensors near fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COARSE
from ..operators import anomaly, controls, diagnostics, forensics, timeseries
from . import views
from .control_queries import BURNS, STEP
from .state_queries import windy_fires
from .views import ANOMALY, BINNED, hav, with_

DAY = 86_400
#: Windows and distances as wide as the tables' bins and stations need.
CFG = forensics.ForensicsConfig(step=STEP, before=2 * DAY, after=DAY, km=3.0, bands=(0.0, 0.5, 1.0, 1.5, 3.0), history_span=10 * DAY)


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _bins(spark, d):
    return timeseries.bin_last(views.obs(spark, d), STEP).select("station_id", "bucket", "t", "value", (F.col("t") + ((F.col("obs_id") * 7) % 41 - 10) * 60).alias("received"))


def _fires(spark, d):
    return views.fires(spark, d).select("fire_id", F.col("t").alias("start"), (F.col("t") + BURNS).alias("end"), "lat", "lon")


def _near(spark, d):
    return controls.around(_fires(spark, d), views.stations(spark), CFG.km)


def _alike(spark, d):
    return forensics.alike(_near(spark, d), CFG)


def _shaped(spark, d, near):
    return forensics.shapes(forensics.responses(near, _bins(spark, d), CFG), CFG)


SHAPE = ["peak_bucket", "peak_t", "over_3", "over_5", "over_10", "longest", "peaks", "shape"]
LEVELS = ["baseline", "peak", "excess", "rise_rate", "fall_rate"]


def sensor_shapes(spark, d):
    """The response of every sensor near every fire, and its shape."""
    near, same = _alike(spark, d)
    return forensics.each_fire(_shaped(spark, d, near).select("fire_id", "station_id", *SHAPE, *_r(*LEVELS)), same)


BAND = ["sensors", "usable", "over_3", "over_5", "over_10", "within_2", "within_4", "corroborating"]


def sensor_bands(spark, d):
    """The neighbours of every responding sensor, by distance."""
    near, same = _alike(spark, d)
    found = forensics.responses(near, _bins(spark, d), CFG)
    return forensics.each_fire(forensics.bands(found, views.stations(spark), CFG).select("fire_id", "station_id", "band", *BAND, *_r("baseline", "peak", "max_median")), same)


def sensor_coherence(spark, d):
    """The neighbour whose series goes best with a sensor's around a fire."""
    near, same = _alike(spark, d)
    return forensics.each_fire(forensics.coherence(near, _bins(spark, d), views.stations(spark), CFG).select("fire_id", "station_id", "neighbors", "best_neighbor", "best_lag", "best_r"), same)


PRIOR = ["history_bins", "prior_10", "prior_20", "prior_30", "prior_similar", "interval", "history"]


def sensor_history(spark, d):
    """Earlier spikes of every responding sensor."""
    near, same = _alike(spark, d)
    found = forensics.responses(near, _bins(spark, d), CFG)
    return forensics.each_fire(forensics.history(found, _bins(spark, d), _fires(spark, d), CFG).select("fire_id", "station_id", *PRIOR, *_r("prior_base", "max_prior", "interval_share")), same)


def _plausible(spark, d):
    """Downwind by the fire's own wind, which every third fire has too poor."""
    near = _near(spark, d).select("fire_id", "station_id").join(windy_fires(spark, d).drop("frp"), "fire_id").join(views.stations(spark), "station_id")
    return diagnostics.wind_relation(near).select("fire_id", "station_id", ((F.col("relation") == "downwind") & (F.col("fire_id") % 3 != 0)).alias("plausible"))


def _sensors(spark, d, shaped):
    bins, st = _bins(spark, d), views.stations(spark)
    prior = forensics.history(shaped, bins, _fires(spark, d), CFG)
    return forensics.classify(shaped, forensics.bands(shaped, st, CFG), prior, forensics.faults(shaped, bins, st, CFG, "received"), _plausible(spark, d), CFG)


SENSOR = ["shape", "corroborating", "prior_similar", "history", "seen", "missing", "clock", "gaps", "jumps", "plausible", "class"]


def sensor_forensics(spark, d):
    """One row a fire and sensor near it: what was found, and its class."""
    return _sensors(spark, d, _shaped(spark, d, _near(spark, d))).select("fire_id", "station_id", *SENSOR, *_r("excess", "cadence"))


def fire_forensics(spark, d):
    """Every fire's class by the sensors that responded most."""
    shaped = _shaped(spark, d, _near(spark, d))
    top = forensics.top_sensors(shaped, anomaly.anomaly_rows(views.obs(spark, d), views.stations(spark), COARSE), CFG)
    return forensics.classify_fires(_sensors(spark, d, shaped), top)


_NEAR = f"""burn AS (SELECT fire_id, t AS s, t + {BURNS} AS e, lat, lon, frp FROM fire),
nr AS (SELECT fire_id, s, e, station_id, d FROM (SELECT f.fire_id, f.s, f.e, x.station_id, {hav('f', 'x')} AS d FROM burn f, station x) WHERE d <= {CFG.km}),
b AS (SELECT station_id, bucket, t, value, t + ((obs_id * 7) % 41 - 10) * 60 AS received FROM binned)"""
_RESP = f"""w AS (SELECT fire_id, station_id, s, bucket, t, value FROM nr JOIN b USING (station_id) WHERE bucket >= s - {CFG.before} AND bucket < e + {CFG.after}),
rs0 AS (SELECT fire_id, station_id, quantile_cont(value, 0.5) FILTER (WHERE bucket < s) AS baseline, max(value) FILTER (WHERE bucket >= s) AS peak, arg_max(bucket, (value, -bucket)) FILTER (WHERE bucket >= s) AS peak_bucket,
    arg_max(t, (value, -bucket)) FILTER (WHERE bucket >= s) AS peak_t FROM w GROUP BY 1, 2),
rs AS (SELECT nr.fire_id, nr.station_id, s, e, baseline, peak, peak_bucket, peak_t, peak - baseline AS excess FROM nr LEFT JOIN rs0 ON rs0.fire_id = nr.fire_id AND rs0.station_id = nr.station_id),
sx AS (SELECT w.fire_id, w.station_id, bucket, t, value, baseline FROM w JOIN rs USING (fire_id, station_id) WHERE bucket >= w.s)"""
_SHAPE = f"""s1 AS (SELECT *, coalesce(value > baseline + 3, false) AS hi, lag(bucket) OVER o AS lb, coalesce(lag(value) OVER o > baseline + 3, false) AS lh, lag(value) OVER o AS lv, lead(value) OVER o AS nv, lead(t) OVER o AS nt FROM sx WINDOW o AS (PARTITION BY fire_id, station_id ORDER BY bucket)),
s2 AS (SELECT *, sum(CASE WHEN lh AND bucket - lb = {STEP} THEN 0 ELSE 1 END) OVER o AS run, hi AND value >= coalesce(lv, value) AND value >= coalesce(nv, value) AS top, (nt - t) / 60 AS m, nv - value AS dv FROM s1 WINDOW o AS (PARTITION BY fire_id, station_id ORDER BY bucket)),
s3 AS (SELECT fire_id, station_id, run, count(*) FILTER (WHERE hi) AS n FROM s2 GROUP BY 1, 2, 3), s4 AS (SELECT fire_id, station_id, max(n) AS longest FROM s3 GROUP BY 1, 2),
s5 AS (SELECT fire_id, station_id, count(*) FILTER (WHERE hi) AS over_3, count(*) FILTER (WHERE value > baseline + 5) AS over_5, count(*) FILTER (WHERE value > baseline + 10) AS over_10,
    coalesce(list_reduce(list([1, bucket] ORDER BY bucket) FILTER (WHERE top), lambda a, x: CASE WHEN x[2] - a[2] >= {2 * STEP} THEN [a[1] + 1, x[2]] ELSE a END)[1], 0) AS peaks,
    max(dv / m) FILTER (WHERE m > 0 AND m <= {STEP / 20} AND dv >= 0) AS rise_rate, min(dv / m) FILTER (WHERE m > 0 AND m <= {STEP / 20} AND dv < 0) AS fall_rate FROM s2 GROUP BY 1, 2),
sh0 AS (SELECT rs.*, coalesce(over_3, 0) AS over_3, coalesce(over_5, 0) AS over_5, coalesce(over_10, 0) AS over_10, coalesce(longest, 0) AS longest, coalesce(peaks, 0) AS peaks, rise_rate, fall_rate FROM rs LEFT JOIN s5 USING (fire_id, station_id) LEFT JOIN s4 USING (fire_id, station_id)),
sh AS (SELECT *, CASE WHEN baseline IS NULL OR over_3 = 0 THEN 'NO_CLEAR_SPIKE' WHEN peaks >= 2 THEN 'MULTI_PEAK' WHEN over_3 = 1 THEN 'SINGLE_BIN_SPIKE' WHEN longest >= 3 THEN 'SUSTAINED_RISE' ELSE 'SHORT_PULSE' END AS shape FROM sh0)"""
_BANDS = f"""bp AS (SELECT * FROM (SELECT a.station_id AS a, b.station_id AS b, {hav('a', 'b')} AS d FROM station a, station b WHERE a.station_id <> b.station_id) WHERE d <= {CFG.bands[-1]}),
bd AS (SELECT a, b, CASE WHEN d <= {CFG.bands[1]} THEN 'band_1' WHEN d < {CFG.bands[2]} THEN 'band_2' WHEN d < {CFG.bands[3]} THEN 'band_3' ELSE 'band_4' END AS band FROM bp),
bo AS (SELECT x.fire_id, x.station_id, band, y.station_id AS b, y.baseline, y.peak, y.excess, abs(y.peak_t - x.peak_t) AS off FROM rs x JOIN bd ON bd.a = x.station_id JOIN rs y ON y.fire_id = x.fire_id AND y.station_id = bd.b),
bc AS (SELECT fire_id, station_id, band, count(*) AS sensors, count(excess) AS usable, count(*) FILTER (WHERE excess > 3) AS over_3, count(*) FILTER (WHERE excess > 5) AS over_5, count(*) FILTER (WHERE excess > 10) AS over_10,
    count(*) FILTER (WHERE excess IS NOT NULL AND off <= {2 * STEP}) AS within_2, count(*) FILTER (WHERE excess IS NOT NULL AND off <= {4 * STEP}) AS within_4, count(*) FILTER (WHERE excess > 3 AND off <= {4 * STEP}) AS corroborating,
    quantile_cont(baseline, 0.5) FILTER (WHERE excess IS NOT NULL) AS baseline, quantile_cont(peak, 0.5) FILTER (WHERE excess IS NOT NULL) AS peak FROM bo GROUP BY 1, 2, 3),
bm AS (SELECT fire_id, station_id, band, max(m) AS max_median FROM (SELECT bo.fire_id, bo.station_id, band, bucket, quantile_cont(value - bo.baseline, 0.5) AS m FROM bo JOIN sx ON sx.fire_id = bo.fire_id AND sx.station_id = bo.b WHERE excess IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""
_COHERE = f"""cw AS (SELECT fire_id, station_id, s, e, bucket, value FROM nr JOIN b USING (station_id)),
cb AS (SELECT DISTINCT fire_id, station_id FROM cw WHERE bucket >= s - {2 * CFG.before} AND bucket < s - {CFG.before}), co AS (SELECT cw.* FROM cw JOIN cb USING (fire_id, station_id)),
cr AS (SELECT x.fire_id, x.station_id AS a, y.station_id AS b, lag, count(*) AS n, round(corr(x.value, y.value), 6) AS r FROM co x JOIN bp ON bp.a = x.station_id JOIN co y ON y.fire_id = x.fire_id AND y.station_id = bp.b, range({-CFG.lags}, {CFG.lags + 1}) l(lag)
    WHERE y.bucket = x.bucket + lag * {STEP} AND x.bucket >= (x.s - {2 * CFG.before}) - (x.s - {2 * CFG.before}) % {STEP} AND x.bucket <= (x.e + {2 * CFG.before}) - (x.e + {2 * CFG.before}) % {STEP} GROUP BY 1, 2, 3, 4),
cm AS (SELECT fire_id, a, b, max((r, -lag)) AS m FROM cr WHERE n >= 5 AND r IS NOT NULL AND NOT isnan(r) GROUP BY 1, 2, 3)"""
_HISTORY = f"""hf AS (SELECT station_id, bucket, value FROM b WHERE NOT EXISTS (SELECT 1 FROM burn WHERE bucket >= s AND bucket < e)),
hn AS (SELECT *, CASE WHEN bucket - lag(bucket) OVER o = {STEP} THEN lag(value) OVER o END AS bv, CASE WHEN lead(bucket) OVER o - bucket = {STEP} THEN lead(value) OVER o END AS av FROM hf WINDOW o AS (PARTITION BY station_id ORDER BY bucket)),
hr AS (SELECT fire_id, station_id, s, bucket, value, bv, CASE WHEN bucket + {STEP} < s THEN av END AS av, greatest(coalesce(excess, 0), 3) AS sim FROM rs JOIN hn USING (station_id) WHERE bucket < s),
hb AS (SELECT fire_id, station_id, count(*) AS history_bins, quantile_cont(value, 0.5) AS prior_base, max(bucket) - min(bucket) AS span FROM hr GROUP BY 1, 2),
hs AS (SELECT hr.*, prior_base, {', '.join(f"value > prior_base + {p} AND NOT coalesce(bv > prior_base + {p}, false) AND NOT coalesce(av > prior_base + {p}, false) AS x{i}" for i, p in enumerate(['10', '20', '30', 'sim']))} FROM hr JOIN hb USING (fire_id, station_id)),
hc AS (SELECT fire_id, station_id, count(*) FILTER (WHERE x0) AS prior_10, count(*) FILTER (WHERE x1) AS prior_20, count(*) FILTER (WHERE x2) AS prior_30, count(*) FILTER (WHERE x3) AS prior_similar, max(value - prior_base) AS max_prior FROM hs GROUP BY 1, 2),
hg AS (SELECT fire_id, station_id, (bucket - lag(bucket) OVER (PARTITION BY fire_id, station_id ORDER BY bucket)) // {STEP} AS gap FROM hs WHERE x3),
hi AS (SELECT fire_id, station_id, arg_max(gap, (n, -gap)) AS "interval", max(n) / sum(n) AS interval_share FROM (SELECT fire_id, station_id, gap, count(*) AS n FROM hg WHERE gap IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
hy AS (SELECT *, CASE WHEN history_bins >= {CFG.history_bins} AND span >= {CFG.history_span} THEN 'SUFFICIENT_HISTORY' ELSE 'LIMITED_HISTORY' END AS history FROM hb JOIN hc USING (fire_id, station_id) LEFT JOIN hi USING (fire_id, station_id))"""
_BRG = "((degrees(atan2(sin(radians(x.lon - f.lon)) * cos(radians(x.lat)), cos(radians(f.lat)) * sin(radians(x.lat)) - sin(radians(f.lat)) * cos(radians(x.lat)) * cos(radians(x.lon - f.lon)))) % 360) + 360) % 360"
_CLASS = f"""fs AS (SELECT station_id, quantile_cont(g, 0.5) AS cadence, count(*) FILTER (WHERE g > {STEP / 20}) AS gaps, count(*) FILTER (WHERE j > 50) AS jumps FROM (SELECT station_id, (bucket - lag(bucket) OVER o) / 60 AS g, abs(value - lag(value) OVER o) AS j FROM b WINDOW o AS (PARTITION BY station_id ORDER BY bucket)) GROUP BY 1),
fn AS (SELECT x.fire_id, x.station_id, count(b.value) AS seen, count(*) FILTER (WHERE b.value IS NULL) AS missing FROM rs x JOIN bp ON bp.a = x.station_id JOIN nr y ON y.fire_id = x.fire_id AND y.station_id = bp.b LEFT JOIN b ON b.station_id = bp.b AND b.bucket = x.peak_bucket WHERE x.peak_bucket IS NOT NULL GROUP BY 1, 2),
wd AS (SELECT nr.fire_id, nr.station_id, coalesce(f.fire_id % 10 <> 0 AND f.fire_id % 3 <> 0 AND least(({_BRG} - ((f.fire_id * 47) % 360) + 720) % 360, 360 - ({_BRG} - ((f.fire_id * 47) % 360) + 720) % 360) <= 45, false) AS plausible FROM nr JOIN burn f ON f.fire_id = nr.fire_id JOIN station x ON x.station_id = nr.station_id),
cc AS (SELECT fire_id, station_id, sum(corroborating) AS corroborating FROM bc WHERE band IN ('band_2', 'band_3') GROUP BY 1, 2),
fo0 AS (SELECT sh.*, CAST(coalesce(corroborating, 0) AS BIGINT) AS corroborating, coalesce(prior_similar, 0) AS prior_similar, coalesce(history, 'LIMITED_HISTORY') AS history, coalesce(seen, 0) AS seen, coalesce(missing, 0) AS missing, cadence, coalesce(gaps, 0) AS gaps, coalesce(jumps, 0) AS jumps, coalesce(plausible, false) AS plausible,
    CASE WHEN b.received IS NULL THEN 'UNAVAILABLE' WHEN (b.received - b.t) / 60 < -5 THEN 'CLOCK_AHEAD' WHEN (b.received - b.t) / 60 > 15 THEN 'STALE_INGESTION' ELSE 'NORMAL_OR_UNKNOWN' END AS clock
    FROM sh LEFT JOIN cc USING (fire_id, station_id) LEFT JOIN hy USING (fire_id, station_id) LEFT JOIN fn USING (fire_id, station_id) LEFT JOIN fs USING (station_id) LEFT JOIN wd USING (fire_id, station_id) LEFT JOIN b ON b.station_id = sh.station_id AND b.bucket = sh.peak_bucket),
fo AS (SELECT *, CASE WHEN excess IS NULL OR excess < 3 THEN 'NO_SIGNIFICANT_RESPONSE' WHEN corroborating >= 2 THEN 'COHERENT_LOCAL_RESPONSE' WHEN excess >= 10 AND shape IN ('SUSTAINED_RISE', 'MULTI_PEAK') AND plausible THEN 'NARROW_POSSIBLE_PLUME'
    WHEN shape IN ('SINGLE_BIN_SPIKE', 'SHORT_PULSE') AND (prior_similar > 0 OR seen = 0 OR jumps > 0) THEN 'ISOLATED_SENSOR_SPIKE' ELSE 'AMBIGUOUS' END AS class FROM fo0)"""
_TOP = """tr AS (SELECT fire_id, nr.station_id, anomaly_score, z_t, z_s FROM nr JOIN an ON an.station_id = nr.station_id WHERE bucket >= s AND bucket < e),
tp AS (SELECT fire_id, arg_max(station_id, (excess, -station_id)) AS station_id FROM rs WHERE excess IS NOT NULL GROUP BY 1 UNION SELECT fire_id, arg_max(station_id, (anomaly_score, -station_id)) FROM tr WHERE anomaly_score IS NOT NULL GROUP BY 1
    UNION SELECT fire_id, arg_max(station_id, (z_t, -station_id)) FROM tr WHERE z_t IS NOT NULL GROUP BY 1 UNION SELECT fire_id, arg_max(station_id, (z_s, -station_id)) FROM tr WHERE z_s IS NOT NULL GROUP BY 1),
tc AS (SELECT fire_id, count(*) AS sensors, count(*) FILTER (WHERE class <> 'NO_SIGNIFICANT_RESPONSE') AS significant, count(*) FILTER (WHERE class = 'COHERENT_LOCAL_RESPONSE') AS c, count(*) FILTER (WHERE class = 'NARROW_POSSIBLE_PLUME') AS p, count(*) FILTER (WHERE class = 'ISOLATED_SENSOR_SPIKE') AS i FROM fo JOIN tp USING (fire_id, station_id) GROUP BY 1)"""
_BASE = with_("obs", "station", "fire", BINNED, _NEAR, _RESP)


def _sr(*names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


QUERIES = {
    "sensor_shapes": (sensor_shapes, f"{_BASE}, {_SHAPE} SELECT fire_id, station_id, {', '.join(SHAPE)}, {_sr(*LEVELS)} FROM sh"),
    "sensor_bands": (sensor_bands, f"{_BASE}, {_BANDS} SELECT fire_id, station_id, band, {', '.join(BAND)}, {_sr('baseline', 'peak', 'max_median')} FROM bc LEFT JOIN bm USING (fire_id, station_id, band)"),
    "sensor_coherence": (sensor_coherence, f"{_BASE}, {_BANDS.split(',' + chr(10))[0]}, {_COHERE} SELECT fire_id, a AS station_id, count(*) AS neighbors, arg_max(b, (m[1], -b, m[2])) AS best_neighbor, -arg_max(m[2], (m[1], -b, m[2])) AS best_lag, max(m[1]) AS best_r FROM cm GROUP BY 1, 2"),
    "sensor_history": (sensor_history, f"{_BASE}, {_HISTORY} SELECT fire_id, station_id, {', '.join(PRIOR).replace('interval', chr(34) + 'interval' + chr(34))}, {_sr('prior_base', 'max_prior', 'interval_share')} FROM hy"),
    "sensor_forensics": (sensor_forensics, f"{_BASE}, {_SHAPE}, {_BANDS}, {_HISTORY}, {_CLASS} SELECT fire_id, station_id, {', '.join(SENSOR)}, {_sr('excess', 'cadence')} FROM fo"),
    "fire_forensics": (fire_forensics, f"{_BASE}, {ANOMALY}, {_SHAPE}, {_BANDS}, {_HISTORY}, {_CLASS}, {_TOP} SELECT fire_id, sensors, significant, CASE WHEN significant = 0 THEN 'NO_MEASURABLE_RESPONSE' WHEN c >= 2 THEN 'MULTI_SENSOR_FIRE_RESPONSE' WHEN p > 0 THEN 'NARROW_RESPONSE_ONLY' WHEN i = significant THEN 'SENSOR_ARTIFACT_LIKELY' ELSE 'AMBIGUOUS' END AS class FROM tc"),
}
