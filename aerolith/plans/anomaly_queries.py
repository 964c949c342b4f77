"""Queries of the binning, baseline and anomaly operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import COARSE
from ..functions.robust import stats_by
from ..operators import anomaly, spatial, timeseries
from . import views
from .views import ANOMALY, BINNED, hav, with_


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def smoothed_bins(spark, d):
    return timeseries.smooth(timeseries.bin_last(views.obs(spark, d), COARSE.bin_seconds), COARSE.bin_seconds)


def _rows(spark, d):
    return anomaly.anomaly_rows(views.obs(spark, d), views.stations(spark), COARSE)


def bin_last_value(spark, d):
    return timeseries.bin_last(views.obs(spark, d), 21_600).select("station_id", "bucket", "obs_id", "t", "value")


def bin_smooth(spark, d):
    return smoothed_bins(spark, d).select("station_id", "bucket", *_r("smoothed"))


def temporal_baseline(spark, d):
    return timeseries.temporal_baseline(smoothed_bins(spark, d), COARSE).select("station_id", "bucket", "history_count", *_r("t_median", "t_mad", "temporal_excess", "z_t"), "temporal_status")


def neighbor_pairs(spark, d):
    return spatial.neighbor_pairs(views.monitors(spark, d), 4.5).select("a", "b", *_r("distance_km"))


COLUMNS = ["station_id", "bucket", "obs_id", "value", "history_count", "temporal_status", "neighbor_count", "radius_km", "support_count", "spatial_status", "anomaly_score", "is_candidate", "is_isolated"]
ROUNDED = ["smoothed", "t_median", "t_mad", "temporal_excess", "z_t", "s_median", "s_mad", "spatial_excess", "z_s", "support_fraction"]


def anomaly_rows(spark, d):
    return _rows(spark, d).select(*COLUMNS, *_r(*ROUNDED))


def anomaly_candidates_topk(spark, d):
    return _rows(spark, d).where("is_candidate").orderBy(F.desc("anomaly_score"), "station_id", "bucket").limit(15).select("station_id", "bucket", "anomaly_score")


def anomaly_isolated(spark, d):
    return _rows(spark, d).where("is_isolated").select("station_id", "bucket", *_r("temporal_excess", "z_t"))


def anomaly_absent(spark, d):
    """Every station in every bin, those without a usable value included, in order of score: a missing score and zero come after all others."""
    out = anomaly.with_absent(_rows(spark, d), views.stations(spark))
    place = Window.partitionBy("bucket").orderBy(F.desc(F.coalesce(F.when(F.col("anomaly_score") != 0, F.round("anomaly_score", 5)), F.lit(-1.0))), "station_id")
    return out.withColumn("place", F.row_number().over(place)).select("bucket", "station_id", "place", "status", "flags", "temporal_status", "spatial_status", "history_count", "neighbor_count", "is_candidate")


#: South, west, north, east of what a report looks at, and of its core; days that it looks back.
CONTEXT, CORE, LOOKBACK = (25.0, 121.41, 25.12, 121.52), (25.03, 121.43, 25.09, 121.49), 10 * 86_400


def _report(spark, d):
    o = views.obs(spark, d)
    cutoff = o.agg(F.max("t")).first()[0]
    return anomaly.report_at(o, views.stations(spark), int(cutoff or 0), COARSE, CORE, CONTEXT, LOOKBACK)


REPORT = ["station_id", "zone", "status", "flags", "bucket", "value", "history_count", "temporal_status", "neighbor_count", "support_count", "spatial_status", "anomaly_score", "is_candidate", "is_isolated"]
REPORTED = ["age_minutes", "smoothed", "temporal_excess", "z_t", "spatial_excess", "z_s"]


def report_rows(spark, d):
    """Every station of the context at the newest time of the table: missing, stale or usable, and its anomaly."""
    return _report(spark, d).select(*REPORT, *_r(*REPORTED))


def report_summary(spark, d):
    """The report's zones."""
    return anomaly.report_summary(_report(spark, d)).select("zone", "sensors", "usable", "stale", "missing", "insufficient_history", "insufficient_neighbors", "candidates", "isolated", *_r("median_value"), "min_value", "max_value")


def anomaly_summary(spark, d):
    return _rows(spark, d).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("sensors"),
        F.count_if(F.col("temporal_status") != "sufficient").alias("insufficient_history"),
        F.count_if(F.col("spatial_status") != "sufficient").alias("insufficient_neighbors"),
        F.count_if("is_candidate").alias("candidates"),
        F.count_if("is_isolated").alias("isolated"),
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("median_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def robust_stats_by_key(spark, d):
    out = stats_by(views.obs(spark, d).select("station_id", "value"), ["station_id"], "value")
    return out.select("station_id", "n", "outliers", *_r("median", "mad", "sigma", "q1", "q3", "p90"))


def gap_island_runs(spark, d):
    flagged = smoothed_bins(spark, d).withColumn("high", F.col("smoothed") > 60)
    return timeseries.islands(flagged, "station_id", "bucket", "high", 21_600).groupBy("station_id").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"), F.min("start").alias("first_start"))


def as_of_latest(spark, d):
    e = views.obs(spark, d)
    ask = e.where("event_type = 'error'").select("station_id", "t", F.col("obs_id").alias("ask_id"))
    have = e.where("event_type = 'view'").select("station_id", F.col("t").alias("seen_t"), F.col("value").alias("seen_value"))
    out = timeseries.as_of(ask, have, ["station_id"], "t", "seen_t", ["seen_value"], 86_400)
    return out.select("ask_id", "station_id", F.coalesce("matched_seen_t", F.lit(-1)).alias("matched_seen_t"), F.coalesce("matched_seen_value", F.lit(-1.0)).alias("matched_seen_value"))


def _sql_round(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_SEEN = f"cut AS (SELECT max(t) AS now FROM obs), cx AS (SELECT *, CASE WHEN lat BETWEEN {CORE[0]} AND {CORE[2]} AND lon BETWEEN {CORE[1]} AND {CORE[3]} THEN 'core' ELSE 'context' END AS zone FROM station WHERE lat BETWEEN {CONTEXT[0]} AND {CONTEXT[2]} AND lon BETWEEN {CONTEXT[1]} AND {CONTEXT[3]}), ob2 AS (SELECT * FROM obs WHERE t >= (SELECT now FROM cut) - {LOOKBACK} AND station_id IN (SELECT station_id FROM cx))"
_NOW = f"""tc AS (SELECT * REPLACE ((SELECT now FROM cut) AS bucket), bucket AS own, ((SELECT now FROM cut) - t) / 60 AS age_minutes, (SELECT now FROM cut) - t > {COARSE.max_age_seconds} AS old FROM tb QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY t DESC) = 1), tu AS (SELECT * FROM tc WHERE NOT old)"""
_AT = ANOMALY.replace("FROM tb x JOIN", "FROM tc x JOIN").replace("JOIN tb o", "JOIN tu o").replace("tb.*", "tc.*").replace("FROM tb LEFT JOIN", "FROM tc LEFT JOIN")
_REPORT = f"""rp AS (SELECT cx.station_id, zone, CASE WHEN own IS NULL THEN 'missing' WHEN old THEN 'stale' ELSE 'usable' END AS status, CASE WHEN own IS NULL THEN 'missing_current_value' WHEN old THEN 'stale_current_observation' ELSE '' END AS flags, own AS bucket, value,
    coalesce(history_count, 0) AS history_count, coalesce(temporal_status, 'insufficient_history') AS temporal_status, coalesce(neighbor_count, 0) AS neighbor_count, coalesce(support_count, 0) AS support_count, coalesce(spatial_status, 'insufficient_neighbors') AS spatial_status,
    anomaly_score, coalesce(is_candidate AND NOT old, false) AS is_candidate, coalesce(is_isolated AND NOT old, false) AS is_isolated, {', '.join(REPORTED)} FROM cx LEFT JOIN an USING (station_id))"""
_REPORTED = with_("obs", "station", _SEEN, BINNED.replace("FROM obs", "FROM ob2"), _NOW, _AT, _REPORT)

QUERIES = {
    "report_rows": (report_rows, _REPORTED + f" SELECT {', '.join(REPORT)}, {_sql_round(*REPORTED)} FROM rp"),
    "report_summary": (report_summary, _REPORTED + """ SELECT z AS zone, count(*) AS sensors, count(*) FILTER (WHERE status = 'usable') AS usable, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'missing') AS missing,
        count(*) FILTER (WHERE temporal_status <> 'sufficient') AS insufficient_history, count(*) FILTER (WHERE spatial_status <> 'sufficient') AS insufficient_neighbors, count(*) FILTER (WHERE is_candidate) AS candidates, count(*) FILTER (WHERE is_isolated) AS isolated,
        round(quantile_cont(value, 0.5) FILTER (WHERE status = 'usable'), 6) AS median_value, min(value) FILTER (WHERE status = 'usable') AS min_value, max(value) FILTER (WHERE status = 'usable') AS max_value FROM rp, (SELECT unnest(['core', 'context']) AS z) WHERE z = 'context' OR zone = 'core' GROUP BY 1"""),
    "bin_last_value": (bin_last_value, with_("obs", BINNED) + " SELECT station_id, bucket, obs_id, t, value FROM binned"),
    "bin_smooth": (bin_smooth, with_("obs", BINNED) + " SELECT station_id, bucket, round(smoothed, 6) AS smoothed FROM smoothed"),
    "temporal_baseline": (temporal_baseline, with_("obs", BINNED) + f" SELECT station_id, bucket, CAST(history_count AS BIGINT) AS history_count, {_sql_round('t_median', 't_mad', 'temporal_excess', 'z_t')}, temporal_status FROM tb"),
    "neighbor_pairs": (neighbor_pairs, with_("monitor") + f", p AS (SELECT a.station_id AS a, b.station_id AS b, {hav('a', 'b')} AS d FROM monitor a, monitor b WHERE a.station_id <> b.station_id) SELECT a, b, round(d, 6) AS distance_km FROM p WHERE d <= 4.5"),
    "anomaly_rows": (anomaly_rows, with_("obs", "station", BINNED, ANOMALY) + f" SELECT * REPLACE (CAST(history_count AS BIGINT) AS history_count, CAST(neighbor_count AS BIGINT) AS neighbor_count, CAST(support_count AS BIGINT) AS support_count) FROM (SELECT {', '.join(COLUMNS)}, {_sql_round(*ROUNDED)} FROM an)"),
    "anomaly_candidates_topk": (anomaly_candidates_topk, with_("obs", "station", BINNED, ANOMALY) + " SELECT station_id, bucket, anomaly_score FROM an WHERE is_candidate ORDER BY anomaly_score DESC, station_id, bucket LIMIT 15"),
    "anomaly_absent": (anomaly_absent, with_("obs", "station", BINNED, ANOMALY) + """, sp AS (SELECT * FROM (SELECT DISTINCT bucket FROM an), (SELECT station_id FROM station)),
        ab AS (SELECT sp.bucket, sp.station_id, an.* EXCLUDE (bucket, station_id), an.station_id IS NULL AS none FROM sp LEFT JOIN an USING (bucket, station_id))
        SELECT bucket, station_id, CAST(row_number() OVER (PARTITION BY bucket ORDER BY coalesce(CASE WHEN anomaly_score <> 0 THEN round(anomaly_score, 5) END, -1.0) DESC, station_id) AS INTEGER) AS place,
               CASE WHEN none THEN 'missing' ELSE 'usable' END AS status, CASE WHEN none THEN 'missing_current_value' ELSE '' END AS flags, coalesce(temporal_status, 'insufficient_history') AS temporal_status,
               coalesce(spatial_status, 'insufficient_neighbors') AS spatial_status, coalesce(history_count, 0) AS history_count, coalesce(neighbor_count, 0) AS neighbor_count, coalesce(is_candidate, false) AS is_candidate FROM ab"""),
    "anomaly_isolated": (anomaly_isolated, with_("obs", "station", BINNED, ANOMALY) + f" SELECT station_id, bucket, {_sql_round('temporal_excess', 'z_t')} FROM an WHERE is_isolated"),
    "anomaly_summary": (anomaly_summary, with_("obs", "station", BINNED, ANOMALY) + """ SELECT bucket, count(*) AS sensors, count(*) FILTER (WHERE temporal_status <> 'sufficient') AS insufficient_history,
        count(*) FILTER (WHERE spatial_status <> 'sufficient') AS insufficient_neighbors, count(*) FILTER (WHERE is_candidate) AS candidates, count(*) FILTER (WHERE is_isolated) AS isolated,
        round(quantile_cont(value, 0.5), 6) AS median_value, min(value) AS min_value, max(value) AS max_value FROM an GROUP BY bucket"""),
    "robust_stats_by_key": (robust_stats_by_key, with_("obs") + """, q AS (SELECT station_id, count(value) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.9) AS p90 FROM obs GROUP BY 1),
        m AS (SELECT station_id, n, median, q1, q3, p90, quantile_cont(abs(value - median), 0.5) AS mad, count(*) FILTER (WHERE value > q3 + 1.5 * (q3 - q1)) AS high FROM obs JOIN q USING (station_id) GROUP BY ALL)
        SELECT station_id, n, CAST(CASE WHEN n >= 4 THEN high ELSE 0 END AS BIGINT) AS outliers, round(median, 6) AS median, round(mad, 6) AS mad, round(greatest(1.4826 * mad, 1.5), 6) AS sigma, round(q1, 6) AS q1, round(q3, 6) AS q3, round(p90, 6) AS p90 FROM m"""),
    "gap_island_runs": (gap_island_runs, with_("obs", BINNED) + """, f AS (SELECT station_id, bucket, smoothed > 60 AS high FROM smoothed),
        n AS (SELECT *, CASE WHEN lag(high) OVER w AND bucket - lag(bucket) OVER w = 21600 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY station_id ORDER BY bucket)),
        i AS (SELECT *, sum(new) OVER (PARTITION BY station_id ORDER BY bucket) AS island FROM n), r AS (SELECT station_id, island, min(bucket) AS start, count(*) AS n FROM i WHERE high GROUP BY 1, 2)
        SELECT station_id, count(*) AS runs, max(n) AS longest, min(start) AS first_start FROM r GROUP BY 1"""),
    "as_of_latest": (as_of_latest, with_("obs") + """, a AS (SELECT station_id, t, obs_id AS ask_id FROM obs WHERE event_type = 'error'), h AS (SELECT station_id, t AS seen_t, max(value) AS v FROM obs WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT ask_id, a.station_id, coalesce(h.seen_t, -1) AS matched_seen_t, coalesce(h.v, -1.0) AS matched_seen_value FROM a LEFT JOIN h ON h.station_id = a.station_id AND h.seen_t <= a.t AND h.seen_t >= a.t - 86400
        QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY h.seen_t DESC NULLS LAST) = 1"""),
}
