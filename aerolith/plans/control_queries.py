"""Queries of the controls around fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COARSE
from ..operators import anomaly, controls
from . import views
from .anomaly_queries import smoothed_bins
from .views import ANOMALY, BINNED, hav, with_

STEP, HOUR = 21_600, 3600
#: As the tables' bins are six hours wide, so are the windows: a day before, a day of fire, half a day after.
CONTROL = controls.ControlConfig(before=24 * HOUR, after=12 * HOUR, reference_before=24 * HOUR)
BURNS, DAYS = 24 * HOUR, (-4, -2, 2, 4)


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _fires(spark, d):
    return views.fires(spark, d).select("fire_id", F.col("t").alias("start"), (F.col("t") + BURNS).alias("end"), "lat", "lon")


def _bins(spark, d):
    return smoothed_bins(spark, d).select("station_id", "bucket", F.col("smoothed").alias("value"))


def _timeline(spark, d):
    return controls.timeline(_fires(spark, d), views.stations(spark), _bins(spark, d), CONTROL, STEP)


LINE = [f"{g}_{c}" for g in ("inner", "middle", "outer") for c in ("median", "p75", "max", "base", "excess")] + ["contrast", "middle_contrast"]
COUNTS = [f"{g}_n" for g in ("inner", "middle", "outer")]


def fire_group_timeline(spark, d):
    """Every fire's groups of sensors in every bin around it."""
    return _timeline(spark, d).select("fire_id", "bucket", *COUNTS, *_r(*LINE))


def ring_supports(spark, d):
    """Every sensor's value in every bin against the rings around it."""
    out = controls.ring_metrics(_bins(spark, d), views.stations(spark), COARSE)
    return out.select("station_id", "bucket", "ring", "n", "supports", *_r("median", "mad", "excess", "z"))


TESTED = ["pairs", "temporal", "production", "ring_1_3", "ring_2_5", "lost_1_3", "won_1_3"]
MEASURES = ["inner_base", "outer_base", "peak_inner", "peak_outer", "max_contrast", "max_middle_contrast", "outer_delta", "reference_delta", "baseline_rise"]
KINDS = ["outer_control", "reference_control", "regional", "contamination", "class"]


def fire_controls(spark, d):
    """One row a fire: controls, counterfactual support and class. Reference sites are the weather stations, measured by the views of a page."""
    fires, st = _fires(spark, d), views.stations(spark)
    rows = anomaly.anomaly_rows(views.obs(spark, d), st, COARSE)
    rings = controls.ring_metrics(_bins(spark, d), st, COARSE)
    production = rows.where("s_median is not null").groupBy("bucket").agg(F.percentile("s_median", F.lit(0.5)).alias("baseline"))
    measured = views.obs(spark, d).where("event_type = 'view' and station_id < 24").select("station_id", "t", "value")
    reference = controls.reference_control(fires, st.where("station_id < 24"), measured, CONTROL)
    tested = controls.counterfactual(fires, st, rows, rings, COARSE, STEP)
    out = controls.classify(_timeline(spark, d), fires, production, reference, tested, CONTROL)
    return out.select("fire_id", *TESTED, "outer_bins", "outer_up", "sites", "sites_up", *KINDS, *_r(*MEASURES))


def support_without_each(spark, d):
    """Support by neighbours, and what is left of it without each of them, for every sensor and bin."""
    return controls.without_each(anomaly.anomaly_rows(views.obs(spark, d), views.stations(spark), COARSE, keep_values=True), COARSE)


def fire_matched_controls(spark, d):
    """Every fire's contrast against that of the same place and time of day on other days."""
    out = controls.matched_controls(_fires(spark, d), views.stations(spark), _bins(spark, d), CONTROL, STEP, DAYS)
    return out.select("fire_id", "controls", *_r("control_contrast", "own_contrast", "over_control"))


def fire_top_pairs(spark, d):
    """The twenty strongest anomalies near each fire while it burns."""
    rows = anomaly.anomaly_rows(views.obs(spark, d), views.stations(spark), COARSE)
    return controls.top_pairs(_fires(spark, d), views.stations(spark), rows, STEP)


_NEAR = f"""burn AS (SELECT fire_id, t AS s, t + {BURNS} AS e, lat, lon FROM fire),
nr AS (SELECT fire_id, s, e, station_id, d FROM (SELECT f.fire_id, f.s, f.e, x.station_id, {hav('f', 'x')} AS d FROM burn f, station x) WHERE d <= 5.0),
bn AS (SELECT station_id, bucket, smoothed AS value FROM smoothed)"""


def _group(name: str, when: str) -> str:
    return f"""count(value) FILTER (WHERE {when}) AS {name}_n, quantile_cont(value, 0.5) FILTER (WHERE {when}) AS {name}_median, quantile_cont(value, 0.75) FILTER (WHERE {when}) AS {name}_p75, max(value) FILTER (WHERE {when}) AS {name}_max"""


def _base(name: str) -> str:
    return f"quantile_cont({name}_median, 0.5) FILTER (WHERE bucket >= s - {CONTROL.before} AND bucket < s) OVER (PARTITION BY fire_id) AS {name}_base"


_LINES = f"""tl0 AS (SELECT fire_id, s, e, bucket, {_group('inner', 'd < 1')}, {_group('middle', 'd >= 1 AND d < 2')}, {_group('outer', 'd >= 2')} FROM nr JOIN bn USING (station_id)
    WHERE bucket >= (s - {CONTROL.before}) - (s - {CONTROL.before}) % {STEP} AND bucket < e + {CONTROL.after} GROUP BY 1, 2, 3, 4),
tl1 AS (SELECT *, {_base('inner')}, {_base('middle')}, {_base('outer')} FROM tl0),
tl AS (SELECT *, inner_median - inner_base AS inner_excess, middle_median - middle_base AS middle_excess, outer_median - outer_base AS outer_excess, inner_median - outer_median AS contrast, middle_median - outer_median AS middle_contrast FROM tl1)"""
_RINGS = f"""pr AS (SELECT * FROM (SELECT a.station_id AS a, b.station_id AS b, {hav('a', 'b')} AS d FROM station a, station b WHERE a.station_id <> b.station_id) WHERE d <= 5.0),
rl AS (SELECT a AS station_id, o.bucket, ring, any_value(o.value) AS own, list(n.value) AS v FROM pr JOIN (VALUES ('1_2', 1.0, 2.0, false), ('1_3', 1.0, 3.0, false), ('2_3', 2.0, 3.0, false), ('2_5', 2.0, 5.0, true)) r(ring, lo, hi, closed) ON d >= lo AND (d < hi OR (closed AND d <= hi))
    JOIN bn n ON n.station_id = b JOIN bn o ON o.station_id = a AND o.bucket = n.bucket GROUP BY ALL),
rm AS (SELECT *, list_median(v) AS median FROM rl), rd AS (SELECT *, list_median(list_transform(v, lambda x: abs(x - median))) AS mad, own - median AS excess FROM rm),
rg AS (SELECT *, excess / greatest(1.4826 * mad, 1.5) AS z, coalesce(len(v) >= 3 AND excess >= 5 AND excess / greatest(1.4826 * mad, 1.5) >= 3, false) AS supports FROM rd)"""
_CONTROLS = f"""wd AS (SELECT station_id, bucket, coalesce(bool_or(supports) FILTER (WHERE ring = '1_3'), false) AS s13, coalesce(bool_or(supports) FILTER (WHERE ring = '2_5'), false) AS s25 FROM rg GROUP BY 1, 2),
ac AS (SELECT fire_id, coalesce(temporal_status = 'sufficient' AND temporal_excess >= 5 AND z_t >= 3, false) AS te, coalesce(spatial_status = 'sufficient' AND spatial_excess >= 5 AND z_s >= 3, false) AS sp, coalesce(s13, false) AS s13, coalesce(s25, false) AS s25
    FROM nr JOIN an USING (station_id) LEFT JOIN wd USING (station_id, bucket) WHERE bucket >= s - s % {STEP} AND bucket < e),
cf AS (SELECT fire_id, count(*) AS pairs, count(*) FILTER (WHERE te) AS temporal, count(*) FILTER (WHERE sp) AS production, count(*) FILTER (WHERE te AND s13) AS ring_1_3, count(*) FILTER (WHERE te AND s25) AS ring_2_5,
    count(*) FILTER (WHERE te AND sp AND NOT s13) AS lost_1_3, count(*) FILTER (WHERE te AND NOT sp AND s13) AS won_1_3 FROM ac GROUP BY 1),
rf0 AS (SELECT fire_id, station_id, quantile_cont(value, 0.5) FILTER (WHERE t >= s) - quantile_cont(value, 0.5) FILTER (WHERE t < s) AS delta FROM (SELECT f.*, x.station_id, {hav('f', 'x')} AS d FROM burn f, station x WHERE x.station_id < 24) JOIN obs USING (station_id)
    WHERE d <= 50 AND event_type = 'view' AND t >= s - {CONTROL.reference_before} AND t < e GROUP BY 1, 2),
rf AS (SELECT fire_id, count(*) AS sites, count(*) FILTER (WHERE delta >= 2) AS sites_up, quantile_cont(delta, 0.5) AS reference_delta FROM rf0 WHERE delta IS NOT NULL GROUP BY 1),
pb AS (SELECT bucket, quantile_cont(s_median, 0.5) AS baseline FROM an WHERE s_median IS NOT NULL GROUP BY 1),
ri AS (SELECT fire_id, quantile_cont(baseline, 0.5) FILTER (WHERE bucket >= s AND bucket < e) - quantile_cont(baseline, 0.5) FILTER (WHERE bucket >= s - {CONTROL.before} AND bucket < s) AS baseline_rise FROM burn, pb GROUP BY 1),
su AS (SELECT fire_id, any_value(inner_base) AS inner_base, any_value(outer_base) AS outer_base, max(inner_median) FILTER (WHERE bucket >= s AND bucket < e) AS peak_inner, max(outer_median) FILTER (WHERE bucket >= s AND bucket < e) AS peak_outer,
    max(contrast) FILTER (WHERE bucket >= s AND bucket < e) AS max_contrast, max(middle_contrast) FILTER (WHERE bucket >= s AND bucket < e) AS max_middle_contrast, count(*) FILTER (WHERE contrast IS NOT NULL AND inner_n >= 1 AND outer_n >= 3) AS usable,
    count(outer_excess) FILTER (WHERE bucket >= s AND bucket < e) AS outer_bins, count(*) FILTER (WHERE outer_excess >= 2 AND bucket >= s AND bucket < e) AS outer_up, quantile_cont(outer_excess, 0.5) FILTER (WHERE bucket >= s AND bucket < e) AS outer_delta FROM tl GROUP BY 1),
al AS (SELECT burn.fire_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*TESTED, 'outer_bins', 'outer_up', 'sites', 'sites_up', 'usable'])}, {', '.join(MEASURES)} FROM burn LEFT JOIN su USING (fire_id) LEFT JOIN ri USING (fire_id) LEFT JOIN rf USING (fire_id) LEFT JOIN cf USING (fire_id)),
k0 AS (SELECT *, CASE WHEN outer_bins < 3 THEN 'INSUFFICIENT_DATA' WHEN outer_up >= 0.5 * outer_bins THEN 'REGIONAL_BACKGROUND_CONTAMINATION' ELSE 'NO_REGIONAL_BACKGROUND_RISE' END AS outer_control,
    CASE WHEN sites < 3 THEN 'INSUFFICIENT_DATA' WHEN sites_up >= 0.5 * sites THEN 'REGIONAL_BACKGROUND_CONTAMINATION' ELSE 'NO_REGIONAL_BACKGROUND_RISE' END AS reference_control, coalesce(max_contrast >= 5, false) AS high FROM al),
k1 AS (SELECT *, CASE WHEN 'INSUFFICIENT_DATA' IN (outer_control, reference_control) THEN 'INSUFFICIENT_DATA' WHEN outer_control = 'REGIONAL_BACKGROUND_CONTAMINATION' AND reference_control = outer_control THEN outer_control ELSE 'NO_REGIONAL_BACKGROUND_RISE' END AS regional,
    CASE WHEN baseline_rise IS NULL OR NOT high THEN 'AMBIGUOUS' WHEN baseline_rise >= 2 THEN 'YES' ELSE 'NO' END AS contamination FROM k0),
k2 AS (SELECT *, CASE WHEN usable = 0 THEN 'INSUFFICIENT_DATA' WHEN regional = 'REGIONAL_BACKGROUND_CONTAMINATION' THEN regional WHEN high THEN 'LOCAL_CONTRAST_PRESENT' ELSE 'NO_LOCAL_CONTRAST' END AS class FROM k1)"""


def _sr(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_OK = "(len({v}) >= 3 AND smoothed - list_median({v}) >= 5 AND (smoothed - list_median({v})) / greatest(1.4826 * list_median(list_transform({v}, lambda q: abs(q - list_median({v})))), 1.5) >= 3)"
_LESS = "list_concat(vs[:i - 1], vs[i + 1:])"
_MATCHED = f"""mv AS (SELECT fire_id, day, t + 86400 * day AS s, t + 86400 * day + {BURNS} AS e, lat, lon FROM fire, (SELECT unnest([0, {', '.join(map(str, DAYS))}]) AS day)),
mn AS (SELECT * FROM (SELECT m.fire_id, day, s, e, x.station_id, {hav('m', 'x')} AS d FROM mv m, station x) WHERE d <= 5.0),
ml AS (SELECT fire_id, day, max(c) AS contrast FROM (SELECT fire_id, day, bucket, quantile_cont(smoothed, 0.5) FILTER (WHERE d < 1) - quantile_cont(smoothed, 0.5) FILTER (WHERE d >= 2) AS c FROM mn JOIN smoothed USING (station_id) WHERE bucket >= s AND bucket < e GROUP BY 1, 2, 3) GROUP BY 1, 2),
mg AS (SELECT ml.* FROM ml WHERE contrast IS NOT NULL AND (day = 0 OR NOT EXISTS (SELECT 1 FROM mv m, fire f WHERE m.fire_id = ml.fire_id AND m.day = ml.day AND f.fire_id <> m.fire_id AND f.t < m.e AND f.t + {BURNS} > m.s AND {hav('m', 'f')} <= 1.0)))"""

QUERIES = {
    "fire_top_pairs": (fire_top_pairs, with_("obs", "station", "fire", BINNED, ANOMALY, _NEAR) + f""", tq AS (SELECT fire_id, station_id, bucket, anomaly_score, row_number() OVER (PARTITION BY fire_id ORDER BY CASE WHEN anomaly_score <> 0 THEN anomaly_score ELSE -1e300 END DESC, station_id DESC, bucket DESC) AS k
        FROM nr JOIN an USING (station_id) WHERE bucket >= s - s % {STEP} AND bucket < e) SELECT fire_id, CAST(k AS INTEGER) AS rank, station_id, bucket, anomaly_score FROM tq WHERE k <= 20"""),
    "support_without_each": (support_without_each, with_("obs", "station", BINNED, ANOMALY) + f""", wo AS (SELECT station_id, bucket, smoothed, vs, {_OK.format(v='vs')} AS supports FROM an),
        ex AS (SELECT station_id, bucket, i, vs, smoothed, {_LESS} AS less FROM wo, LATERAL (SELECT unnest(range(1, len(vs) + 1)) AS i)), ke AS (SELECT station_id, bucket, count(*) FILTER (WHERE {_OK.format(v='less')}) AS kept FROM ex GROUP BY 1, 2)
        SELECT station_id, bucket, CAST(len(vs) AS BIGINT) AS neighbors, coalesce(supports, false) AS supports, coalesce(kept, 0) AS kept, coalesce(supports, false) AND coalesce(kept, 0) < len(vs) AS fragile FROM wo LEFT JOIN ke USING (station_id, bucket)"""),
    "fire_matched_controls": (fire_matched_controls, with_("obs", "station", "fire", BINNED, _MATCHED) + """ SELECT fire_id, count(*) FILTER (WHERE day <> 0) AS controls, round(quantile_cont(contrast, 0.5) FILTER (WHERE day <> 0), 6) AS control_contrast,
        round(max(contrast) FILTER (WHERE day = 0), 6) AS own_contrast, round(max(contrast) FILTER (WHERE day = 0) - quantile_cont(contrast, 0.5) FILTER (WHERE day <> 0), 6) AS over_control FROM mg GROUP BY 1"""),
    "fire_group_timeline": (fire_group_timeline, with_("obs", "station", "fire", BINNED, _NEAR, _LINES) + f" SELECT fire_id, bucket, {', '.join(COUNTS)}, {_sr(LINE)} FROM tl"),
    "ring_supports": (ring_supports, with_("obs", "station", BINNED, "bn AS (SELECT station_id, bucket, smoothed AS value FROM smoothed)", _RINGS) + f" SELECT station_id, bucket, ring, CAST(len(v) AS BIGINT) AS n, supports, {_sr(['median', 'mad', 'excess', 'z'])} FROM rg"),
    "fire_controls": (fire_controls, with_("obs", "station", "fire", BINNED, ANOMALY, _NEAR, _LINES, _RINGS.replace("pr AS (", "pq AS (").replace("FROM pr JOIN", "FROM pq JOIN"), _CONTROLS) + f" SELECT fire_id, {', '.join([*TESTED, 'outer_bins', 'outer_up', 'sites', 'sites_up', *KINDS])}, {_sr(MEASURES)} FROM k2"),
}
