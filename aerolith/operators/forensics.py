"""What a sensor's rise near a fire looks like: its shape, its neighbours by distance, earlier spikes like it, signs of a fault, and classes of sensors and fires."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robust import pearson
from .controls import around, met
from .graph import cut
from .spatial import neighbor_pairs


@dataclass(frozen=True)
class ForensicsConfig:
    """Seconds of a bin, before a fire's start (its baseline) and after its end (its response); what counts as near; and the thresholds."""

    step: int = 180
    before: int = 3600
    after: int = 10_800
    km: float = 5.0
    #: Bounds of the distance bands in km: the last one is closed.
    bands: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 1.0)
    rises: tuple[float, ...] = (3.0, 5.0, 10.0)
    prior: tuple[float, ...] = (10.0, 20.0, 30.0)
    lags: int = 4
    plume: float = 10.0
    jump: float = 50.0
    history_bins: int = 60
    history_span: int = 21_600

    def band_names(self) -> list[str]:
        return [f"band_{i}" for i in range(1, len(self.bands))]


def alike(near: DataFrame, cfg: ForensicsConfig) -> tuple[DataFrame, DataFrame]:
    """(rows of ``around`` of representative fires, (fire_id, as_id) of all): fires with the same sensors nearby whose times fall between the same bins see the same bins, so one of them answers for all.

    That holds where the configured spans are whole bins; else a fire stands for those with the very same times only.
    """
    whole = cfg.before % cfg.step == 0 and cfg.after % cfg.step == 0
    key = lambda c: F.floor((F.col(c) - 1) / cfg.step).alias(f"_{c}_after") if whole else F.col(c).alias(f"_{c}_after")
    at = lambda c: F.floor(F.col(c) / cfg.step).alias(f"_{c}_at") if whole else F.col(c).alias(f"_{c}_at")
    times = [f(c) for c in ("start", "end") for f in (key, at)]
    seen = near.groupBy("fire_id", "start", "end").agg(F.array_sort(F.collect_set(F.struct("station_id", "distance_km"))).alias("_near")).select("fire_id", *times, "_near")
    keys = [c for c in seen.columns if c != "fire_id"]
    same = cut(seen.select("fire_id", F.min("fire_id").over(Window.partitionBy(*keys)).alias("as_id")))
    return near.join(same.select(F.col("as_id").alias("fire_id")).distinct(), "fire_id", "left_semi"), same


def each_fire(found: DataFrame, same: DataFrame) -> DataFrame:
    """Rows of representatives as those of all fires that they answer for, from ``alike``."""
    return same.join(found.withColumnRenamed("fire_id", "as_id"), "as_id").drop("as_id")


def responses(near: DataFrame, bins: DataFrame, cfg: ForensicsConfig) -> DataFrame:
    """(fire_id, start, end, station_id, distance_km, baseline, peak, peak_bucket, peak_t, excess, series): a sensor's median before a fire, and its highest value, the first of equal ones, until
    ``after`` seconds after it.

    ``bins`` has station_id, bucket, t and value. ``series`` holds the response's bins in order: as many as the fire lasts, so a bounded list a row. Sensors without values have nulls.
    """
    rows = met(near, bins.where("value is not null"), "bucket", cfg.before, cfg.after, cfg.before + cfg.after)
    later = F.col("bucket") >= F.col("start")
    point = F.struct("bucket", "t", "value")
    sums = rows.groupBy("fire_id", "station_id").agg(
        F.percentile(F.when(~later, F.col("value")), F.lit(0.5)).alias("baseline"),
        F.max(F.when(later, F.struct("value", (-F.col("bucket")).alias("first"), "t"))).alias("p"),
        F.array_sort(F.collect_list(F.when(later, point))).alias("series"),
    )
    out = near.join(sums, ["fire_id", "station_id"], "left")
    return out.select("fire_id", "start", "end", "station_id", "distance_km", "baseline", F.col("p.value").alias("peak"), (-F.col("p.first")).alias("peak_bucket"), F.col("p.t").alias("peak_t"), (F.col("p.value") - F.col("baseline")).alias("excess"), "series")


def shapes(found: DataFrame, cfg: ForensicsConfig) -> DataFrame:
    """Adds the shape of each response: bins over each rise, the longest run, peaks two bins apart, steepest rise and fall a minute between bins at most three apart, and ``shape``."""
    s, base = F.coalesce("series", F.array().cast("array<struct<bucket:bigint,t:bigint,value:double>>")), F.col("baseline")
    over = lambda x, r: x["value"] > base + r
    counted = lambda r: F.size(F.filter(s, lambda x: over(x, r))).cast("long")
    low, counts = cfg.rises[0], {f"over_{r:g}": counted(r) for r in cfg.rises}
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(None).cast("bigint").alias("last"))

    def run(acc: Column, x: Column) -> Column:
        now = F.when(over(x, low), F.when(F.coalesce(x["bucket"] - acc["last"] == cfg.step, F.lit(False)), acc["run"] + 1).otherwise(1)).otherwise(0)
        return F.struct(now.alias("run"), F.greatest(acc["best"], now).alias("best"), x["bucket"].alias("last"))

    at = lambda i: F.get(s, i)["value"]
    tops = F.filter(s, lambda x, i: over(x, low) & (x["value"] >= F.coalesce(at(i - 1), x["value"])) & (x["value"] >= F.coalesce(at(i + 1), x["value"])))
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("last"))
    take = lambda acc, x: F.when(acc["last"].isNull() | (x["bucket"] - acc["last"] >= 2 * cfg.step), F.struct((acc["n"] + 1).alias("n"), x["bucket"].alias("last"))).otherwise(acc)
    pairs = F.transform(s, lambda x, i: F.struct(((F.get(s, i + 1)["t"] - x["t"]) / 60).alias("m"), (at(i + 1) - x["value"]).alias("d")))
    rates = F.transform(F.filter(pairs, lambda p: (p["m"] > 0) & (p["m"] <= cfg.step / 20)), lambda p: p["d"] / p["m"])
    out = found.withColumns({**counts, "longest": F.aggregate(s, zero, run)["best"].cast("long"), "peaks": F.aggregate(tops, none, take)["n"].cast("long"), "rise_rate": F.array_max(F.filter(rates, lambda r: r >= 0)), "fall_rate": F.array_min(F.filter(rates, lambda r: r < 0))})
    n = F.col(f"over_{cfg.rises[0]:g}")
    kind = F.when(base.isNull() | (n == 0), "NO_CLEAR_SPIKE").when(F.col("peaks") >= 2, "MULTI_PEAK").when(n == 1, "SINGLE_BIN_SPIKE").when(F.col("longest") >= 3, "SUSTAINED_RISE").otherwise("SHORT_PULSE")
    return out.withColumn("shape", kind)


def bands(found: DataFrame, stations: DataFrame, cfg: ForensicsConfig) -> DataFrame:
    """One row for each response and distance band that has a sensor: (fire_id, station_id, band, sensors, usable, baseline, peak, over_..., within_2, within_4, max_median).

    The counts are of sensors over each rise and of those that peak within two and four bins of it; ``max_median`` is the highest, over the response's bins, of the
    sensors' median rise. Only pairs of sensors within the outermost band are joined.
    """
    pairs = neighbor_pairs(stations, cfg.bands[-1])
    d, last = F.col("distance_km"), len(cfg.bands) - 1
    inside = lambda k: (d <= cfg.bands[1]) if k == 1 else (d >= cfg.bands[k - 1]) & ((d <= cfg.bands[k]) if k == last else (d < cfg.bands[k]))
    names = F.filter(F.array(*[F.when(inside(k), F.lit(n)) for k, n in enumerate(cfg.band_names(), 1)]), lambda b: b.isNotNull())
    own = found.select("fire_id", F.col("station_id").alias("a"), F.col("peak_t").alias("own_t"))
    other = found.select("fire_id", F.col("station_id").alias("b"), "baseline", "peak", "peak_t", "excess", "series")
    both = own.join(pairs.withColumn("band", F.explode(names)).drop("distance_km"), "a").join(other, ["fire_id", "b"])
    off = F.abs(F.col("peak_t") - F.col("own_t"))
    keys = ["fire_id", F.col("a").alias("station_id"), "band"]
    usable = F.col("excess").isNotNull()
    counts = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sensors"),
        F.count_if(usable).alias("usable"),
        F.percentile(F.when(usable, F.col("baseline")), F.lit(0.5)).alias("baseline"),
        F.percentile(F.when(usable, F.col("peak")), F.lit(0.5)).alias("peak"),
        *[F.count_if(F.col("excess") > r).alias(f"over_{r:g}") for r in cfg.rises],
        *[F.count_if(usable & (off <= k * cfg.step)).alias(f"within_{k}") for k in (2, 4)],
        F.count_if((F.col("excess") > cfg.rises[0]) & (off <= 4 * cfg.step)).alias("corroborating"),
    )
    each = both.where(usable).select(*keys, "baseline", F.explode("series").alias("x")).groupBy("fire_id", "station_id", "band", "x.bucket").agg(F.percentile(F.col("x.value") - F.col("baseline"), F.lit(0.5)).alias("m"))
    top = each.groupBy("fire_id", "station_id", "band").agg(F.max("m").alias("max_median"))
    return counts.join(top, ["fire_id", "station_id", "band"], "left")


def coherence(near: DataFrame, bins: DataFrame, stations: DataFrame, cfg: ForensicsConfig) -> DataFrame:
    """(fire_id, station_id, neighbors, best_neighbor, best_lag, best_r): the neighbour within the outermost band whose series goes best with a sensor's around a fire, shifted by up to ``lags`` bins.

    Pearson's r of at least five common bins from two ``before`` before the start to two after the end, both series having a value in the first of them; of equal ones the smallest lag in time order, then the smallest neighbour.
    """
    edge, reach = 2 * cfg.before, cfg.lags * cfg.step
    rows = met(near, bins.where("value is not null"), "bucket", edge + reach + cfg.step, edge + reach + cfg.step, 2 * (edge + reach)).select("fire_id", "start", "end", "station_id", "bucket", "value")
    based = rows.where((F.col("bucket") >= F.col("start") - edge) & (F.col("bucket") < F.col("start") - cfg.before)).select("fire_id", "station_id").distinct()
    rows = rows.join(based, ["fire_id", "station_id"])
    from_bin, to_bin = F.col("start") - edge, F.col("end") + edge
    whole = lambda c: c - F.pmod(c, F.lit(cfg.step))
    a = rows.where((F.col("bucket") >= whole(from_bin)) & (F.col("bucket") <= whole(to_bin))).select("fire_id", F.col("station_id").alias("a"), "bucket", F.col("value").alias("x"))
    lag = F.explode(F.sequence(F.lit(-cfg.lags).cast("long"), F.lit(cfg.lags).cast("long")))
    b = rows.select("fire_id", F.col("station_id").alias("b"), "bucket", F.col("value").alias("y"), lag.alias("lag")).withColumn("bucket", F.col("bucket") - F.col("lag") * cfg.step)
    pairs = neighbor_pairs(stations, cfg.bands[-1]).select("a", "b")
    r = a.join(pairs, "a").join(b, ["fire_id", "b", "bucket"]).groupBy("fire_id", "a", "b", "lag").agg(F.count(F.lit(1)).alias("n"), F.round(pearson("x", "y"), 6).alias("r"))
    best = r.where((F.col("n") >= 5) & F.col("r").isNotNull() & ~F.isnan("r")).groupBy("fire_id", "a", "b").agg(F.max(F.struct("r", (-F.col("lag")).alias("l"))).alias("m"))
    return best.groupBy("fire_id", F.col("a").alias("station_id")).agg(F.count(F.lit(1)).alias("neighbors"), F.max(F.struct(F.col("m.r").alias("r"), (-F.col("b")).alias("b"), F.col("m.l").alias("l"))).alias("m")).select("fire_id", "station_id", "neighbors", (-F.col("m.b")).alias("best_neighbor"), (-F.col("m.l")).alias("best_lag"), F.col("m.r").alias("best_r"))


def history(found: DataFrame, bins: DataFrame, fires: DataFrame, cfg: ForensicsConfig) -> DataFrame:
    """Per response what the sensor did before, outside all known fires: (fire_id, station_id, history_bins, prior_base, prior_..., prior_similar, max_prior, interval, interval_share, history).

    A spike stands alone if neither bin beside it is over the same threshold; similar ones exceed the median by as much as this response, by the first rise at least. ``interval`` is the most frequent
    distance, in bins, between similar spikes that follow each other (the smallest of equal ones), and ``interval_share`` its share: a fault that repeats itself. A sensor's history is read for each fire near it.
    """
    slot = 86_400
    # an interval that is empty or turned round excludes nothing
    spans = fires.where("start < end").select("start", "end", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor(F.col("end") / slot))).alias("_slot"))
    known = bins.where("value is not null").withColumn("_slot", F.floor(F.col("bucket") / slot))
    free = known.join(spans, (known["_slot"] == spans["_slot"]) & (F.col("bucket") >= F.col("start")) & (F.col("bucket") < F.col("end")), "left_anti").select("station_id", "bucket", "value")
    w = Window.partitionBy("station_id").orderBy("bucket")
    beside = lambda f, k: F.when(f("bucket").over(w) - F.col("bucket") == k * cfg.step, f("value").over(w))
    free = free.withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1)})
    asked = found.select("fire_id", "station_id", "start", F.greatest(F.coalesce("excess", F.lit(0.0)), F.lit(cfg.rises[0])).alias("similar"))
    rows = asked.join(free, "station_id").where(F.col("bucket") < F.col("start"))
    keys = ["fire_id", "station_id"]
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("history_bins"), F.percentile("value", F.lit(0.5)).alias("prior_base"), F.min("bucket").alias("_low"), F.max("bucket").alias("_high"))
    rows = rows.join(base.select(*keys, "prior_base"), keys)
    over = lambda c, delta: F.coalesce(c > F.col("prior_base") + delta, F.lit(False))
    after = F.when(F.col("bucket") + cfg.step < F.col("start"), F.col("after"))
    alone = lambda delta: over(F.col("value"), delta) & ~over(F.col("before"), delta) & ~over(after, delta)
    rows = rows.withColumn("_similar", alone(F.col("similar")))
    counts = rows.groupBy(*keys).agg(*[F.count_if(alone(F.lit(p))).alias(f"prior_{p:g}") for p in cfg.prior], F.count_if("_similar").alias("prior_similar"), F.max(F.col("value") - F.col("prior_base")).alias("max_prior"))
    own = Window.partitionBy(*keys).orderBy("bucket")
    gaps = rows.where("_similar").withColumn("gap", ((F.col("bucket") - F.lag("bucket").over(own)) / cfg.step).cast("long")).where("gap is not null").groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    often = gaps.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("gap")).alias("g"))).alias("m"), F.sum("n").alias("all")).select(*keys, (-F.col("m.g")).alias("interval"), (F.col("m.n") / F.col("all")).alias("interval_share"))
    status = F.when((F.col("history_bins") >= cfg.history_bins) & (F.col("_high") - F.col("_low") >= cfg.history_span), "SUFFICIENT_HISTORY").otherwise("LIMITED_HISTORY")
    return base.withColumn("history", status).drop("_low", "_high").join(counts, keys).join(often, keys, "left")


def faults(found: DataFrame, bins: DataFrame, stations: DataFrame, cfg: ForensicsConfig, received: str | None = None) -> DataFrame:
    """Signs of a fault: (fire_id, station_id, seen, missing, clock, cadence, gaps, jumps).

    How many neighbours within the outermost band had a value in the bin of the peak and how many had none; whether the peak was received before it was measured (``CLOCK_AHEAD``, over five
    minutes) or late (``STALE_INGESTION``, over fifteen), if ``bins`` has a column ``received``; and of the sensor's whole series the median minutes between bins, the gaps over three bins, and steps over ``jump``.
    """
    w = Window.partitionBy("station_id").orderBy("bucket")
    known = bins.where("value is not null")
    steps = known.withColumns({"_gap": (F.col("bucket") - F.lag("bucket").over(w)) / 60, "_jump": F.abs(F.col("value") - F.lag("value").over(w))})
    series = steps.groupBy("station_id").agg(F.percentile("_gap", F.lit(0.5)).alias("cadence"), F.count_if(F.col("_gap") > cfg.step / 20).alias("gaps"), F.count_if(F.col("_jump") > cfg.jump).alias("jumps"))
    pairs = neighbor_pairs(stations, cfg.bands[-1]).select(F.col("a").alias("station_id"), "b")
    have = known.select(F.col("station_id").alias("b"), F.col("bucket").alias("peak_bucket"), F.lit(1).alias("_have"))
    inside = found.select("fire_id", F.col("station_id").alias("b"))
    beside = found.where("peak_bucket is not null").select("fire_id", "station_id", "peak_bucket").join(pairs, "station_id").join(inside, ["fire_id", "b"]).join(have, ["b", "peak_bucket"], "left")
    seen = beside.groupBy("fire_id", "station_id").agg(F.count("_have").alias("seen"), F.count_if(F.col("_have").isNull()).alias("missing"))
    out = found.select("fire_id", "station_id", "peak_bucket").join(seen, ["fire_id", "station_id"], "left").join(series, "station_id", "left")
    if received is None:
        out = out.withColumn("clock", F.lit("UNAVAILABLE"))
    else:
        late = known.select("station_id", F.col("bucket").alias("peak_bucket"), ((F.col(received) - F.col("t")) / 60).alias("_late"))
        clock = F.when(F.col("_late").isNull(), "UNAVAILABLE").when(F.col("_late") < -5, "CLOCK_AHEAD").when(F.col("_late") > 15, "STALE_INGESTION").otherwise("NORMAL_OR_UNKNOWN")
        out = out.join(late, ["station_id", "peak_bucket"], "left").withColumn("clock", clock).drop("_late")
    return out.drop("peak_bucket").fillna(0, ["seen", "missing", "gaps", "jumps"])


def classify(shaped: DataFrame, banded: DataFrame, prior: DataFrame, signs: DataFrame, wind: DataFrame, cfg: ForensicsConfig) -> DataFrame:
    """One row for each fire and sensor near it, with its ``class``.

    ``wind`` (fire_id, station_id, plausible) tells whether the sensor lies downwind by a wind that is good enough. Corroborating sensors rise in the bands from the second to half the outermost distance, within four bins of the peak.
    Rules, the first that holds: no rise; two corroborating sensors; a large and lasting rise downwind; a short one that has happened before, has no witness or comes with jumps; else ambiguous.
    """
    near = [n for n, top in zip(cfg.band_names(), cfg.bands[1:], strict=True) if n != cfg.band_names()[0] and top <= cfg.bands[-1] / 2]
    support = banded.where(F.col("band").isin(near)).groupBy("fire_id", "station_id").agg(F.sum("corroborating").alias("corroborating"))
    keys = ["fire_id", "station_id"]
    out = shaped.drop("series").join(support, keys, "left").join(prior, keys, "left").join(signs, keys, "left").join(wind, keys, "left")
    zeros = ["corroborating", "history_bins", "prior_similar", *[f"prior_{p:g}" for p in cfg.prior]]
    out = out.fillna(0, zeros).withColumns({"plausible": F.coalesce("plausible", F.lit(False)), "history": F.coalesce("history", F.lit("LIMITED_HISTORY"))})
    short = F.col("shape").isin("SINGLE_BIN_SPIKE", "SHORT_PULSE")
    kind = (
        F.when(F.col("excess").isNull() | (F.col("excess") < cfg.rises[0]), "NO_SIGNIFICANT_RESPONSE")
        .when(F.col("corroborating") >= 2, "COHERENT_LOCAL_RESPONSE")
        .when((F.col("excess") >= cfg.plume) & F.col("shape").isin("SUSTAINED_RISE", "MULTI_PEAK") & F.col("plausible"), "NARROW_POSSIBLE_PLUME")
        .when(short & ((F.col("prior_similar") > 0) | (F.col("seen") == 0) | (F.col("jumps") > 0)), "ISOLATED_SENSOR_SPIKE")
        .otherwise("AMBIGUOUS")
    )
    return out.withColumn("class", kind)


def top_sensors(shaped: DataFrame, rows: DataFrame, cfg: ForensicsConfig) -> DataFrame:
    """(fire_id, station_id) of the sensors near a fire with its largest excess, anomaly score, temporal or spatial z while it burns; of equal ones the smallest id. ``rows`` are anomaly rows."""
    active = met(shaped.select("fire_id", "start", "end", "station_id"), rows.select("station_id", "bucket", "anomaly_score", "z_t", "z_s"), "bucket", 0, 0, 86_400)
    best = lambda df, c: df.where(F.col(c).isNotNull()).groupBy("fire_id").agg(F.max_by("station_id", F.struct(c, (-F.col("station_id")).alias("i"))).alias("station_id"))
    found = [best(shaped, "excess"), *(best(active, c) for c in ("anomaly_score", "z_t", "z_s"))]
    return reduce(DataFrame.union, found).distinct()


def classify_fires(sensors: DataFrame, top: DataFrame) -> DataFrame:
    """(fire_id, sensors, significant, class) from the classes of a fire's ``top_sensors``."""
    rows = sensors.select("fire_id", "station_id", "class").join(top, ["fire_id", "station_id"])
    n = lambda k: F.count_if(F.col("class") == k)
    sums = rows.groupBy("fire_id").agg(F.count(F.lit(1)).alias("sensors"), F.count_if(F.col("class") != "NO_SIGNIFICANT_RESPONSE").alias("significant"), n("COHERENT_LOCAL_RESPONSE").alias("c"), n("NARROW_POSSIBLE_PLUME").alias("p"), n("ISOLATED_SENSOR_SPIKE").alias("i"))
    kind = F.when(F.col("significant") == 0, "NO_MEASURABLE_RESPONSE").when(F.col("c") >= 2, "MULTI_SENSOR_FIRE_RESPONSE").when(F.col("p") > 0, "NARROW_RESPONSE_ONLY").when(F.col("i") == F.col("significant"), "SENSOR_ARTIFACT_LIKELY").otherwise("AMBIGUOUS")
    return sums.withColumn("class", kind).drop("c", "p", "i")
