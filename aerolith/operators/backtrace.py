"""Backward traces of events through the wind that was measured: residuals, particles, evidence by event, movement.

Every receptor of an event starts particles at its own time. At each step back they move against the wind interpolated at
their place and minute, and against an error of it, drawn from the validation's residuals and kept for a block of time.
Where the wind comes from is the user's choice: from stations (``Measured``), whose winds at each step are a snapshot in the row of some receptors of one time, so a task needs that row only; or from a
function (``Given``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log2
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TraceConfig, WindConfig
from ..functions.geo import EARTH_KM, M_PER_DEG_LAT, M_PER_DEG_LON, angle_between, bearing_deg, finite, haversine_km, toward_deg
from . import wind
from .graph import components, cut

#: Residuals of a bucket's pool that tasks are given at once, the first by hash; they ask for the others by number.
POOL = 2_000
#: Rows of a part of a pool that is put in order by itself, about.
ROWS_A_PART = 5_000
#: Particles that are moved at once: receptors of one time come to tasks in lists of about so many, so no row grows with the receptors of a time.
PARTICLES_AT_ONCE = 4_000
QUALITIES = ["INSUFFICIENT_STATIONS", "CALM / LOW_DIRECTION_CONFIDENCE", "HIGH_UNCERTAINTY", "MEDIUM_UNCERTAINTY", "GOOD"]
BUCKETS = ["unavailable", "≤3 km", "3–5 km", "5–10 km", ">10 km"]


def residual_table(validated: DataFrame) -> DataFrame:
    """(target, at, du, dv, bucket, quality) of ``wind.leave_one_out``: what was measured less what was predicted; rows without a prediction are left out."""
    known = finite("actual_u") & finite("actual_v") & finite("u") & finite("v")
    return validated.where(known).select("target", "at", (F.col("actual_u") - F.col("u")).alias("du"), (F.col("actual_v") - F.col("v")).alias("dv"), wind.distance_bucket("nearest_km").alias("bucket"), "quality")


def _numbered(residuals: DataFrame) -> DataFrame:
    """(bucket, quality, r, du, dv): residuals by their number in their pool, from zero, in the order of a hash. They are numbered in parts of a pool, which are ranges of hashes, so no task sorts a whole pool."""
    keys, by_hash = ["bucket", "quality"], F.xxhash64("target", "at")
    bits = max(1, ceil(log2(residuals.count() / ROWS_A_PART + 1)))
    parted = residuals.withColumn("_part", F.shiftright(by_hash, 64 - bits))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(by_hash, "target", "at", "du", "dv")) - 1
    return parted.withColumn("_in", within).join(starts, [*keys, "_part"]).select(*keys, (F.col("_start") + F.col("_in")).alias("r"), "du", "dv")


def _first(numbered: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    out: dict = {}
    for r in sorted(numbered.where(F.col("r") < POOL).collect()):
        out.setdefault((r.bucket, r.quality), []).append((r.du, r.dv))
    return {k: np.array(v) for k, v in out.items()}


def pools(residuals: DataFrame) -> dict[tuple[str, str], np.ndarray]:
    """The first residuals by (distance bucket, quality), ``POOL`` of each, so what is collected is of a fixed size; ``whole_pools`` has all."""
    return _first(_numbered(residuals))


@dataclass(frozen=True)
class Pools:
    """Residuals by (distance bucket, quality): how many, the first of them, and a table (bucket, quality, r, du, dv) of all others, whose numbers r count from zero."""

    sizes: dict[tuple[str, str], int]
    first: dict[tuple[str, str], np.ndarray]
    others: DataFrame | None = None


def whole_pools(residuals: DataFrame) -> Pools:
    """All residuals by (distance bucket, quality), in the order of ``pools``. Only the first ones and the pools' sizes reach the driver."""
    numbered = cut(_numbered(cut(residuals)))
    sizes = {(r.bucket, r.quality): r["n"] for r in numbered.groupBy("bucket", "quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Pools(sizes, _first(numbered), numbered.where(F.col("r") >= POOL) if max(sizes.values(), default=0) > POOL else None)


def drawn_from(keys: list[tuple[str, str]], bucket: str, quality: str) -> tuple[str, list[tuple[str, str]]]:
    """The pools to draw from: of the bucket and the quality, else of the distance, else of the quality, else all; and which it is."""
    if (bucket, quality) in keys:
        return "exact_bucket", [(bucket, quality)]
    for name, at, value in (("distance_fallback", 0, bucket), ("quality_fallback", 1, quality)):
        some = [k for k in sorted(keys) if k[at] == value]
        if some:
            return name, some
    return ("global_fallback", sorted(keys)) if keys else ("none", [])


def fallback(pool: dict[tuple[str, str], np.ndarray], bucket: str, quality: str) -> tuple[str, np.ndarray]:
    """``drawn_from`` of pools at hand: their residuals, and which it is."""
    name, keys = drawn_from(list(pool), bucket, quality)
    return name, np.vstack([pool[k] for k in keys]) if keys else np.zeros((1, 2))


def estimate(lat: np.ndarray, lon: np.ndarray, s: np.ndarray, cfg: WindConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Wind (u, v), nearest station and quality at places, as ``wind.idw`` gives them; NaN where too few stations are near.

    ``s`` has a row for each station with a value then: lat, lon, u, v, calm, offset in seconds, whether from one side only.
    """
    n = len(lat)
    if not len(s):
        return np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, int)
    a, b, c, d = np.radians(lat)[:, None], np.radians(lon)[:, None], np.radians(s[:, 0])[None, :], np.radians(s[:, 1])[None, :]
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    km = 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))
    limit = np.where((km <= cfg.preferred_km).sum(axis=1) >= cfg.min_stations, min(cfg.preferred_km, cfg.max_km), cfg.max_km)
    near = np.argsort(km, axis=1, kind="stable")[:, : cfg.max_stations]
    km = np.take_along_axis(km, near, axis=1)
    used = km <= limit[:, None]
    count = used.sum(axis=1)
    w = np.where(used, 1 / np.maximum(km, cfg.epsilon_km) ** cfg.power, 0)
    total = np.where(count > 0, w.sum(axis=1), 1)
    u, v = (w * s[near, 2]).sum(axis=1) / total, (w * s[near, 3]).sum(axis=1) / total
    spread = np.sqrt(np.maximum((w * (s[near, 2] ** 2 + s[near, 3] ** 2)).sum(axis=1) / total - u * u - v * v, 0))
    nearest, farthest = np.where(used, km, np.inf).min(axis=1), np.where(used, km, -np.inf).max(axis=1)
    offset, one_sided, calm = np.where(used, s[near, 5], 0).max(axis=1), (used & (s[near, 6] > 0)).any(axis=1), (used & (s[near, 4] > 0)).sum(axis=1)
    high = (spread >= 2) | (nearest > 20) | (farthest > 25) | (offset > 600)
    medium = (spread >= 1) | (nearest > 10) | (farthest > 15) | (count < 5) | one_sided
    few = count < cfg.min_stations
    quality = np.select([few, calm >= np.ceil(count / 2), high, medium], [0, 1, 2, 3], 4)
    return np.where(few, np.nan, u), np.where(few, np.nan, v), np.where(count > 0, nearest, np.nan), quality


def _bucket_index(km: np.ndarray) -> np.ndarray:
    return np.select([np.isnan(km), km <= 3, km <= 5, km <= 10], [0, 1, 2, 3], 4)


class Measured:
    """The wind as stations measured it, interpolated at a particle's place and time."""

    def __init__(self, obs: DataFrame, stations: DataFrame, cfg: WindConfig):
        self.obs, self.stations, self.cfg = obs, stations, cfg

    def fields(self, times: DataFrame, cfg: TraceConfig, box: tuple[float, float, float, float]) -> DataFrame:
        """(seed_t, field) of ``times``, which are distinct: for each step back the winds of the stations that a particle in the box (west, south, east, north in degrees) can use, seven numbers each. The steps are of a fixed number."""
        pad = self.cfg.max_km / 110.0
        west, south, east, north = box
        lon_pad = pad / max(0.1, float(np.cos(np.radians(max(abs(south), abs(north))))))
        near = self.stations.where(F.col("lat").between(south - pad, north + pad) & F.col("lon").between(west - lon_pad, east + lon_pad)).select("station_id", "lat", "lon")
        steps = cfg.minutes * 60 // cfg.dt_seconds
        asked = times.select("seed_t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).withColumn("at", F.col("seed_t") - F.col("step") * cfg.dt_seconds)
        have = wind.temporal_select(self.obs.join(near.select("station_id"), "station_id", "left_semi"), asked.select("at"), self.cfg).join(near, "station_id")
        row = F.struct("station_id", "lat", "lon", "u", "v", F.col("calm").cast("double").alias("calm"), F.col("offset_s").cast("double").alias("offset"), (F.col("kind") == "nearest_only").cast("double").alias("one_sided"))
        numbers = lambda w: F.array(*[w[c] for c in ("lat", "lon", "u", "v", "calm", "offset", "one_sided")])
        then = have.groupBy("at").agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), numbers)).alias("winds"))
        return asked.join(then, "at", "left").groupBy("seed_t").agg(F.array_sort(F.collect_list(F.struct("step", "winds"))).alias("field"))

    def at(self) -> Callable:
        """(field, step, lat, lon, t) -> wind (u, v), nearest station and quality; what tasks are given."""
        cfg = self.cfg

        def found(field, step: int, lat: np.ndarray, lon: np.ndarray, t: int):
            got = next((f["winds"] for f in field if f["step"] == step), None)
            return estimate(lat, lon, np.array([] if got is None else got, dtype=float).reshape(-1, 7), cfg)

        return found


class Given:
    """A wind that the user gives: ``wind(lat, lon, t)`` takes arrays of degrees and a time in seconds, and returns arrays u and v in metres a second, NaN where it knows none.

    It is asked in tasks, for each place and minute once a task: places are rounded to ``decimals`` of a degree, times to whole minutes. A wind that is a table is no function: hand its points to
    ``Measured`` as stations.
    """

    def __init__(self, wind: Callable, decimals: int = 4, most: int = 1_000_000):
        self.wind, self.decimals, self.most = wind, decimals, most

    def fields(self, times: DataFrame, cfg: TraceConfig, box: tuple[float, float, float, float]) -> DataFrame:
        return times.withColumn("field", F.lit(None).cast("string"))

    def at(self) -> Callable:
        given, decimals, most, known = self.wind, self.decimals, self.most, {}

        def found(field, step: int, lat: np.ndarray, lon: np.ndarray, t: int):
            minute = int(t) // 60 * 60
            keys = list(zip(np.round(lat, decimals).tolist(), np.round(lon, decimals).tolist(), strict=True))
            new = [k for k in dict.fromkeys(keys) if (*k, minute) not in known]
            if new:
                if len(known) > most:
                    known.clear()
                    new = list(dict.fromkeys(keys))
                places = np.array(new)
                u, v = given(places[:, 0], places[:, 1], minute)
                known.update({(*k, minute): w for k, w in zip(new, zip(np.broadcast_to(u, len(new)).tolist(), np.broadcast_to(v, len(new)).tolist(), strict=True), strict=True)})
            uv = np.array([known[(*k, minute)] for k in keys], dtype=float).reshape(-1, 2)
            # a wind without stations counts as near and good
            return uv[:, 0], np.where(np.isnan(uv[:, 0]), np.nan, uv[:, 1]), np.zeros(len(uv)), np.full(len(uv), len(QUALITIES) - 1)

        return found


def even(u: float, v: float) -> Given:
    """The same wind everywhere and always."""
    return Given(lambda lat, lon, t: (np.full(len(lat), u), np.full(len(lat), v)))


def _lists(seeds: DataFrame, most: int) -> DataFrame:
    """(seed_t, part, receptors): the receptors of each time in lists of about ``most``. Which list a receptor is in bears on no result."""
    n = seeds.groupBy("seed_t").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("event_id", "station_id"), F.ceil(F.col("_n") / most))
    return seeds.join(n, "seed_t").groupBy("seed_t", part.alias("part")).agg(F.collect_list(F.struct("event_id", "station_id", "lat", "lon")).alias("receptors"))


#: What a trace gives, and what a list of receptors needs to go on: its block, places, ends and draws by source, and the particles, pools and numbers of the residuals that it asks for.
PASSED = "event_id string, station_id long, ci int, cj int, at long, hits long, ended string, source string"
PAUSED = "seed_t long, part long, block long, pos array<double>, over array<long>, drew array<long>, ask_i array<long>, ask_k array<long>, ask_r array<long>"


def trace(seeds: DataFrame, source: Measured | Given, pool: Pools | dict, cfg: TraceConfig, lat0: float, lon0: float, extent: tuple[float, float, float, float], cells: bool = True) -> DataFrame:
    """(event_id, station_id, ci, cj, at, hits, ended, source): where each receptor's particles passed, and how they ended.

    ``seeds`` has event_id, station_id, seed_t, lat, lon, a row for each receptor; ``extent`` is west, south, east, north in metres from the origin. Rows with a cell count the
    particles in it at a time (none if ``cells`` is false); rows with ``ended`` count the particles that reached the time limit, left the extent or had no wind; rows with
    ``source`` count from which pool errors were drawn. Draws depend on the seed and the receptor alone. A seed without time or place ends without wind; empty tables give an empty table.
    Receptors of one time see the same winds, so a time's winds are gathered once and its particles are moved together.

    Every residual of a pool is drawn alike. Where ``pool`` has others than the first ones, particles stop at the start of a block, ask for theirs by number in a join, and go on: as many rounds as blocks, and one more.
    """
    pool = pool if isinstance(pool, Pools) else Pools({k: len(v) for k, v in pool.items()}, pool)
    steps, per_block, n, dt, size = cfg.minutes * 60 // cfg.dt_seconds, max(1, cfg.block_seconds // cfg.dt_seconds), cfg.particles, cfg.dt_seconds, cfg.cell_m
    k = M_PER_DEG_LON * float(np.cos(np.radians(lat0)))
    west, south, east, north = extent
    keys, others = sorted(pool.sizes), pool.others
    sizes, first = np.array([pool.sizes[x] for x in keys], dtype=np.int64), [np.asarray(pool.first[x], dtype=float) for x in keys]
    held = np.array([len(x) for x in first], dtype=np.int64)
    chosen = [(name, np.array([keys.index(x) for x in some], dtype=np.int64)) for name, some in (drawn_from(keys, b, q) for b in BUCKETS for q in QUALITIES)]
    names, ends, most = sorted({name for name, _ in chosen}), ["", "domain_limit", "time_limit", "wind_unavailable"], max(1, PARTICLES_AT_ONCE // n)
    blocks, wind_at, schema = -(-steps // per_block), source.at(), PASSED if others is None else f"{PASSED}, {PAUSED}"
    columns = [c.split()[0] for c in schema.split(", ")]

    def outside(p: np.ndarray) -> np.ndarray:
        return (p[:, 0] < west) | (p[:, 0] > east) | (p[:, 1] < south) | (p[:, 1] > north)

    def draws(event_id: str, station: int) -> np.ndarray:
        return np.random.Generator(np.random.Philox(key=[cfg.seed, zlib.crc32(f"{event_id}|{station}".encode())])).random((blocks, n))

    def numbered(kind: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pool that each draw of a kind of wind falls into, and its number there; -1 where there are no residuals."""
        of, r = np.full(len(kind), -1, dtype=np.int64), np.zeros(len(kind), dtype=np.int64)
        for x in np.unique(kind).tolist():
            some, here = chosen[x][1], kind == x
            if len(some):
                upto = np.cumsum(sizes[some])
                at = (drawn[here] * upto[-1]).astype(np.int64)
                which = np.searchsorted(upto, at, side="right")
                of[here], r[here] = some[which], at - (upto - sizes[some])[which]
        return of, r

    def moved(t0: int, receptors: list, field, part: int = 0, state=None) -> Iterator[pd.DataFrame]:
        events, stations = np.array([r["event_id"] for r in receptors], dtype=object), np.array([int(r["station_id"]) for r in receptors])
        lat, lon = np.array([r["lat"] for r in receptors]), np.array([r["lon"] for r in receptors])
        count, of = len(receptors), np.repeat(np.arange(len(receptors)), n)
        pos = np.repeat(np.column_stack([(lon - lon0) * k, (lat - lat0) * M_PER_DEG_LAT]), n, axis=0)
        drawn = np.concatenate([draws(e, s) for e, s in zip(events, stations.tolist(), strict=True)], axis=1)
        ended, error, sources, passed, block = np.zeros(len(of), dtype=int), np.zeros((len(of), 2)), np.zeros((count, len(names)), dtype=int), [], 0
        if state is not None:
            block, pos, ended, sources = int(state.block), np.array(state.pos, dtype=float).reshape(-1, 2), np.array(state.over, dtype=int), np.array(state.drew, dtype=int).reshape(count, -1)

        def rows(r: np.ndarray, hits: np.ndarray, **more) -> pd.DataFrame:
            missing = pd.array([pd.NA] * len(r), dtype="Int64")
            out = {"event_id": events[r], "station_id": stations[r], "ci": missing, "cj": missing, "at": missing, "hits": hits, "ended": None, "source": None}
            return pd.DataFrame(dict.fromkeys(columns) | out | more)

        for s in range(block * per_block, steps):
            live = np.flatnonzero(ended == 0)
            gone = outside(pos[live])
            ended[live[gone]] = ends.index("domain_limit")
            live = live[~gone]
            if not len(live):
                break
            u, v, nearest, quality = wind_at(field, s, lat0 + pos[live, 1] / M_PER_DEG_LAT, lon0 + pos[live, 0] / k, t0 - s * dt)
            ok = ~np.isnan(u)
            ended[live[~ok]] = ends.index("wind_unavailable")
            live, u, v, kind = live[ok], u[ok], v[ok], _bucket_index(nearest[ok]) * len(QUALITIES) + quality[ok]
            if s % per_block == 0:
                which, r = numbered(kind, drawn[s // per_block, live])
                ask = (which >= 0) & (r >= held[which]) if len(held) else np.zeros(len(live), dtype=bool)
                if ask.any() and (state is None or int(state.block) != s // per_block):
                    paused = {"seed_t": t0, "part": part, "block": s // per_block, "pos": pos.ravel(), "over": ended, "drew": sources.ravel(), "ask_i": live[ask], "ask_k": which[ask], "ask_r": r[ask]}
                    yield pd.DataFrame({c: [paused.get(c)] for c in columns})
                    break
                if ask.any():
                    if len(state.got_i) != ask.sum():
                        raise ValueError(f"{ask.sum()} residuals were asked for, {len(state.got_i)} came")
                    error[np.array(state.got_i, dtype=int)] = np.column_stack([state.got_u, state.got_v])
                for x in np.unique(which[~ask]).tolist():
                    here = (which == x) & ~ask
                    error[live[here]] = first[x][r[here]] if x >= 0 else 0.0
                for x in np.unique(kind).tolist():
                    sources[:, names.index(chosen[x][0])] += np.bincount(of[live[kind == x]], minlength=count)
            pos[live] -= (np.column_stack([u, v]) + error[live]) * dt
            left = outside(pos[live])
            ended[live[left]] = ends.index("domain_limit")
            if cells and not left.all():
                cell = np.column_stack([of[live[~left]], np.floor(pos[live[~left]] / size).astype(int)])
                cell = cell[np.lexsort(cell.T[::-1])]
                new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
                passed.append(np.column_stack([cell[new], np.full(len(new), int(t0) - (s + 1) * dt), np.diff(np.r_[new, len(cell)])]))
        else:
            ended[ended == 0] = ends.index("time_limit")
        if passed:
            r, ci, cj, at, hits = np.concatenate(passed).T
            yield rows(r, hits, ci=ci, cj=cj, at=at)
        if not (ended == 0).any():
            for labels, counts, column in ((ends, np.bincount(of * len(ends) + ended, minlength=count * len(ends)).reshape(count, -1), "ended"), (names, sources, "source")):
                r, j = np.nonzero(counts)
                yield rows(r, counts[r, j], **{column: np.array(labels, dtype=object)[j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                yield from moved(r.seed_t, r.receptors, r.field, r.part, r if "pos" in b.columns else None)

    box = (lon0 + west / k, lat0 + south / M_PER_DEG_LAT, lon0 + east / k, lat0 + north / M_PER_DEG_LAT)
    seeds = seeds.select("event_id", F.col("station_id").cast("long").alias("station_id"), "seed_t", "lat", "lon").distinct()
    nowhere = reduce(or_, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in ("seed_t", "lat", "lon")])
    lists = _lists(seeds.where(~nowhere), most)
    fields = lists.join(source.fields(seeds.where(~nowhere).select("seed_t").distinct(), cfg, box), "seed_t")
    dealt = fields.repartition("seed_t", F.col("receptors")[0]["station_id"])
    out = dealt.mapInPandas(run, schema) if others is None else _in_rounds(cut(dealt), others, keys, run, schema)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    lost = seeds.where(nowhere).select("event_id", "station_id", none("ci", "int"), none("cj", "int"), none("at", "long"), F.lit(n).cast("long").alias("hits"), F.lit("wind_unavailable").alias("ended"), none("source", "string"))
    return out.unionByName(lost)


def _in_rounds(lists: DataFrame, others: DataFrame, keys: list[tuple[str, str]], run: Callable, schema: str) -> DataFrame:
    """The rows of all rounds: lists of receptors go on until none asks for residuals. What a round gives is written, with the state of those that go on."""
    pool = F.array_position(F.array(*[F.lit(f"{b}|{q}") for b, q in keys]), F.concat_ws("|", "bucket", "quality")) - 1
    have, at, done, todo = others.select(pool.cast("long").alias("ask_k"), F.col("r").cast("long").alias("ask_r"), "du", "dv"), ["seed_t", "part"], [], lists
    while True:
        made = cut(todo.mapInPandas(run, schema))
        done.append(made.where("seed_t is null").select(*[c.split()[0] for c in PASSED.split(", ")]))
        paused = made.where("seed_t is not null").select(*[c.split()[0] for c in PAUSED.split(", ")])
        if paused.isEmpty():
            return reduce(DataFrame.unionByName, done)
        asked = paused.select(*at, F.explode(F.arrays_zip("ask_i", "ask_k", "ask_r")).alias("a")).select(*at, "a.*")
        got = asked.join(have, ["ask_k", "ask_r"]).groupBy(*at).agg(F.collect_list(F.struct("ask_i", "du", "dv")).alias("g"))
        state = paused.drop("ask_i", "ask_k", "ask_r").join(got.select(*at, F.col("g.ask_i").alias("got_i"), F.col("g.du").alias("got_u"), F.col("g.dv").alias("got_v")), at)
        todo = lists.join(state, at)


def event_receptors(members: DataFrame) -> DataFrame:
    """(event_id, station_id, seed_t, lat, lon, weight) of each event: a station's first seed, else its first support, with its normalised role weight."""
    rank = F.struct(F.col("role") != "seed", "bucket")
    one = members.groupBy("event_id", "station_id").agg(F.min_by(F.struct("bucket", "role", "anomaly_score", "lat", "lon"), rank).alias("m")).select("event_id", "station_id", "m.*")
    weight = F.when(F.col("role") == "seed", 1.0).otherwise(0.75) * (0.75 + 0.25 * F.least(F.col("anomaly_score") / 10, F.lit(1.0)))
    total = F.sum("w").over(Window.partitionBy("event_id"))
    return one.withColumn("w", weight).withColumn("weight", F.col("w") / total).select("event_id", "station_id", F.col("bucket").alias("seed_t"), "lat", "lon", "weight")


def surface(passed: DataFrame, seeds: DataFrame, cfg: TraceConfig) -> DataFrame:
    """(event_id, ci, cj, density, support_count, support_fraction, score, times): the evidence of each event, its scores scaled to one, and when particles were there."""
    steps = cfg.minutes * 60 // cfg.dt_seconds
    weighted = passed.where("ci is not null").join(seeds.select("event_id", "station_id", "weight"), ["event_id", "station_id"])
    n = seeds.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    grid = weighted.groupBy("event_id", "ci", "cj").agg(F.sum(F.col("hits") * F.col("weight") / (steps * cfg.particles)).alias("density"), F.countDistinct("station_id").alias("support_count"), F.array_sort(F.collect_set("at")).alias("times"))
    out = grid.join(n, "event_id").withColumn("support_fraction", F.col("support_count") / F.col("n"))
    top = out.groupBy("event_id").agg(F.max("density").alias("top"))
    out = out.join(top, "event_id").withColumn("raw", F.col("density") / F.col("top") * (0.25 + 0.75 * F.col("support_fraction")))
    most = out.groupBy("event_id").agg(F.max("raw").alias("most"))
    return out.join(most, "event_id").withColumn("score", F.col("raw") / F.col("most")).drop("n", "top", "raw", "most")


def regions(grid: DataFrame, share: float = 0.6, limit: int = 5, cell_m: float = 250.0) -> DataFrame:
    """Of each event the strongest regions of touching cells (eight neighbours) that reach a share of its peak: centroid, bounds, area, scores, support and times."""
    high = cut(grid.where(F.col("score") >= share))
    key = lambda a, b: F.struct(F.col("event_id").alias("e"), F.col(a).alias("i"), F.col(b).alias("j"))
    around = F.explode(F.array(*[F.struct(F.col("event_id").alias("e"), (F.col("ci") + a).cast("int").alias("i"), (F.col("cj") + b).cast("int").alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    ids = high.select(key("ci", "cj").alias("id"))
    edges = high.select(key("ci", "cj").alias("u"), around.alias("v")).join(ids.select(F.col("id").alias("v")), "v", "left_semi")
    each = high.withColumn("id", key("ci", "cj")).join(components(ids, edges), "id")
    centre = lambda c: F.sum(F.col("score") * (F.col(c) + 0.5) * cell_m) / F.sum("score")
    out = each.groupBy("event_id", "root").agg(
        F.count(F.lit(1)).alias("cells"), F.max("score").alias("peak"), F.avg("score").alias("mean"), F.sum("score").alias("total"), centre("ci").alias("x"), centre("cj").alias("y"),
        (F.min("ci") * cell_m).alias("west"), ((F.max("ci") + 1) * cell_m).alias("east"), (F.min("cj") * cell_m).alias("south"), ((F.max("cj") + 1) * cell_m).alias("north"),
        F.max("support_count").alias("support"),
    )
    when = each.select("event_id", "root", F.explode("times").alias("x")).groupBy("event_id", "root").agg(F.array_sort(F.collect_set("x")).alias("times"))
    out = out.join(when, ["event_id", "root"], "left")
    w = Window.partitionBy("event_id").orderBy(F.desc(F.round("peak", 9)), F.desc(F.round("total", 9)), "root")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("area_km2", F.col("cells") * cell_m * cell_m / 1e6).drop("root")


def top_region_distance(points: DataFrame, found: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """``points`` (point_id, event_id, lat, lon) with ``region_km``, the distance to the nearest region of their event; null where it has none."""
    k = M_PER_DEG_LON * float(np.cos(np.radians(lat0)))
    centres = found.select("event_id", (lat0 + F.col("y") / M_PER_DEG_LAT).alias("r_lat"), (lon0 + F.col("x") / k).alias("r_lon"))
    near = points.join(centres, "event_id").groupBy("event_id", "point_id").agg(F.min(haversine_km("lat", "lon", "r_lat", "r_lon")).alias("region_km"))
    return points.join(near, ["event_id", "point_id"], "left")


def movement(path: DataFrame, obs: DataFrame, stations: DataFrame, wcfg: WindConfig, floor_km: float = 0.1) -> DataFrame:
    """(event_id, status, displacement_km, observed_deg, wind_deg, difference_deg): how an event's way agrees with the mean wind along it. ``path`` has event_id, bucket, lat, lon."""
    points = path.select("event_id", F.col("bucket").alias("at"), "lat", "lon")
    keys = ["event_id", "at", "lat", "lon"]
    winds = wind.idw(points, wind.temporal_select(obs, points, wcfg), stations, keys, wcfg).where(F.hypot("u", "v") > 1e-9).groupBy("event_id").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    place = F.struct("lat", "lon")
    ends = points.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(place, "at").alias("a"), F.max_by(place, "at").alias("b")).join(winds, "event_id", "left")
    out = ends.select("event_id", "n", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("lat", "lon")], toward_deg("u", "v").alias("wind_deg"))
    out = out.withColumns({"displacement_km": F.when(F.col("n") > 1, haversine_km("a_lat", "a_lon", "b_lat", "b_lon")), "observed_deg": bearing_deg("a_lat", "a_lon", "b_lat", "b_lon")})
    status = F.when(F.col("n") < 2, "INSUFFICIENT_CENTROID_PATH").when(F.col("displacement_km") < floor_km, "MOVEMENT_TOO_SMALL").when(F.col("wind_deg").isNull(), "WIND_UNAVAILABLE").otherwise("OK")
    moved = status.isin("OK", "WIND_UNAVAILABLE")
    return out.select("event_id", status.alias("status"), "displacement_km", F.when(moved, F.col("observed_deg")).alias("observed_deg"), F.when(moved, F.col("wind_deg")).alias("wind_deg"), F.when(moved, angle_between("observed_deg", "wind_deg")).alias("difference_deg"))
