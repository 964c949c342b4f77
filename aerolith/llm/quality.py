"""Quality classification by co-training of a text view and a metadata view.

The text view sees hashed character trigrams. The metadata view sees what is known of a page besides its
text: source, language and recorded size. Each is a logistic
regression. In every round both views score all unlabelled documents, and each hands the distinct ones that it is surest of
to the other view to learn from. At the end both are calibrated (Platt) on labelled documents
that neither learned from. The views tell of a document independently, so their calibrated log-odds are added, less the
log-odds of the class that both contain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import ngrams
from .common import forget_tables, materialise, text_batches

#: Bounds of the fit: labelled documents of each class, rounds, and documents passed on per view, class and round.
LABELLED, ROUNDS, PASSED, SURE = 1000, 3, 100, 0.9
TEXT_BITS, SOURCE_SLOTS, LANG_SLOTS, AT_ONCE = 11, 64, 16, 256
COLUMNS = {"text": "string", "source": "string", "lang": "string", "n_chars": "double"}


def text_view(text: str | None) -> np.ndarray:
    x = np.sqrt(ngrams.counts(ngrams.codes(text or ""), (3,), TEXT_BITS))
    return (x / (np.linalg.norm(x) or 1)).astype(np.float32)


def metadata_view(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(2 + SOURCE_SLOTS + LANG_SLOTS, dtype=np.float32)
    if n_chars is not None and np.isfinite(n_chars) and n_chars >= 0:
        out[:2] = np.log1p(n_chars) / 10, 1
    for at, size, v in ((2, SOURCE_SLOTS, source), (2 + SOURCE_SLOTS, LANG_SLOTS, lang)):
        if v is not None:
            out[at + zlib.crc32(v.encode("utf-8", "surrogatepass")) % size] = 0.5
    return out


def views(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch's rows."""
    wide = 2 + SOURCE_SLOTS + LANG_SLOTS
    meta = [metadata_view(s, v, None if pd.isna(n) else float(n)) for s, v, n in zip(b["source"], b["lang"], b["n_chars"], strict=True)]
    return np.array([text_view(t) for t in b["text"]], dtype=np.float32).reshape(-1, 1 << TEXT_BITS), np.array(meta, dtype=np.float32).reshape(-1, wide)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of at most ``AT_ONCE`` rows, for a row's features are larger than the row."""
    forget_tables()
    for b in batches:
        for at in range(0, len(b), AT_ONCE):
            yield b.iloc[at : at + AT_ONCE]


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _features(docs: DataFrame, y: str) -> list:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _cut(batches):
            va, vb = views(b)
            yield pd.DataFrame({"y": b["y"], "a": [x.tobytes() for x in va], "b": [x.tobytes() for x in vb]})

    rows = docs.select(*COLUMNS, F.expr(y).cast("double").alias("y")).mapInPandas(run, "y double, a binary, b binary").collect()
    return sorted(rows, key=lambda r: (zlib.crc32(r.a), r.a, r.b, r.y))


def surest(docs: DataFrame, models: list[np.ndarray], passed: set[int]) -> list:
    """(view, y, h): of all ``docs`` the ``PASSED`` distinct texts that each view is surest of, per class, without those already passed on.

    A task keeps as many of each kind; only hashes of texts leave it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple[int, int], dict[int, float]] = {(v, y): {} for v in (0, 1) for y in (0, 1)}
        for b in _cut(batches):
            h = b["h"].to_numpy()
            for v, x in enumerate(views(b)):
                p = np.round(ngrams.sigmoid(_logit(x, models[v])), 6)  # so that equal rows tie wherever they are scored
                for y in (0, 1):
                    mine = kept[v, y]
                    sure = p if y else 1 - p
                    for i in np.flatnonzero(sure >= SURE).tolist():
                        if h[i] not in passed:
                            mine[int(h[i])] = max(mine.get(int(h[i]), 0.0), float(sure[i]))
                    if len(mine) > PASSED:
                        kept[v, y] = dict(sorted(mine.items(), key=lambda t: (-t[1], t[0]))[:PASSED])
        yield from [pd.DataFrame({"view": v, "y": y, "h": list(mine), "sure": list(mine.values())}) for (v, y), mine in kept.items() if mine]

    each = docs.select(*COLUMNS, F.xxhash64("text").alias("h")).mapInPandas(run, "view int, y int, h long, sure double").groupBy("view", "y", "h").agg(F.max("sure").alias("sure"))
    first = Window.partitionBy("view", "y").orderBy(F.desc("sure"), "h")
    return each.withColumn("r", F.row_number().over(first)).where(F.col("r") <= PASSED).select("view", "y", "h").collect()


def co_train(xa: np.ndarray, xb: np.ndarray, y: np.ndarray, pass_on) -> dict:
    """Fits both views on three of four labelled examples and what they pass to each other, and calibrates on the fourth.

    ``pass_on(models)`` gives what both views are surest of: (view that learns from it, class, both views' features).
    """
    hold = np.arange(len(y)) % 4 == 3
    seen = [[x[~hold]] for x in (xa, xb)]
    told = [[y[~hold]], [y[~hold]]]
    for r in range(ROUNDS + 1):
        models = []
        for v in (0, 1):
            x, t = np.vstack(seen[v]), np.concatenate(told[v])
            balance = np.where(t == 1, 0.5 / max((t == 1).sum(), 1), 0.5 / max((t == 0).sum(), 1))
            models.append(ngrams.fit_logistic(x, t, balance, l2=1e-4, steps=150))
        if r == ROUNDS:
            break
        for to, k, both in pass_on(models):
            seen[to].append(both[to][None, :])
            told[to].append(np.array([k]))
    scales = [ngrams.platt(_logit(x[hold], m), y[hold]) for x, m in zip((xa, xb), models, strict=True)]
    good = (y[hold] == 1).sum()
    return {"models": models, "scales": scales, "prior": float(np.log((good + 1) / (hold.sum() - good + 1)))}


def _read(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns that the views see, null where the table lacks them."""
    return text_batches(docs).select(*[(docs[c] if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()], *more)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> dict | None:
    """A model from ``docs`` and ``labels`` (doc_id, quality 0/1); None where a class has fewer than eight documents.

    Of each class at most ``LABELLED`` labelled documents take part, chosen by a hash of the id: this bound is the only sampling. All other documents
    are the unlabelled pool, which every round scores whole. Labels with null parts are left out, several labels of a document are averaged.
    """
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y")).where("_id is not null and y is not null")
    h = F.xxhash64("_id")
    chosen = materialise(known.where("y = 1").orderBy(h, "_id").limit(LABELLED).union(known.where("y = 0").orderBy(h, "_id").limit(LABELLED)))
    read = _read(docs, docs[id_col].alias("_id"))
    # at most 2 * LABELLED ids: a bounded side
    rows = _features(read.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]), "y")
    y = np.array([r.y for r in rows])
    if min((y == 1).sum(), (y == 0).sum()) < 8:
        return None
    pool = read.join(F.broadcast(chosen.select("_id")), "_id", "left_anti")
    passed: set[int] = set()

    def pass_on(models):
        picks = surest(pool, models, passed)
        if not picks:
            return []
        passed.update(p.h for p in picks)
        # at most 4 * PASSED texts
        at = docs.sparkSession.createDataFrame([(p.h, p.view, p.y) for p in picks], "h long, view int, y int")
        texts = pool.withColumn("h", F.xxhash64("text")).join(F.broadcast(at.select("h").distinct()), "h").dropDuplicates(["h"])
        made = {int(r.y): [np.frombuffer(x, dtype=np.float32) for x in (r.a, r.b)] for r in _numbered(texts)}
        return [(1 - p.view, p.y, made[p.h]) for p in sorted(picks)]

    matrix = lambda k: np.stack([np.frombuffer(getattr(r, k), dtype=np.float32) for r in rows])
    return co_train(matrix("a"), matrix("b"), y, pass_on)


def _numbered(texts: DataFrame) -> list:
    """Features of distinct texts, ``y`` being the hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _cut(batches):
            va, vb = views(b)
            yield pd.DataFrame({"y": b["h"], "a": [x.tobytes() for x in va], "b": [x.tobytes() for x in vb]})

    return texts.select(*COLUMNS, "h").mapInPandas(run, "y long, a binary, b binary").collect()


def combined(model: dict, va: np.ndarray, vb: np.ndarray) -> np.ndarray:
    """The probability of good quality by both views."""
    (wa, wb), ((aa, ba), (ab, bb)) = model["models"], model["scales"]
    return ngrams.sigmoid(aa * _logit(va, wa) + ba + ab * _logit(vb, wb) + bb - model["prior"])


def score_column(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Column:
    """A score from 0 to 1 for every row of ``docs``: the probability of good quality, by both views.

    Null and empty texts are scored as texts without characters; null sources, languages and sizes, and columns that are
    missing, have no say. Without a model (see ``fit``) every score is 1. Nothing is shuffled.
    """
    model = fit(docs, labels, id_col)
    if model is None:
        return F.lit(1.0)

    @pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in parts:
            whole = pd.DataFrame(dict(zip(COLUMNS, columns, strict=True)))
            yield pd.Series(np.concatenate([combined(model, *views(b)) for b in _cut(iter([whole]))] or [np.zeros(0)]))

    return score(*[(docs[c] if c in docs.columns else F.lit(None)).cast(t) for c, t in COLUMNS.items()])


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with ``score_column`` for every row; a column of that name is replaced."""
    return docs.withColumn(score_col, score_column(docs, labels, id_col))


def keep_good(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``at_least``; columns as they were."""
    return docs.where(score_column(docs, labels) >= at_least)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Score and decision for every row of ``documents``, learned from ``labels``; see ``scored`` for nulls, empty tables and labels without matches."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, labels, score_col="score")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
