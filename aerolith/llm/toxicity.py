"""Toxicity by a linear classifier whose scores may not hang on which group a sentence speaks of.

The features of a text are its different words and their beginnings, so that a stem counts in all its forms. In every labelled sentence that names a group the name is
swapped for the others of its family and for a blank, and the squared change of the score is added to the loss. So a name that toxic texts happen to use
gets no weight of its own, and a neutral mention of the group costs nothing. The fit sees a bounded sample of labelled documents; the
vocabulary and the differences that swaps make are counted by Spark, and only what a bounded model needs reaches the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import ngrams
from .common import forget_tables, materialise, text_batches

#: Bounds of the fit: labelled documents of each class, features, and different swaps (the most frequent).
LABELLED, FEATURES, SWAPS = 2_000, 4_096, 20_000
#: A feature occurs in so many of the sampled documents at least; penalties of size, of number of features, and of changes by swaps.
LEAST, L2, L1, FAIR, STEPS = 5, 1e-4, 1e-4, 10.0, 400
#: Families of names of groups, in the languages of the corpus; each may be swapped for the others of its family, or for the blank.
FAMILIES = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "children"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "believers"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"), ("black", "white", "asian", "latino", "african", "european", "american"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "transgender"), ("immigrants", "refugees", "foreigners", "citizens", "locals"), ("disabled", "blind", "deaf"),
    ("frauen", "männer", "leute"), ("muslime", "christen", "juden", "gläubige"), ("ausländer", "flüchtlinge", "bürger"),
    ("femmes", "hommes", "gens"), ("musulmans", "chrétiens", "juifs", "croyants"), ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "personas"), ("musulmanes", "cristianos", "judíos", "creyentes"), ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
BLANK = "_"
#: Lengths of the beginnings of words.
PREFIX = (3, 8)
WORD, SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]+")
#: Characters of a text whose words are held at once.
STRETCH = 1 << 20


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about ``STRETCH`` characters, cut at spaces where there are any."""
    at = 0
    while len(text) - at > STRETCH:
        cut = text.rfind(" ", at + 1, at + STRETCH)
        cut = cut if cut > at else at + STRETCH
        yield text[at:cut]
        at = cut
    yield text[at:]


def features(words: set[str]) -> set[str]:
    """Words, and their beginnings with an asterisk."""
    return words | {w[:k] + "*" for w in words for k in range(PREFIX[0], min(PREFIX[1], len(w) - 1) + 1)}


def grams(text: str | None) -> set[str]:
    """The features of a whole text."""
    words: set[str] = set()
    for part in stretches((text or "").lower()):
        words.update(WORD.findall(part))
    return features(words)


def held_out(id_col: Column) -> Column:
    """Whether a document's id is in the fifth that is never learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def vocabulary(sample: DataFrame, n: int, positive: int, families: tuple = FAMILIES) -> dict:
    """Feature -> index: the ``FEATURES`` that tell the classes apart best (chi-squared, ties by name), and all of the names of groups that occur."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        for b in batches:
            for at in range(0, len(b), 64):
                seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for y, t in zip(b["y"][at : at + 64], b["text"][at : at + 64], strict=True):
                    seen[int(y)].update(grams(t))
                every = list(seen[0] | seen[1])
                yield pd.DataFrame({"gram": every, "pos": [seen[1][g] for g in every], "neg": [seen[0][g] for g in every]})

    counts = sample.mapInPandas(run, "gram string, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= LEAST)
    have = F.col("pos") + F.col("neg")
    chi = F.pow(F.col("pos") * float(n) - have * float(positive), 2) / (have * (n - have) * float(positive) * (n - positive) + 1e-9)
    names = sorted({x for f in families for x in f})
    counts = materialise(counts.withColumn("chi", chi))
    best = [r.gram for r in counts.orderBy(F.desc("chi"), "gram").limit(FEATURES).collect()]
    best += [r.gram for r in counts.where(F.col("gram").isin(sorted(features(set(names))))).collect()]
    return {g: i for i, g in enumerate(sorted(set(best)))}


def swaps(text: str, families: tuple, vocab: dict) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """What each swap of a name in each sentence takes from its features and adds to them."""
    other = {x: [*(y for y in f if y != x), BLANK] for f in families for x in f}
    for part in stretches(text.lower()):
        for sentence in SENTENCE.split(part):
            words = set(WORD.findall(sentence))
            for name in sorted(words & other.keys()):
                have = features(words)
                for new in other[name]:
                    then = features(words - {name} | {new})
                    gone, come = (tuple(sorted(vocab[g] for g in x if g in vocab)) for x in (have - then, then - have))
                    if gone or come:
                        yield gone, come


def differences(sample: DataFrame, vocab: dict, families: tuple = FAMILIES) -> list:
    """(gone, come, n): how often a swap in a labelled sentence takes and adds the same features; the ``SWAPS`` most frequent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter(x for t in b["text"] for x in swaps(t or "", families, vocab))
            if n:
                yield pd.DataFrame({"gone": [list(g) for g, _ in n], "come": [list(c) for _, c in n], "n": list(n.values())})

    met = sample.mapInPandas(run, "gone array<int>, come array<int>, n long").groupBy("gone", "come").agg(F.sum("n").alias("n"))
    return met.orderBy(F.desc("n"), "gone", "come").limit(SWAPS).collect()


class Rows:
    """Sparse rows of ones (or given values), the last column being always zero."""

    def __init__(self, rows: list[np.ndarray], width: int, values: list[np.ndarray] | None = None):
        self.width = width
        self.at = np.concatenate([np.append(r, width) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.start = np.cumsum([0, *(len(r) + 1 for r in rows)])[:-1]
        self.sizes = np.array([len(r) + 1 for r in rows], dtype=np.int64)
        self.values = np.concatenate([np.append(v, 0.0) for v in values]) if values else np.ones(len(self.at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(w, 0.0)[self.at] * self.values, self.start) if len(self.at) else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, np.repeat(g, self.sizes) * self.values, self.width + 1)[:-1] if len(self.at) else np.zeros(self.width)


def descend(x: Rows, y: np.ndarray, weight: np.ndarray, d: Rows, n: np.ndarray, fair: float = FAIR, l1: float = L1, l2: float = L2, steps: int = STEPS) -> np.ndarray:
    """Weights, the bias last, that minimise mean log loss + fair / 2 * mean squared change + l1 |w| + l2 / 2 |w|^2, by accelerated proximal steps of a fixed number."""
    weight, n = weight / weight.sum(), n / max(n.sum(), 1)

    def curved(v: np.ndarray) -> np.ndarray:
        a = 0.25 * weight * (x.dot(v[:-1]) + v[-1])
        return np.append(x.back(a) + fair * d.back(n * d.dot(v[:-1])) + l2 * v[:-1], a.sum())

    v = np.ones(x.width + 1)
    for _ in range(30):
        v = curved(v) / np.linalg.norm(v)
    rate = 1 / (1.1 * np.linalg.norm(curved(v)) / np.linalg.norm(v) + l2)
    w = v = np.zeros(x.width + 1)
    t = 1.0
    for _ in range(steps):
        r = weight * (ngrams.sigmoid(x.dot(v[:-1]) + v[-1]) - y)
        step = v - rate * np.append(x.back(r) + fair * d.back(n * d.dot(v[:-1])) + l2 * v[:-1], r.sum())
        new = np.append(np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - rate * l1, 0), step[-1])
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", families: tuple = FAMILIES, fair: float = FAIR) -> dict | None:
    """A model from ``docs`` and ``labels`` (doc_id, toxic 0/1), without the held-out fifth; None where a class has fewer than eight documents.

    Of each class at most ``LABELLED`` documents take part, chosen by a hash of the id; equal texts count once, with the label that most of them have.
    Examples weigh as much as their class has labels, so the share of toxic documents is that of all labels. Labels with null parts are left out, several labels of a document are averaged.
    """
    known = labels.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y")).where("_id is not null and y is not null")
    known = materialise(known)
    of = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(LABELLED) for y in (0, 1)]
    chosen = materialise(first[0].union(first[1]))
    texts = text_batches(docs).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most 2 * LABELLED ids: a bounded side
    met = texts.join(F.broadcast(chosen), "_id").groupBy("text").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = materialise(met)
    have = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(have.get(0, 0), have.get(1, 0)) < 8:
        return None
    vocab = vocabulary(sample, have[0] + have[1], have[1], families)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [np.array(sorted(vocab[g] for g in grams(t) if g in vocab), dtype="<i4").tobytes() for t in b["text"]]
            yield pd.DataFrame({"y": b["y"], "at": at})

    rows = sorted(sample.mapInPandas(run, "y int, at binary").collect(), key=lambda r: (r.y, bytes(r.at)))
    y = np.array([r.y for r in rows], dtype=float)
    x = Rows([np.frombuffer(r.at, "<i4") for r in rows], len(vocab))
    met = differences(sample, vocab, families)
    ones = lambda r: np.concatenate([-np.ones(len(r.gone)), np.ones(len(r.come))])
    d = Rows([np.array([*r.gone, *r.come]) for r in met], len(vocab), [ones(r) for r in met])
    weight = np.where(y == 1, of[1] / have[1], of[0] / have[0])
    w = descend(x, y, weight, d, np.array([r.n for r in met], dtype=float), fair)
    return {"weights": {g: float(w[i]) for g, i in vocab.items() if w[i]}, "bias": float(w[-1])}


def toxic_score(model: dict, text: str | None) -> float:
    """From 0 to 1, rounded so that it doesn't depend on the order of the sum."""
    weights = model["weights"]
    z = model["bias"] + sum(sorted(weights[g] for g in weights.keys() & grams(text)))
    return round(float(ngrams.sigmoid(z)), 6)


def scored(docs: DataFrame, model: dict | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds a score from 0 to 1 from the whole text of every row; a column of that name is replaced.

    Null and empty texts are scored as texts without words, by the share of toxic labels alone. Without a model every score is 0. Nothing is shuffled.
    """
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_tables()
        for texts in parts:
            yield pd.Series([toxic_score(model, t) for t in texts], dtype=float)

    return text_batches(docs).withColumn(score_col, score(F.col(text_col).cast("string")))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and decision for every whole text of ``documents``, learned from ``labels`` without the held-out fifth; see ``scored`` for null and empty texts and ``fit`` for labels without matches."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
