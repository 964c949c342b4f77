"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The n-grams (one to three characters of lower-cased letters, anything else a single
space) are hashed; their document frequencies are counted over all training documents. The
weights come from follow-the-regularised-leader steps with L1 and L2 penalties on a bounded sample, and a temperature, fitted on
training documents that the weights didn't see, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import ngrams
from .common import text_batches

BITS, ORDERS = 14, (1, 2, 3)
#: Bounds of the fit: documents of each language, of which every fifth goes to the temperature; passes over them.
PER_LANGUAGE, EPOCHS = 400, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.001
UND = "und"


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters as one space; empty if it has no letter."""
    c = ngrams.codes((text or "").lower())
    ok = ngrams.table("alpha", str.isalpha)[np.minimum(c, 0x10000)]
    high = np.flatnonzero(c > 0xFFFF)
    if len(high):
        ok = ok.copy()
        ok[high] = [chr(x).isalpha() for x in c[high]]
    if not ok.any():
        return c[:0]
    out = np.where(ok, c, 32)
    keep = ok | np.append(True, ok[:-1])
    return np.concatenate([[32], out[keep], [32]]).astype(np.uint32)


def held_out(id_col: Column) -> Column:
    """Whether a document's id is in the quarter that is never learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the training texts each bucket occurs, and how many there are: over all of them, summed per task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for b in batches:
            for t in b["text"]:
                total += ngrams.counts(letters(t), ORDERS, BITS) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(total[at], n)})

    rows = train.select("text").mapInPandas(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(1 << BITS), 0
    for r in rows:
        if r.bucket < 0:
            n = r.df
        else:
            df[r.bucket] = r.df
    return df, n


def _vector(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = ngrams.counts(c, ORDERS, BITS)
    at = np.flatnonzero(k)
    x = (1 + np.log(k[at])) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) or 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (bucket, class) after ``EPOCHS`` passes of FTRL-proximal in a fixed shuffled order; most are exactly zero."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))

    def weights(zz, nn):
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            at, x, y = examples[i]
            w = weights(z[at], n[at])
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one of a fixed grid that gives the labels the highest likelihood."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    loss = [-np.mean([np.log(_softmax(z / t)[k] + 1e-12) for z, k in zip(logits, y, strict=True)]) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Learns from the text and the non-null language of documents that aren't held out.

    Document frequencies cover all of those; the weights see about ``PER_LANGUAGE`` of each language, never over twice as many, chosen by a hash of the text.
    """
    train = text_batches(docs).where(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    df, n = frequencies(train)
    sizes = {r.lang: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    # a share of each language by hash; the limit below only bounds unlucky draws
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, max(1, sizes[k] // PER_LANGUAGE))])[F.col("lang")]
    drawn = train.where(F.pmod(F.xxhash64("text"), share) == 0).dropDuplicates(["lang", "text"])
    idf = np.log((1 + n) / (1 + df)) + 1

    def run(batches):
        for b in batches:
            out = [_vector(letters(t), idf) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "at": [a.astype("<i4").tobytes() for a, _ in out], "x": [x.astype("<f4").tobytes() for _, x in out]})

    # one pass for all languages: the rank limit is applied before and after the shuffle
    first = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    some = drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2 * PER_LANGUAGE).select("lang", "text")
    rows = some.mapInPandas(run, "lang string, at binary, x binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.x)))
    made = [(np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4").astype(float), langs.index(r.lang)) for r in rows if r.at]
    w = ftrl([e for i, e in enumerate(made) if i % 5], len(langs))
    rest = [e for i, e in enumerate(made) if not i % 5]
    t = temperature(np.array([x @ w[at] for at, x, _ in rest]).reshape(len(rest), len(langs)), np.array([y for _, _, y in rest])) if rest else 1.0
    return {"langs": langs, "weights": w.astype(np.float32), "idf": idf.astype(np.float32), "temperature": t}


def identified(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) from the whole text of every row.

    A text that is null or has no letter gets ``und`` with score 0, as does every text if nothing was learned. Ties go to the first language in order.
    Columns of these names are replaced; no other column is looked at, nothing is shuffled.
    """

    @pandas_udf("struct<lang:string,score:double>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for t in texts:
                c = letters(t)
                if not len(c) or not model["langs"]:
                    out.append((UND, 0.0))
                    continue
                at, x = _vector(c, model["idf"])
                p = _softmax((x @ model["weights"][at]).astype(float) / model["temperature"])
                k = int(np.argmax(p))
                out.append((model["langs"][k], float(p[k])))
            yield pd.DataFrame(out, columns=["lang", "score"])

    found = docs.drop("lang_pred").withColumn("score", predict(F.col(text_col).cast("string")))
    return found.withColumn("lang_pred", F.col("score.lang")).withColumn("score", F.col("score.score"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned without the held-out quarter. One row per document; see ``identified`` for nulls, texts without letters and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identified(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
