"""A corpus through five stages: quality, near-dedup, decontamination, secrets, token ids.

Each stage takes what the one before it kept, as columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from aerolith.llm import bpe, decontaminate, quality, secrets, simhash
from aerolith.llm.common import materialise, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as texts without characters; without enough labels none is rejected. Repeated rows and rows without an id are
    judged one by one, further columns stay, an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Null and empty texts are one group. Rows without an id come after all others; of repeated rows one stays. Further columns stay as they were, an empty table stays empty.
    """
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; items without words match nothing. All rows of an id go if one does. An empty table stays empty.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; n_chars follows, null for a null text. No document goes, repeated rows stay, an empty table stays empty."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and digests of the ids and of what they decode to. Null and empty texts have no ids; repeated rows are each encoded; an empty table stays empty."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN, ["doc_id", "lang", "source", "n_chars"], with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: The classifier and the tokenizer are not SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
