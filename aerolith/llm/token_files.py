"""Token-id files: documents compressed one by one with a shared zstandard dictionary, with an offset index.

A folder holds ``dictionary`` (one row: the dictionary's bytes and SHA-256) and ``shards``
(rows in ascending doc_id order by bucket and shard; each has one binary blob):

    magic "AETOKID1" | u8 bytes per id | u64 documents | 32 bytes SHA-256 of the dictionary
    index, per document: i64 doc_id | u8 1 if the id is null | u64 end of its frame | u64 ids
    frames: each document's little-endian ids, one zstandard frame

Spark's Parquet files carry the blobs, so any store that Spark reads will do. A short document is
read by its index entry alone: its frame is the only one decompressed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, shared_dir, slices, text_batches, worker_table
from .words import WordIds

MAGIC = b"AETOKID1"
HEAD, ENTRY = "<8sBQ32s", np.dtype([("doc_id", "<i8"), ("null", "u1"), ("end", "<u8"), ("ids", "<u8")])
#: Documents that the dictionary is trained on, its size, and what a shard holds at most (one document at least) before it is closed.
SAMPLE_DOCS, DICTIONARY_BYTES, SHARD_BYTES, SHARD_DOCS = 400, 32_768, 4_000_000, 8_192
#: Documents in one range of ids, ranges that are summed together, and bytes of text that a worker encodes at once.
BUCKET_DOCS, GROUP, BATCH_BYTES = 20_000, 1_000, 2_000_000


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """The ids of texts by a tokenizer file of the tokenizers library, in ``width`` bytes each.

    A byte-level tokenizer without normalizer encodes each match of its pattern by itself. So texts are cut into words, the words that are
    new into pieces, and each piece goes to the library's model; what a worker met lately is kept.
    Words that hold an added token, and all texts of other tokenizers, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width, self.kind = (2, "H") if size <= 1 << 16 else (4, "I")
        rules = json.loads(self.tokenizer.to_str())
        pre = rules.get("pre_tokenizer") or {}
        added = tuple(t["content"] for t in rules.get("added_tokens", []))
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not rules.get("normalizer")
        self.by_word = plain and not any(re.search(r"\s", t) for t in added)
        self.words = WordIds(self._pieces, whole=added, alone=self._whole)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder of a file."""
        return worker_table(("tokens", path), lambda: cls(path))

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        model, kind, out = self.tokenizer.model.tokenize, self.kind, []
        for p in pieces:
            letters = "Ġ" + p[1:] if p[0] == " " and p.isascii() and p[1:].isalpha() else p.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_LETTERS)
            out.append(array(kind, [t.id for t in model(letters)]).tobytes())
        return out

    def encode(self, texts: list[str | None], end_id: int | None) -> list[bytes]:
        tail = b"" if end_id is None else array(self.kind, [end_id]).tobytes()
        return self.words.encode(texts, tail) if self.by_word else [self._whole(t or "") + tail for t in texts]


def train_dictionary(docs: DataFrame, tokenizer_file: str, end_id: int | None, n_docs: int) -> bytes:
    """A zstandard dictionary trained on the whole id arrays of at most ``SAMPLE_DOCS`` documents, chosen by hash.

    Empty where the sample is too small for one.
    """

    def run(batches):
        encoder = Encoder.of(tokenizer_file)
        for part in slices(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(encoder.encode(part.column("text").to_pylist(), end_id), pa.binary())], ["ids"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0).select("text").limit(SAMPLE_DOCS)
    samples = [bytes(r.ids) for r in some.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes the files under ``path``, in ascending order of id (nulls first, ties by the text's hash).

    Null and empty texts have no ids but the end id. Texts are encoded where they are read; only their frames are dealt out by ranges of ids
    and sorted within each. A task holds one batch and one shard. Other columns are not read; an empty table gives files without documents.
    """
    spark = docs.sparkSession
    read = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = read.count()
    dictionary = train_dictionary(read, tokenizer_file, end_id, n)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def compress(batches):
        encoder = Encoder.of(tokenizer_file)
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=1, dict_data=zdict).compress
        for part in slices(batches, "text", BATCH_BYTES):
            ids = encoder.encode(part.column("text").to_pylist(), end_id)
            own = [part.column(c) for c in ("id", "null", "th")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) // encoder.width for x in ids], pa.int64()), pa.array([press(x) for x in ids], pa.binary())], ["id", "null", "th", "n", "frame"])

    def shards(batches):
        width = Encoder.of(tokenizer_file).width
        index, frames, size, shard, bucket = [], [], 0, 0, 0

        def close():
            entries = np.array(index, dtype=ENTRY)
            blob = struct.pack(HEAD, MAGIC, width, len(entries), digest) + entries.tobytes() + b"".join(frames)
            real = entries["doc_id"][entries["null"] == 0]
            return pd.DataFrame(
                {"bucket": [bucket], "shard": [shard], "n_docs": [len(entries)], "n_ids": [int(entries["ids"].sum())], "min_id": pd.array([real.min() if len(real) else None], dtype="Int64"), "max_id": pd.array([real.max() if len(real) else None], dtype="Int64"), "blob": [blob]}
            )

        for b in batches:
            for i, null, k, frame, bucket in zip(b["id"], b["null"], b["n"], b["frame"], b["bucket"], strict=True):  # noqa: B007
                size += len(frame)
                frames.append(frame)
                index.append((i, null, size, k))
                if size >= SHARD_BYTES or len(index) >= SHARD_DOCS:
                    yield close()
                    index, frames, size, shard = [], [], 0, shard + 1
        if index:
            yield close()

    rows = read.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().cast("int").alias("null"), F.xxhash64("text").alias("th"), "text")
    encoded = materialise(rows.mapInArrow(compress, "id long, null int, th long, n long, frame binary"))
    ranged = encoded.repartitionByRange(max(1, -(-n // BUCKET_DOCS)), F.desc("null"), "id").sortWithinPartitions(F.desc("null"), "id", "th")
    made = ranged.withColumn("bucket", F.spark_partition_id()).mapInPandas(shards, "bucket int, shard int, n_docs long, n_ids long, min_id long, max_id long, blob binary")
    made.write.parquet(f"{path}/shards")
    discard(encoded)


def unpack(blob: bytes, dictionary: bytes, only: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the shard, ids) of a blob's documents, or of those in ``only`` alone."""
    magic, width, n, digest = struct.unpack_from(HEAD, blob)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard of this dictionary")
    index = np.frombuffer(blob, dtype=ENTRY, count=n, offset=struct.calcsize(HEAD))
    base = struct.calcsize(HEAD) + n * ENTRY.itemsize
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress
    ends, before = index["end"].tolist(), np.concatenate([[0], np.cumsum(index["ids"])]).tolist()
    for k, (i, null) in enumerate(zip(index["doc_id"].tolist(), index["null"].tolist(), strict=True)):
        if only is None or (not null and i in only):
            frame = blob[base + (ends[k - 1] if k else 0) : base + ends[k]]
            ids = np.frombuffer(open_(frame), dtype=f"<u{width}") if ends[k] else np.zeros(0, f"<u{width}")
            yield None if null else i, before[k], ids


def _opened(spark: SparkSession, path: str) -> tuple[bytes, DataFrame]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(row.dictionary), spark.read.parquet(f"{path}/shards")


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids): all documents, or those named; shards whose range of ids holds none of them aren't read, nor other frames opened."""
    dictionary, shards = _opened(spark, path)
    only = None if doc_ids is None else set(doc_ids)
    if only is not None:
        shards = shards.where(F.col("max_id").between(min(only), max(only)) | F.col("min_id").between(min(only), max(only)) | ((F.col("min_id") <= min(only)) & (F.col("max_id") >= max(only)))) if only else shards.limit(0)

    def run(batches):
        for b in batches:
            for blob in b["blob"]:
                got = list(unpack(blob, dictionary, only))
                yield pd.DataFrame({"doc_id": pd.array([g[0] for g in got], dtype="Int64"), "ids": [g[2].astype("<i8") for g in got]})

    return shards.select("blob").mapInPandas(run, "doc_id long, ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    dictionary, shards = _opened(spark, path)

    def run(batches):
        for b in batches:
            for bucket, shard, blob in zip(b["bucket"], b["shard"], b["blob"], strict=True):
                got = [(i, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, before, ids in unpack(blob, dictionary)]
                ids, before, n, crc = zip(*got, strict=True)
                yield pd.DataFrame({"bucket": bucket, "shard": shard, "doc_id": pd.array(ids, dtype="Int64"), "before": before, "n_tokens": n, "ids_crc32": crc})

    docs = shards.select("bucket", "shard", "blob").mapInPandas(run, "bucket int, shard int, doc_id long, before long, n_tokens long, ids_crc32 long")
    # prefix sums on three levels: over groups of buckets, the buckets of a group, and the shards of a bucket
    group = F.floor(F.col("bucket") / GROUP).alias("group")
    before = lambda over: F.sum("n").over(over) - F.col("n")
    totals = shards.groupBy("bucket", group).agg(F.sum("n_ids").alias("n"))
    groups = totals.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(Window.orderBy("group")).alias("group_start"))
    buckets = totals.select("group", "bucket", before(Window.partitionBy("group").orderBy("bucket")).alias("bucket_start")).join(groups, "group")
    own = shards.select("bucket", "shard", F.col("n_ids").alias("n")).select("bucket", "shard", before(Window.partitionBy("bucket").orderBy("shard")).alias("own_start"))
    starts = own.join(buckets, "bucket").select("bucket", "shard", (F.col("group_start") + F.col("bucket_start") + F.col("own_start")).alias("shard_start"))
    return docs.join(starts, ["bucket", "shard"]).select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes the token ids of every whole text of ``documents`` and gives each document's place, count and checksum, read back from the files. Nulls, ties and empty tables: see ``write``."""
    import public_tokenizers

    path = shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return digests(spark, path)
