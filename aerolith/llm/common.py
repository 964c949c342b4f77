"""Shared helpers: where intermediate tables live, and how they are written and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies under ``spark.checkpoint.dir``. Where that is unset (local tests) a
    folder of this machine is used, which only a local master can share.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/aerolith-checkpoints"
    return f"{base.rstrip('/')}/aerolith-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a frame as Parquet to the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and what is used more than once is computed once.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._aerolith_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a frame that ``materialise`` returned and nothing reads any more."""
    path = getattr(df, "_aerolith_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut, without copies, so that each has about ``most`` bytes of a text column at most, one row at least."""
    for b in batches:
        if b.num_rows:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cut = [0, *(np.flatnonzero(np.diff(sizes // most)) + 1).tolist(), b.num_rows]
            for a, z in zip(cut, cut[1:], strict=False):
                yield b.slice(a, z - a)


def worker_table(key: tuple, make: Callable):
    """What a worker keeps from task to task; it keeps one operator's table at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_tables() -> None:
    """Tasks that keep nothing drop what an earlier operator left in their worker."""
    _KEPT.clear()


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands whole texts to Python in batches of ``BATCH_ROWS`` rows, unless its user has set another size.

    The usual ten thousand texts are held by executor and worker at once, several times over.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 1_000
_KEPT: dict = {}
#: Bits of a bitmap for each key, and the power of two of its size at most (16 MB): what a sieve broadcasts.
BITS_EACH, MOST_BITS, PROBES = 128, 27, 3
#: At most so many keys can hold more than one row in so many; they are what ``join_hot`` broadcasts.
HOT = 1_000


def bitmap_bits(n_keys: int) -> int:
    return min(MOST_BITS, max(10, (max(n_keys, 1) * BITS_EACH - 1).bit_length()))


def _slot(h: Column, bits: int, k: int) -> Column:
    """The k-th of the places of a hash in a bitmap."""
    return F.shiftrightunsigned(h, 18 * k).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def bitmap_of(hashes: DataFrame, bits: int) -> DataFrame:
    """One row (bitmap array<bigint>): a Bloom filter of the column ``h`` of 64-bit hashes, of 2 ** bits bits however many these are."""
    at = hashes.select(F.explode(F.array(*[_slot(F.col("h"), bits, k) for k in range(PROBES)])).alias("at"))
    is_set = at.select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    every = is_set.union(hashes.sparkSession.range(max(1, (1 << bits) // 64)).select("id", F.lit(0).cast("bigint")))
    words = every.groupBy("word").agg(F.bit_or("bit").alias("bit")).agg(F.array_sort(F.collect_list(F.struct("word", "bit"))).alias("w"))
    return words.select(F.transform("w", lambda x: x["bit"]).alias("bitmap"))


def in_bitmap(h: Column, bits: int, bitmap: str = "bitmap") -> Column:
    """Whether a hash may be in the bitmap: true for all that are, and for few others."""

    def one(k: int) -> Column:
        at = _slot(h, bits, k)
        word = F.get(F.col(bitmap), F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1

    return reduce(and_, map(one, range(PROBES)))


def sieve(rows: DataFrame, key: str, keys: DataFrame, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """Splits ``rows`` into those whose long ``key`` may be in the column ``h`` of ``keys``, and those for which it isn't.

    Only a bitmap of bounded size is broadcast, so a join with few keys needs to shuffle few rows, not all.
    """
    bits = bitmap_bits(n_keys)
    bitmap = F.broadcast(materialise(bitmap_of(keys, bits)).withColumnRenamed("bitmap", "_bitmap"))
    may = in_bitmap(F.col(key), bits, "_bitmap")
    return rows.join(bitmap, may).drop("_bitmap"), rows.join(bitmap, ~may).drop("_bitmap")


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and in ``n`` how many of the ``total`` rows of ``left`` have it.

    Keys that hold over one row in ``HOT`` are fewer than ``HOT``: that bounded part of ``right`` is broadcast, the rest is an ordinary join.
    """
    hot = F.broadcast(right.where(F.col("n") * HOT > total).drop("n"))
    rest = right.where(F.col("n") * HOT <= total).drop("n")
    usual = left.join(hot.select(key), key, "left_anti").join(rest, key)
    return left.join(hot, key).unionByName(usual)
