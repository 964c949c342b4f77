"""Structured Streaming: idempotent ingest and running bins of a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import has_bad_time, tokens
from ..operators.state import insert_absent
from .commits import CommitLog


def read_stream(spark, path: str, schema, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def running_bins(stream: DataFrame, minutes: int = 180, late: str = "1 day") -> DataFrame:
    """Last value and count per station and tumbling bin; keys repeated within the watermark count once.

    Observations from the future must be filtered before, or they would move the watermark.
    """
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "station_id").agg(F.max_by("value", "ts").alias("last_value"), F.count(F.lit(1)).alias("n"))


def present(stream: DataFrame) -> DataFrame:
    """Readings whose flags don't put them in the future: others would move the watermark past what is still to come."""
    return stream.where(~has_bad_time(tokens(F.col("quality_flags"))))


def sliding(stream: DataFrame, width: str, step: str, late: str = "1 day") -> DataFrame:
    """Count, mean and highest value per station and sliding window; a window leaves the state once the watermark has passed it."""
    once = stream.withWatermark("ts", late)
    return once.groupBy(F.window("ts", width, step).alias("w"), "station_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"))


def write_changes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's changed rows to Parquet with the batch's number; ``current`` reads the newest state. A batch that is run again writes its rows once more, with the same number.

    Update mode: only what a batch changes is written, and bins behind the watermark leave the state.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table that ``write_changes`` wrote."""
    rest = [c for c in changes.columns if c not in (*keys, "batch_id")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("m")).select(*keys, "m.*")


def write_facts(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends rows whose keys the table lacks. A batch that is run again adds nothing: its keys are there already."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        insert_absent(old, batch, keys).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HEALTH = "batch_id long, received long, inserted long, duplicates long, error string"


def commit_facts(log: CommitLog, batch: DataFrame, batch_id: int, keys: list[str]) -> bool:
    """Commits the rows of a batch whose keys the table ``facts`` lacks together with the batch's health row (batch_id, received, inserted, duplicates, error): both or neither.

    A batch that fails leaves a row with its error in ``failures``, which are commits of their own under the same folder, and is raised. A batch that is run again after
    its commit is left out.
    """
    spark = batch.sparkSession
    old = log.read("facts", schema=batch.schema)
    try:
        received = batch.count()
        new = insert_absent(old, batch, keys).select(batch.columns)
        return log.write(batch_id, {"facts": new}, lambda made: {"received": received, "inserted": made["facts"].count()})
    except Exception as e:
        failed = CommitLog(spark, f"{log.root}/failures")
        last = failed.last()
        row = spark.createDataFrame([(batch_id, None, 0, None, str(e)[:500])], HEALTH)
        failed.write(last["batch"] + 1 if last else 0, {"health": row})
        raise


def health(log: CommitLog) -> DataFrame:
    """One row for each committed batch, and one for each failure."""
    done = [(m["batch"], m["facts"]["received"], m["facts"]["inserted"], m["facts"]["received"] - m["facts"]["inserted"], None) for m in log.manifests()]
    failed = CommitLog(log.spark, f"{log.root}/failures").read("health", schema=log.spark.createDataFrame([], HEALTH).schema)
    return log.spark.createDataFrame(done, HEALTH).unionByName(failed)


def ingest(stream: DataFrame, log: CommitLog, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """``commit_facts`` for every batch of a stream."""
    return stream.writeStream.foreachBatch(lambda b, i: commit_facts(log, b, i, keys) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _partial(rows: DataFrame, seconds: int) -> DataFrame:
    """Counts, sums, highest and last values by station and bin: what can be merged."""
    bucket = F.col("t") - F.pmod(F.col("t"), F.lit(seconds))
    last = F.max(F.struct("t", "value")).alias("last")
    return rows.groupBy("station_id", bucket.alias("bucket")).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.max("value").alias("high"), last)


def window_step(log: CommitLog, batch: DataFrame, batch_id: int, seconds: int, late: int) -> bool:
    """Adds a batch (station_id, t, value) to the bins of ``seconds``; rows of bins that ended ``late`` seconds before the newest row so far go to the side table ``late``.

    Only what can be merged is written: a row for each station and bin that the batch has. Rows without station or time make no bin.
    """
    past = log.last()
    before = past["facts"]["watermark"] if past else None
    rows = batch.where("station_id is not null and t is not null").select("station_id", F.col("t").cast("long").alias("t"), "value")
    behind = F.lit(False) if before is None else F.col("t") - F.pmod(F.col("t"), F.lit(seconds)) + seconds <= before
    high = rows.agg(F.max("t")).first()[0]
    watermark = max((x for x in (before, None if high is None else high - late) if x is not None), default=None)
    return log.write(batch_id, {"parts": _partial(rows.where(~behind), seconds), "late": _partial(rows.where(behind), seconds)}, {"watermark": watermark, "seconds": seconds})


def windows(log: CommitLog, corrected: bool = True) -> DataFrame:
    """(station_id, bucket, n, mean, high, last_value, late_rows, closed): the bins of ``window_step``; ``corrected`` ones have the late rows merged into them. Before the first batch there are none."""
    if log.last() is None:
        return log.spark.createDataFrame([], "station_id long, bucket long, n long, mean double, high double, last_value double, late_rows long, closed boolean")
    parts = log.read("parts").withColumn("late", F.lit(0).cast("long"))
    side = log.read("late")
    every = parts.unionByName(side.withColumn("late", F.col("n"))) if corrected else parts
    facts = log.last()["facts"]
    mark = facts["watermark"]
    merged = every.groupBy("station_id", "bucket").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("high").alias("high"), F.max("last")["value"].alias("last_value"), F.sum("late").alias("late_rows"))
    return merged.withColumn("closed", F.lit(False) if mark is None else F.col("bucket") + facts["seconds"] <= mark)


def bin_stream(stream: DataFrame, log: CommitLog, checkpoint: str, seconds: int, late: int) -> StreamingQuery:
    """``window_step`` for every batch of a stream."""
    return stream.writeStream.foreachBatch(lambda b, i: window_step(log, b, i, seconds, late) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
