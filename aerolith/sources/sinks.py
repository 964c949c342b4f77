"""Batch sinks: tables, dated raw snapshots, and folders of analysis runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    w = w.partitionBy(*partition_by) if partition_by else w
    if kind == "csv":
        w.csv(path, header=True)
    elif kind == "json":
        w.json(path, compression="gzip")
    else:
        w.format(kind).save(path)


def write_report(df: DataFrame, path: str, fields: list[str], kind: str = "csv", banner: str | None = None, context: dict[str, str] | None = None) -> None:
    """Writes a small report as one CSV or JSON file with the given fields in order, after the columns of ``context`` (the same in every row), under a line ``# banner`` if there is one.

    Numbers that are not finite are refused: the write fails, and nothing is left at ``path``. A banner is for CSV only. The rows of a report go through one task.
    """
    checked = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.select(*fields).dtypes]
    rows = df.select(*[F.lit(v).alias(k) for k, v in (context or {}).items()], *checked)
    if kind == "json":
        rows.coalesce(1).write.json(path)
    elif banner is None:
        rows.coalesce(1).write.csv(path, header=True)
    else:
        cells = F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in rows.columns]))
        lines = rows.select(cells.alias("value"))
        head = df.sparkSession.createDataFrame([(0, f"# {banner}"), (1, ",".join(rows.columns))], "i int, value string")
        whole = head.unionByName(lines.withColumn("i", F.lit(2))).coalesce(1).sortWithinPartitions("i").select("value")
        whole.write.text(path)


def snapshot(raw: DataFrame, path: str, at: str = "ingested_at") -> None:
    """Appends raw records as gzipped JSON in folders by day; nothing that is there is overwritten."""
    raw.withColumn("dt", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("dt").json(path, compression="gzip")


def run_id(start: str, end: str, zone: str, prefix: str = "RUN") -> str:
    """A name for a run that depends on its window (ISO times in UTC) and zone alone."""
    short = lambda t: "".join(c for c in t if c.isdigit())
    digest = hashlib.sha256(f"{start}|{end}|{zone}|{VERSION}".encode()).hexdigest()[:10]
    return f"{prefix}_{short(start)}_{short(end)}_{zone}_{digest}"


def write_run(spark: SparkSession, root: str, name: str, stages: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Runs each stage and writes its table under ``root/name``; a stage that fails doesn't stop the others. The manifest that it writes and returns has (run, stage, status, rows, error)."""
    done = []
    for stage, make in stages.items():
        at = f"{root}/{name}/{stage}"
        try:
            make().write.mode("overwrite").parquet(at)
            done.append((name, stage, "ok", spark.read.parquet(at).count(), None))
        except Exception as e:  # the manifest says which stage failed and why
            done.append((name, stage, "failed", None, str(e)[:500]))
    manifest = spark.createDataFrame(done, "run string, stage string, status string, rows long, error string").coalesce(1)
    manifest.write.mode("overwrite").json(f"{root}/{name}/manifest")
    return manifest


def runs(spark: SparkSession, *roots: str) -> DataFrame:
    """The manifests of all runs in some folders, each run once, newest name first."""
    shape = "run string, stage string, status string, rows long, error string"
    found = spark.read.schema(shape).json([f"{r}/*/manifest" for r in roots])
    return found.dropDuplicates(["run", "stage"]).orderBy(F.desc("run"), "stage")
