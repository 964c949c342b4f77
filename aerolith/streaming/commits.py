"""Tables that a stream writes batch by batch, all tables of a batch becoming visible at once.

A batch's frames are written to folders of their own. Then one small manifest that names them is renamed into place, which is atomic and fails if
the batch has one already. Readers take only folders that manifests name: what a batch that was killed has left is never seen, and a batch that
is run again after its commit changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class CommitLog:
    """The committed batches under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[dict]:
        """What has been committed, by batch: small files, one a batch."""
        fs, at = self._files(), self._path(f"{self.root}/commits")
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at))
        paths = [f"{self.root}/commits/{n}" for n in names if n.endswith(".json") and not n.startswith(".")]
        if not paths:
            return []
        rows = self.spark.read.text(paths, wholetext=True).collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda m: m["batch"])

    def last(self) -> dict | None:
        """The manifest of the newest batch."""
        found = self.manifests()
        return found[-1] if found else None

    def write(self, batch: int, frames: dict[str, DataFrame], facts: Callable[[dict[str, DataFrame]], dict] | dict | None = None) -> bool:
        """Commits the frames of a batch; False, and nothing written, if it has been committed before.

        ``facts`` go into the manifest; a function gets the frames as they have been written, so that what it counts is computed once.
        """
        if self._files().exists(self._path(self._manifest(batch))):
            return False
        tables, written = {}, {}
        for name, df in frames.items():
            path = f"{self.root}/data/{name}/batch-{batch:09d}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            tables[name] = {"path": path, "schema": df.schema.json()}
            written[name] = self.spark.read.schema(df.schema).parquet(path)
        told = facts(written) if callable(facts) else facts or {}
        return self._publish(batch, {"batch": batch, "tables": tables, "facts": told})

    def _manifest(self, batch: int) -> str:
        return f"{self.root}/commits/{batch:09d}.json"

    def _publish(self, batch: int, manifest: dict) -> bool:
        jvm, fs = self.spark._jvm, self._files()
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(self._manifest(batch))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        fs.mkdirs(final.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def read(self, table: str, keep: Callable[[dict], bool] | None = None, schema: StructType | None = None) -> DataFrame | None:
        """All committed rows of a table, of the batches whose manifests ``keep`` accepts; without any, an empty table if ``schema`` is given."""
        found = [m for m in self.manifests() if table in m["tables"] and (keep is None or keep(m))]
        if not found:
            return None if schema is None else self.spark.createDataFrame([], schema)
        shape = StructType.fromJson(json.loads(found[-1]["tables"][table]["schema"]))
        return self.spark.read.schema(shape).parquet(*[m["tables"][table]["path"] for m in found])
