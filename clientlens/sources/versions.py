"""SNK-03, SNK-05, SNK-06: results that are replaced as a whole.

A result (table, model) is written to a fresh folder of its name; when that is
complete, a one-line file is renamed over the last one and names it. Readers
follow the file, so they see the last complete version whatever a writer does:
a failed or unfinished write changes nothing, and a second writer simply wins.
Works on any file system that Hadoop reads and that can rename."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

POINTER = "CURRENT"


class Versions:
    """Versioned results under ``root`` (by default in the shared checkpoint
    folder)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/results").rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self, name: str) -> str | None:
        """Folder of the last complete version."""
        path, fs = self._path(name, POINTER)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            version = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()
        return f"{self.root}/{name}/{version}"

    def publish(self, name: str, write: Callable[[str], None]) -> str:
        """``write(folder)`` a new version, then make it the current one. What
        ``write`` raises is passed on, and the version before stays."""
        version = f"v-{uuid.uuid4().hex}"
        write(f"{self.root}/{name}/{version}")
        temporary, fs = self._path(name, f".{version}")
        out = fs.create(temporary, True)
        out.write(bytearray(version.encode()))
        out.close()
        pointer, _ = self._path(name, POINTER)
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, pointer, options)
        return f"{self.root}/{name}/{version}"

    def table(self, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The current table, computed and published where there is none."""
        path = self.current(name) or self.publish(name, lambda p: compute().write.parquet(p))
        return self.spark.read.parquet(path)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as the new current table."""
        return self.spark.read.parquet(self.publish(name, lambda p: df.write.parquet(p)))

    def model(self, name: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        """The current model, fitted and published where there is none."""
        path = self.current(name) or self.publish(name, lambda p: fit().save(p))
        return PipelineModel.load(path)

    def prune(self, name: str) -> int:
        """Removes all versions but the current one; returns how many."""
        folder, fs = self._path(name)
        keep = (self.current(name) or "").rsplit("/", 1)[-1]
        gone = 0
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            if status.isDirectory() and status.getPath().getName() != keep:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone


def fingerprint(spark: SparkSession, *tables: DataFrame) -> str:
    """Names what tables are read from: path, size and time of their files.
    A result that is kept under it is computed anew when a file changes."""
    seen = []
    for file in sorted({f for t in tables for f in t.inputFiles()}):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]
