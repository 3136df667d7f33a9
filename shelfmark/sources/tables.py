"""Versioned tables: every write is a new folder, and a small pointer file names the one that counts.

Readers keep what they opened; a writer that fails leaves the pointer alone. Paths can be of any file system that Spark
reads; the pointer goes through Hadoop's file system, whose rename replaces it in one step.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """The pointer's value: a token that changes with every write."""
        at = self._path(f"{self.path}/_current")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The rows that count; an empty table where nothing was written. Missing columns are null."""
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def write(self, rows: DataFrame, keep: int = 2) -> str:
        """Replace the table; ``rows`` may come from it. Older versions beyond ``keep`` go."""
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/{version}")
        part = self._path(f"{self.path}/_current.{version}")
        out = self._fs.create(part, True)
        out.write(bytearray(version.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, self._path(f"{self.path}/_current"), options)
        folders = sorted((s for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory()), key=lambda s: s.getModificationTime())
        for old in [s for s in folders if s.getPath().getName() != version][: max(0, len(folders) - keep)]:
            self._fs.delete(old.getPath(), True)
        return version

    def clear(self) -> str:
        return self.write(self.spark.createDataFrame([], self.schema))


def open_table(spark: SparkSession, path: str, schema: T.StructType, backend=None) -> VersionedTable:
    """A table of another backend (a callable) if there is one and it can be reached, else the local kind, with a warning.

    Only failures to connect fall back; anything else is raised, so that no write lands in the wrong store unseen."""
    if backend is not None:
        try:
            return backend(spark, path, schema)
        except (OSError, ImportError) as e:
            logging.getLogger(__name__).warning("%s: backend can't be reached (%s), local table used", path, e)
    return VersionedTable(spark, path, schema)
