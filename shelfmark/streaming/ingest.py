"""Micro-batches into versioned tables: idempotent ingest, staging, change tokens; and windows over events as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph
from ..operators import stores as S
from ..sources.tables import VersionedTable


def keyed_sink(stream: DataFrame, table: VersionedTable, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Each batch is merged into the table as a whole. A batch that runs again after a failure merges the same rows again,
    so ``merge`` must give the same table then; keyed upserts do."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            table.write(merge(table.read(), rows))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_documents(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """(id, content_hash, raw_text): created, refreshed where the body changed, left alone where it didn't."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        latest = new.groupBy("id").agg(F.max_by(F.struct("content_hash", "raw_text"), "content_hash").alias("x")).select("id", "x.*")
        return S.ingest(old, latest).drop("outcome")

    return keyed_sink(stream, table, checkpoint, merge)


def stage_chunks(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Chunks by id into the staging table."""
    return keyed_sink(stream, table, checkpoint, lambda old, new: S.upsert(old, new.dropDuplicates(["id"])))


def ingest_pages(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Fetched pages (list, byte, url, title, text, date, error) by address. A page replaces one that failed; a page that is there
    stays, and of one address in a batch that of the first line without an error counts."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        names = [c for c in new.columns if c != "url"]
        first = new.groupBy("url").agg(F.min_by(F.struct(*names), F.struct(F.col("error") != "", "list", "byte")).alias("x")).select("url", "x.*")
        fresh = first.join(old.where("error = ''").select("url"), "url", "left_anti")
        return S.upsert(old, fresh, "url")

    return keyed_sink(stream, table, checkpoint, merge)


def drain(staging: VersionedTable, overall: VersionedTable) -> int:
    """Staged rows that the whole store lacks go there, then the staging table is empty. Running again changes nothing."""
    rows = staging.read()
    n = rows.count()
    if n:
        overall.write(overall.read().unionByName(rows.join(overall.read().select("id"), "id", "left_anti")))
        staging.clear()
    return n


class ChangeLog:
    """What changed at each write of a versioned table, as a table that is only added to, and as a stream.

    A write goes through ``write``: first the table's new version, then the changes from the one before as a numbered folder of
    files. Numbers are the tokens; a stream's offsets are kept by its checkpoint, so one that stops goes on after the last
    change it saw. A writer that fails between the two must call ``write`` with ``before``, the version it began with.
    """

    def __init__(self, table: VersionedTable, key: str):
        self.table, self.key, self.path = table, key, f"{table.path}-changes"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*self.table.schema.fields, T.StructField("change", T.StringType()), T.StructField("token", T.LongType())])

    def token(self) -> int:
        """The number of the last write that changed anything; 0 before any."""
        return (self._read().agg(F.max("token")).first()[0] or 0) if self._any() else 0

    def write(self, rows: DataFrame, before: DataFrame | None = None) -> int:
        token, old = self.token() + 1, graph.cut(self.table.read() if before is None else before)
        new = graph.cut(rows.select(*self.table.schema.fieldNames()))
        self.table.write(new)
        S.changes(old, new, self.key).withColumn("token", F.lit(token).cast("long")).select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/{token:012d}")
        return token

    def since(self, token: int = 0) -> DataFrame:
        """The changes of later writes than ``token``."""
        return self._read().where(F.col("token") > token) if self._any() else self.table.spark.createDataFrame([], self.schema)

    def stream(self) -> DataFrame:
        """New changes as they are written, in any trigger; each file once."""
        return self.table.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)

    def _any(self) -> bool:
        spark = self.table.spark
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)

    def _read(self) -> DataFrame:
        return self.table.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)


def changed_since(table: VersionedTable, token: str | None) -> tuple[bool, str | None]:
    """Whether a table was written since a token, and the token to ask with next time."""
    now = table.version()
    return now != token, now


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and window; what comes later than ``late`` is left out. Works on streams and tables."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events without a longer pause."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    return own.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
