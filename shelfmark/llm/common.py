"""Shared pieces of the training-data operators: scratch space, materialising, document rows, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Where the session names none, a local one if the
    executors are this process, and an error if they are others, which could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs only the tasks it ran."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of the rows that have a key; null text becomes empty."""
    return docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)
    )


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, on the driver or an executor; plain paths are local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def put_file(fs: pafs.FileSystem, path: str, data) -> None:
    """Write under another name first: a second attempt of a task replaces the file with the same bytes."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        for chunk in data if isinstance(data, list) else [data]:
            out.write(chunk)
    try:
        fs.move(part, path)
    except OSError:  # file systems that don't rename over a file, where an earlier attempt left one
        fs.delete_file(path)
        fs.move(part, path)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(rows: pa.RecordBatch, text: str, most_bytes: int = 4 << 20):
    """Row ranges of a batch of at most about ``most_bytes`` of text each; a longer text stands alone."""
    lengths = pc.binary_length(rows.column(text)).to_pylist()
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and held + (n or 0) > most_bytes:
            yield rows.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < rows.num_rows:
        yield rows.slice(at)


#: So many edges are joined up in one task.
EDGES = 300_000


def _forest(batches):
    """The edges of a partition as one star for each of its connected parts."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch_ in batches:
        for a, b in zip(batch_.column(0).to_pylist(), batch_.column(1).to_pylist()):
            if (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    stars = [(x, find(x)) for x in root]
    for at in range(0, len(stars), 50_000):
        own = [e for e in stars[at : at + 50_000] if e[0] != e[1]]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*own)], names=["a", "b"])


def components(edges: DataFrame, name: str, most: int = EDGES, rounds: int = 100) -> DataFrame:
    """(node, component) of an undirected graph with columns a and b; component is the smallest node reachable.

    Every task first replaces its edges, at most about ``most``, by stars of their connected parts; a graph of so few is
    finished by that. Larger ones alternate large-star and small-star, which need only grouped minima and equi-joins,
    so a node with many neighbours is neither collected nor expanded into pairs, and contract again in between. Every
    round is written to the shared folder. An empty graph gives no rows.
    """
    edges, before = materialize(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges"), None
    for k in range(rounds):
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, mark) == before:
            break
        tasks = -(-n // most)
        edges, before = edges.coalesce(max(1, tasks)).mapInArrow(_forest, "a long, b long"), (n, mark)
        if tasks <= 1:
            edges = materialize(edges, f"{name}-stars")
            break
        both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-both")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = materialize(small.where("a <> b").distinct(), f"{name}-{k}")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def by_cluster(pairs: DataFrame, sizes: DataFrame, name: str, most: int, strong: str = "true") -> tuple[DataFrame, DataFrame]:
    """Deal pairs (a, b, ...) to groups in which each document is needed once: (g and the pairs; h, doc_id).

    ``sizes`` has doc_id and bytes. Clusters are those of the pairs for which ``strong`` holds; another pair goes where
    its a is. Clusters of up to ``most`` bytes share groups of about that size; larger ones are cut into blocks of about
    as much, with a group for each two blocks that have pairs. A group that partners of other clusters make larger than
    three times that is split by its b, so a group holds some ``most`` bytes, or two documents.
    """
    sizes = sizes.groupBy("doc_id").agg(F.sum("bytes").alias("bytes"))
    cluster = materialize(components(pairs.where(strong), f"{name}-clusters"), f"{name}-cluster")
    held = materialize(cluster.join(sizes, F.col("node") == F.col("doc_id")).groupBy("component").agg(F.sum("bytes").alias("size")), f"{name}-sizes")
    total = held.agg(F.sum("size")).first()[0] or 0
    large = held.where(F.col("size") > most).select("component", F.ceil(F.col("size") / most).alias("blocks"))
    own = pairs.join(cluster.withColumnRenamed("node", "a"), "a", "left").join(cluster.withColumnsRenamed({"node": "b", "component": "other"}), "b", "left")
    own = own.withColumn("component", F.coalesce("component", "a")).join(large, "component", "left")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    second = F.when(F.col("other") == F.col("component"), block("b")).otherwise(block("a"))
    in_large = F.xxhash64("component", F.least(block("a"), second), F.greatest(block("a"), second))
    shared = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // most))))
    placed = materialize(own.withColumn("g", F.when(F.col("blocks").isNull(), shared).otherwise(in_large)).select("g", *pairs.columns), f"{name}-placed")
    ends = lambda rows: rows.select(F.col("g").alias("h"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = materialize(ends(placed), f"{name}-wanted")
    full = wanted.join(sizes, "doc_id").groupBy(F.col("h").alias("g")).agg(F.sum("bytes").alias("size")).where(F.col("size") > 3 * most)
    full = materialize(full.select("g", F.ceil(F.col("size") / most).alias("parts")), f"{name}-full")
    if full.isEmpty():
        return placed, wanted
    split = F.when(F.col("parts").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.pmod(F.xxhash64("b"), F.col("parts"))))
    placed = materialize(placed.join(full, "g", "left").select(split.alias("g"), *pairs.columns), f"{name}-dealt")
    return placed, ends(placed)
