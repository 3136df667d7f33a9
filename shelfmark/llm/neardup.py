"""MinHash near-duplicates by an LSH forest (operator 4).

Every set of shingles gets ``TREES`` x ``LEVELS`` MinHash values. Documents with equal sets are one class, and its
smallest doc_id stands for it from here on. Each tree holds the classes in the order of its own ``LEVELS`` values: one
range sort over (tree, values, doc_id) makes all trees, whose partitions stay even however many documents share a
prefix. A region is a run with a common prefix of at least ``DEPTH`` values. Within it a document's candidates are its
neighbours of longest common prefix: where regions are small they are all its members; where they are crowded the order
by the deeper levels decides which one is next and which ``BLOCK`` are near, and the ``BEST`` of these by sketch are
added, so the depth follows the crowd. A document proposes a fixed number of partners in each tree, so a group of any size
makes candidates in proportion to its members, never all pairs.

Sketches (2 bits of each MinHash value) drop candidates that are about four standard deviations below the threshold.
The rest is confirmed on full sets: candidates are split by connected clusters, small clusters share tasks, large ones
are cut into blocks, and only pairs that would join two parts are compared. Confirmed links are joined by large-star
and small-star rounds.

What a crowd leaves is found exactly (``between``): documents of crowded regions, and of regions that the edge of a
task cuts, are joined by their rarest shingles. Of two sets that link, the smaller has one of its rarest n - ceil(6n/7) + 1
shingles among the n - ceil(3n/4) + 1 rarest of the larger, whatever order makes rare; counts within the crowd make it,
so what all of a template have in common is in no such list. Only documents of different parts are joined, so near
copies, which the forest has linked, make no pairs.

A pair of similarity 0.75 outside of crowds shares a prefix in some tree with probability 0.99998; within them none is
missed.

Rows: null or empty texts, and texts without words, have an empty set and stand alone. Rows without doc_id are left
out. Rows that repeat a doc_id are one node with the links of each, and each row is returned. Ties don't arise: the
component is the smallest doc_id reachable. Texts of any length are one set. Empty tables give no rows; other columns
don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_cluster, components, keyed_texts, materialize, partitions, slices
from .shingles import common, shingle_set

TREES, LEVELS, DEPTH = 20, 8, 3
NEAR, BEST, BLOCK = 8, 2, 2048
#: bytes of sets in a group of pairs
GROUP_BYTES = 512 << 10
CUT, PERCENT = 0.58, 75
HASHES = TREES * LEVELS


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(4)
    return (r.integers(0, 1 << 31, HASHES).astype(np.uint32) * 2 + 1, r.integers(0, 1 << 31, HASHES).astype(np.uint32) * 2 + 1)


_A, _B = _parameters()


def minhash(own: np.ndarray) -> np.ndarray:
    low, high = (own & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None], (own >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 512):
        np.minimum(least, (low[at : at + 512] * _A + high[at : at + 512] * _B).min(axis=0), out=least)
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """2 bits of each value, packed into 64-bit words."""
    two = (least * np.uint32(0x85EBCA77)) >> np.uint32(30)
    bits = np.zeros((len(two), 2), np.uint8)
    bits[:, 0], bits[:, 1] = two & 1, two >> 1
    return np.packbits(bits.ravel(), bitorder="little")


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates from sketches, over the last axis."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int32)
    return 1 - differ / (0.75 * HASHES)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, sketch, trees): set size, 128-bit hash of the set, sketch and the trees' keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary()), ("trees", pa.binary())])

    def run(batches):
        for b in batches:
            for rows in slices(b, "text"):
                out = []
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    own = shingle_set(text)
                    if not len(own):
                        out.append((doc, 0, 0, 0, None, None))
                        continue
                    least = minhash(own)
                    both = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                    keys = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")
                    out.append((doc, len(own), int(both[0]), int(both[1]), sketch(least).tobytes(), keys.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch binary, trees binary")


def propose(tree: np.ndarray, keys: np.ndarray, n: np.ndarray, sketches: np.ndarray):
    """Candidate pairs (i, j, estimate) of rows in forest order; a row in a crowd, or in a region at an edge, makes one with itself.
    A row alone at an edge makes one too: its region may go on in the next task."""
    region = np.zeros(len(tree), np.int64)
    if len(tree) > 1:
        together = (tree[1:] == tree[:-1]) & (keys[1:, :DEPTH] == keys[:-1, :DEPTH]).all(axis=1)
        region[1:] = np.cumsum(~together)
    sizes = np.bincount(region)
    rows = np.nonzero(sizes[region] > 1)[0]
    crowd = np.nonzero((sizes[region] > NEAR + 1) | (region == 0) | (region == len(sizes) - 1))[0]
    found = [(crowd, crowd, np.zeros(len(crowd)))]
    for step in range(1, NEAR + 1):
        i = rows[rows + step < len(tree)]
        i = i[(region[i] == region[i + step]) & ((step == 1) | (sizes[region[i]] <= NEAR + 1))]
        found.append(_fine(i, i + step, n, sketches))
    for r in np.nonzero(sizes > NEAR + 1)[0]:
        first = np.searchsorted(region, r)
        for at in range(first, first + sizes[r], BLOCK):
            own = np.arange(at, min(at + BLOCK, first + sizes[r]))
            for part in np.array_split(own, max(1, len(own) // 256)):
                like = similarity(sketches[part][:, None], sketches[own][None])
                like[part[:, None] == own[None]] = -1
                ratio = np.minimum(n[part][:, None], n[own][None]) * 100 >= PERCENT * np.maximum(n[part][:, None], n[own][None])
                like[~ratio] = -1
                k = min(BEST, len(own) - 1)
                best = np.argpartition(-like, k - 1, axis=1)[:, :k]
                i, j = np.repeat(part, k), own[best.ravel()]
                value = np.take_along_axis(like, best, axis=1).ravel()
                found.append((i[value >= CUT], j[value >= CUT], value[value >= CUT]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _fine(i: np.ndarray, j: np.ndarray, n: np.ndarray, sketches: np.ndarray):
    keep = np.minimum(n[i], n[j]) * 100 >= PERCENT * np.maximum(n[i], n[j])
    i, j = i[keep], j[keep]
    value = similarity(sketches[i], sketches[j])
    return i[value >= CUT], j[value >= CUT], value[value >= CUT]


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b, e) with a < b: distinct candidate pairs and the estimate; with a = b the documents of crowds."""
    spark = reps.sparkSession
    width = 2 * LEVELS
    entries = reps.select("doc_id", "n", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "trees").select(
        "doc_id", "n", "sketch", "tree", F.expr(f"substring(trees, tree * {width} + 1, {width})").alias("key")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("e", pa.float64())])

    def run(batches):
        held, rows = [], 0

        def block(last: bool):
            nonlocal held, rows
            t = pa.Table.from_batches(held).combine_chunks()
            doc, tree, n = (t.column(c).to_numpy() for c in ("doc_id", "tree", "n"))
            keys = np.frombuffer(b"".join(t.column("key").to_pylist()), ">u2").reshape(-1, LEVELS)
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(doc), -1)
            i, j, e = propose(tree, keys, n, sketches)
            a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
            order = np.unique(np.stack([a, b]), axis=1, return_index=True)[1] if len(a) else []
            keep = t.num_rows if last else BLOCK  # the next block sees the end of this one again
            held, rows = t.slice(t.num_rows - keep).to_batches(), keep
            return pa.RecordBatch.from_arrays([pa.array(a[order]), pa.array(b[order]), pa.array(e[order])], schema=schema)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 64 * BLOCK:
                yield block(False)
        if rows:
            yield block(True)

    order = entries.repartitionByRange(partitions(spark), "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    return order.mapInArrow(run, "a long, b long, e double").groupBy("a", "b").agg(F.max("e").alias("e"))


def to_sets(batches):
    for b in batches:
        for rows in slices(b, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([shingle_set(t).tobytes() for t in rows.column("text").to_pylist()], pa.binary())], names=["doc_id", "own"])


def between(docs: DataFrame, crowd: DataFrame) -> DataFrame:
    """(a, b, e): all pairs of crowd documents (doc_id, part) of different parts that their rarest shingles let link."""
    texts = docs.join(crowd.hint("merge"), "doc_id", "left_semi")

    def spread(batches):
        for b in batches:
            for rows in slices(b, "text", 1 << 20):
                sets = [shingle_set(t) for t in rows.column("text").to_pylist()]
                n = np.array([len(x) for x in sets], np.int64)
                which = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                columns = [np.repeat(x, n) for x in (rows.column("doc_id").to_numpy(), which, n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, np.concatenate(sets).view(np.int64))], names=["doc_id", "own", "n", "s"])

    every = materialize(texts.mapInArrow(spread, "doc_id long, own long, n long, s long"), "near-crowd")
    count = every.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.row_number().over(Window.partitionBy("doc_id", "own").orderBy(F.coalesce("df", F.lit(1)), "s")) - 1
    placed = every.join(count, "s", "left").withColumn("at", rank).where("at <= n - (3 * n + 3) div 4 and df > 1")
    rare = materialize(placed.join(crowd, "doc_id").select("s", "doc_id", "n", "at", "part"), "near-rare")
    small = rare.where("at <= n - (6 * n + 6) div 7").select("s", *(F.col(c).alias(f"small_{c}") for c in ("doc_id", "n", "at", "part")))
    fits = """part <> small_part and (small_n < n or small_n = n and small_doc_id < doc_id) and 4 * small_n >= 3 * n
              and least(n - at, small_n - small_at) >= (3 * (n + small_n) + 6) div 7"""
    pairs = rare.join(small, "s").where(fits)
    return pairs.select(F.least("doc_id", "small_doc_id").alias("a"), F.greatest("doc_id", "small_doc_id").alias("b"), F.lit(1.0).alias("e")).distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """(a, b): links of similarity at least 0.75 on full sets that connect whatever the pairs' links connect."""
    placed, wanted = by_cluster(pairs, sizes, name, GROUP_BYTES)
    texts = docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")

    sets = wanted.join(texts.mapInArrow(to_sets, "doc_id long, own binary"), "doc_id")

    def links(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, list] = {}
        for doc, raw in zip(sets["doc_id"], sets["own"]):
            own.setdefault(doc, []).append(np.frombuffer(raw, np.uint64))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up] if up in root else up
            return x

        out = []
        for a, b in pairs.sort_values("e", ascending=False)[["a", "b"]].itertuples(index=False):
            if (x := find(a)) != (y := find(b)) and any(linked(p, q) for p in own.get(a, []) for q in own.get(b, [])):
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return placed.groupBy("g").cogroup(sets.groupBy("h")).applyInPandas(links, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    n = common(a, b)
    return n * 100 >= PERCENT * (len(a) + len(b) - n)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)."""
    docs = keyed_texts(docs)
    own = materialize(signatures(docs), "near-signatures")
    same = own.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    same = materialize(same, "near-same")
    reps = own.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").where("n > 0")
    found = materialize(candidates(reps), "near-pairs")
    pairs, crowd = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("doc_id"))
    twice = own.select("doc_id", "s1", "s2", "n").where("n > 0").join(same.where("size > 1"), ["s1", "s2"]).where("rep <> doc_id")
    copies = twice.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    sizes = own.select("doc_id", (8 * F.col("n")).alias("bytes"))
    links = materialize(confirmed(docs, pairs, sizes, "near").union(_of_repeated(own, copies)), "near-links")
    part = materialize(components(links, "near-components"), "near-component").withColumnRenamed("node", "rep")
    if not crowd.isEmpty():
        crowd = crowd.join(part.withColumnRenamed("rep", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("part"))
        rest = materialize(between(docs, materialize(crowd, "near-crowd-parts")), "near-between")
        more = materialize(confirmed(docs, rest, sizes, "near-more"), "near-more-links")
        if not more.isEmpty():
            part = materialize(components(links.union(more), "near-all"), "near-all-component").withColumnRenamed("node", "rep")
    members = own.select("doc_id", "n", "s1", "s2").join(same.where("size > 1").select("s1", "s2", "rep"), ["s1", "s2"], "left")
    members = members.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")).join(part, "rep", "left")
    component = F.coalesce("component", "rep")
    return members.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _of_repeated(own: DataFrame, copies: DataFrame) -> DataFrame:
    """Links to their classes of rows whose doc_id occurs more than once: such a node belongs to several classes."""
    again = own.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("b"))
    return copies.join(again, "b", "left_semi").select("a", "b")


def op4_lsh_forest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
