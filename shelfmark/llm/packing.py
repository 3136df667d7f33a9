"""Packing along a space-filling curve (operator 1).

Every document becomes a hashed vector (token counts, damped by logarithm, in signed buckets), which a fixed random
matrix projects to ``DIMS`` dimensions. The normal distribution function spreads each coordinate over ``BITS`` bits, and
the Hilbert curve through that grid gives a key. Documents are range-sorted by (key, doc_id), so neighbours on the curve
have like vocabulary, and laid end to end into sequences of ``LENGTH`` ids; a document is cut where a sequence is full.
Only the last sequence can need padding, at most ``LENGTH`` - 1 ids in the whole corpus (none if its length is a power
of two).

The sort moves no ids: a slim table (row, key, length) is range-sorted and summed, one total for each of its
partitions goes to the driver, and the ids meet their places by an equi-join on the row number.

Rows: null text is an empty document (its end id alone). A row without an identifier is packed too, with a null doc_id.
Repeated identifiers are packed as rows of their own; repeated texts have the same key and lie side by side, in order
of doc_id. A text of any length is packed whole, over as many sequences as it needs. Empty tables give no rows. Other
columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, slices
from .tokens import END_ID, encoder

LENGTH, DIMS, BITS, BUCKETS = 4096, 4, 15, 1 << 12


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2 ** bits (axes to transposed index, then interleaved)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess work of lower bits
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _directions(size: int) -> np.ndarray:
    """For each token id the projection of its signed bucket."""
    ids = np.arange(size, dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    matrix = np.random.default_rng(20).standard_normal((BUCKETS, DIMS))
    return matrix[(mixed % np.uint64(BUCKETS)).astype(int)] * np.where(mixed >> np.uint64(63), 1.0, -1.0)[:, None]


def curve_keys(ids: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    size = len(directions)
    tokens = np.minimum(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64), size - 1)
    tokens += np.repeat(np.arange(len(ids), dtype=np.int64) * size, [len(x) for x in ids])
    tokens.sort()  # by document and token
    head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)])
    weight, (doc, own) = np.log1p(np.diff(np.append(head, len(tokens)))), np.divmod(tokens[head], size)
    at = np.stack([np.bincount(doc, weight * directions[own, k], len(ids)) for k in range(DIMS)], axis=1)
    at /= np.maximum(np.sqrt(np.bincount(doc, weight * weight, len(ids))), 1e-9)[:, None]
    share = 0.5 * (1 + np.tanh(at * (0.7978845608 + 0.0356774 * at * at)))  # normal distribution function, nearly
    return hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def encoded(docs: DataFrame, vocab: str) -> DataFrame:
    """(row, doc_id, curve, n, ids): ids with the end id as little-endian integers of 2 or 4 bytes."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("curve", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc = encoder(vocab)
        kind = "<u4" if enc.wide else "<u2"
        end = np.array([END_ID], kind).tobytes()
        directions = _directions(enc.tokenizer.get_vocab_size(with_added_tokens=True))
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for rows in slices(b, "text", 16 << 20):
                ids = enc.encode(rows.column("text"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(ids))), rows.column("doc_id"), pa.array(curve_keys(ids, directions)),
                    pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() + end for x in ids], pa.binary())], schema=schema)
                row += len(ids)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(texts.mapInArrow(run, "row long, doc_id long, curve long, n long, ids binary"), "pack-ids")


def placed(ids: DataFrame) -> DataFrame:
    """(row, at): ids before each document along the curve."""
    spark = ids.sparkSession

    def running(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            sums = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.full(len(n), part, np.int32)), pa.array(sums - n), b.column("n")], names=["row", "part", "local", "n"])
            at = int(sums[-1]) if len(n) else at

    order = ids.select("row", "curve", "doc_id", "n").repartitionByRange(partitions(spark), "curve", "doc_id", "row").sortWithinPartitions("curve", "doc_id", "row")
    order = materialize(order.mapInArrow(running, "row long, part int, local long, n long"), "pack-order")
    totals, before = [], 0
    for part, n in sorted(order.groupBy("part").agg(F.sum("n").alias("n")).toLocalIterator()):  # a row for each partition
        totals.append((part, before))
        before += n
    totals = spark.createDataFrame(totals, "part int, before long")
    return order.join(F.broadcast(totals), "part").select("row", (F.col("before") + F.col("local")).alias("at"))


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocab: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """A row for each piece: PIECE, and with ``with_ids`` the piece's ids as an array."""
    ids = encoded(docs, vocab)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def pieces(batches):
        for b in batches:
            out = []
            for doc, n, at, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "at", "ids"))):
                own = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    part = own[start : start + size]
                    out.append((doc, start, size, zlib.crc32(part.tobytes()), n, seq, offset) + (part.astype(np.int32),) * with_ids)
                    start += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return ids.select("row", "doc_id", "n", "ids").join(placed(ids), "row").select("doc_id", "n", "at", "ids").mapInArrow(pieces, PIECE + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n): the padded sequences, each at most ``length`` ids, from ``pack(..., with_ids=True)``."""
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")
    )
    n = F.size("ids")
    power = F.bit_count(n.cast("long")) == 1
    padded = F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), length - n))))
    return joined.select("sequence_id", padded.alias("ids"), n.cast("long").alias("n"))


def op1_curve_packing(docs: DataFrame, vocab: str) -> DataFrame:
    return pack(docs, vocab, with_ids=False)
