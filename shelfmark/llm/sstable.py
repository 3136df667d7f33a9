"""Sorted-string-table shards of token ids (operator 6).

``write`` sorts documents by identifier over all executors and writes shard files; ``read`` streams the shards back in
key order; ``Shard`` opens one file and finds single documents by Bloom filter and binary search.

A shard, all integers little-endian but keys:

    block*   entries, then the restart offsets as u32 and their number as u32, all compressed by zlib
             entry: varint shared, varint unshared, varint value bytes, the key's unshared bytes, the value
             shared counts the bytes in common with the key before; it is 0 at a restart (every 16 entries)
    filter   bits of a Bloom filter, 10 for each key, 7 probes by double hashing
    index    for each block: first key (8), last key (8), offset u64, bytes u32, entries u32, ids before it u64
    footer   filter offset u64, index offset u64, blocks u32, bytes of an id u32, documents u64, ids u64, crc32 of filter and index u32, magic (8)

A key is the identifier as big-endian signed 64 bits with the sign bit turned over, so bytes sort as numbers do. A value
holds the ids with 2 bytes each if the vocabulary allows, else 4.

Rows: null text is an empty document (the end id alone); rows without an identifier can't be keyed and are left out;
repeated identifiers are all kept, in order of their text, and ``Shard.get`` finds the first. Empty tables give no shard.
Other columns don't matter. A document's ids are held whole in memory, a shard's blocks are not: files roll over at
``shard_bytes``.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, keyed_texts, materialize, open_fs, partitions, put_file, scratch, slices
from .tokens import END_ID, encoder

MAGIC, FOOTER, ENTRY = b"SHLFSST1", struct.Struct("<QQIIQQI8s"), struct.Struct("<8s8sQIIQ")
BLOCK_BYTES, SHARD_BYTES, RESTART = 64 << 10, 128 << 20, 16
BITS, PROBES = 10, 7


def pack_key(key: int) -> bytes:
    return ((key + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def unpack_key(raw: bytes) -> int:
    return int.from_bytes(raw, "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = raw[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class Writer:
    """Blocks are finished as they fill; ``finish`` gives the file's bytes in pieces."""

    def __init__(self, id_bytes: int):
        self.id_bytes, self.pieces, self.index, self.keys = id_bytes, [], [], []
        self.size = self.ids = 0
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.first, self.last, self.entries, self.before = bytearray(), [], None, b"", 0, self.ids

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries % RESTART == 0:
            shared = 0
            self.restarts.append(len(self.block))
        else:
            shared = next((i for i in range(8) if key[i] != self.last[i]), 8)
        self.block += _varint(shared) + _varint(8 - shared) + _varint(len(value)) + key[shared:] + value
        self.first, self.last = self.first or key, key
        self.entries += 1
        self.ids += len(value) // self.id_bytes
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._end()

    def _end(self) -> None:
        if self.entries:
            raw = zlib.compress(bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts)), 1)
            self.index.append(ENTRY.pack(self.first, self.last, self.size, len(raw), self.entries, self.before))
            self.pieces.append(raw)
            self.size += len(raw)
        self._start()

    def finish(self) -> list[bytes]:
        self._end()
        bits = max(64, BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for i in _probes(k, 8 * len(bloom)):
                bloom[i >> 3] |= 1 << (i & 7)
        tail = bytes(bloom) + b"".join(self.index)
        return [*self.pieces, tail, FOOTER.pack(self.size, self.size + len(bloom), len(self.index), self.id_bytes, len(self.keys), self.ids, zlib.crc32(tail), MAGIC)]


class Shard:
    """Random access to one file: footer, filter and index are read at once, blocks as needed."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        at, index, blocks, self.id_bytes, self.documents, self.ids, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        tail = self.file.read_at(end - FOOTER.size - at, at)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError(f"{uri} is not a whole shard")
        self.bloom = tail[: index - at]
        self.index = [ENTRY.unpack_from(tail, index - at + k * ENTRY.size) for k in range(blocks)]
        self.firsts = [x[0] for x in self.index]

    def block(self, k: int) -> tuple[bytes, list[int]]:
        raw = zlib.decompress(self.file.read_at(self.index[k][3], self.index[k][2]))
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 - 4 * n
        return raw[:end], list(struct.unpack_from(f"<{n}I", raw, end))

    def entries(self, raw: bytes, at: int = 0):
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            unshared, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + unshared]
            at += unshared + size
            yield key, raw[at - size : at]

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self.entries(self.block(k)[0])

    def get(self, doc_id: int) -> bytes | None:
        """The ids of a document, as stored, or None."""
        key = pack_key(doc_id)
        if not all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _probes(key, 8 * len(self.bloom))):
            return None
        k = max(0, bisect_right(self.firsts, key) - 1)
        while k and self.index[k - 1][1] == key:  # repeated keys can begin in a block before
            k -= 1
        for j in range(k, min(k + 2, len(self.index))):
            if not self.index[j][0] <= key <= self.index[j][1]:
                continue
            raw, restarts = self.block(j)
            low, high = 0, len(restarts) - 1
            while low < high:  # the last restart whose key is below the one sought
                mid = (low + high + 1) // 2
                low, high = (mid, high) if next(self.entries(raw, restarts[mid]))[0] < key else (low, mid - 1)
            for found, value in self.entries(raw, restarts[low]):
                if found >= key:
                    return value if found == key else None
        return None


MANIFEST = "path string, first_id long, part int, seq int, n_docs long, n_ids long"


def write(docs: DataFrame, vocab: str, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of ``docs`` in ``folder``; returns a row for each: MANIFEST. In order of (part, seq) keys ascend."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "sst")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)

    def shards(batches):
        enc, part, seq = encoder(vocab), TaskContext.get().partitionId(), 0
        width, kind = (4, "<u4") if enc.wide else (2, "<u2")
        fs, top = open_fs(folder)
        w = Writer(width)

        def close():
            name = f"{part:06d}-{seq:04d}.sst"
            put_file(fs, f"{top}/{name}", w.finish())
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first_id": unpack_key(w.keys[0]), "part": part, "seq": seq, "n_docs": len(w.keys), "n_ids": w.ids}], schema=schema)

        end = END_ID.to_bytes(width, "little")
        for b in batches:
            for rows in slices(b, "text", 16 << 20):
                for key, ids in zip(rows.column("doc_id").to_pylist(), enc.encode(rows.column("text"))):
                    w.add(pack_key(key), ids.astype(kind).tobytes() + end)
                    if w.size >= shard_bytes:
                        yield close()
                        w, seq = Writer(width), seq + 1
        if w.keys:
            yield close()

    schema = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    sorted_docs = keyed_texts(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(sorted_docs.mapInArrow(shards, MANIFEST), "sst-manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. The manifest has a row for each shard."""
    before, rows = 0, []
    for r in manifest.orderBy("part", "seq").toLocalIterator():
        rows.append((r.path, before))
        before += r.n_ids
    listed = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))

    def documents(batches):
        out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                shard, got = Shard(path), []
                for key, value in shard:
                    if shard.id_bytes == 2:
                        value = np.frombuffer(value, "<u2").astype("<u4").tobytes()
                    got.append((unpack_key(key), at, len(value) // 4, zlib.crc32(value)))
                    at += len(value) // 4
                    if len(got) == 10_000:
                        yield batch(out, *zip(*got))
                        got = []
                if got:
                    yield batch(out, *zip(*got))

    return listed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_sstable(docs: DataFrame, vocab: str) -> DataFrame:
    return read(docs.sparkSession, write(docs, vocab))
