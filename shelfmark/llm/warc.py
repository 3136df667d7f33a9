"""WARC archives with a two-level capture index (operator 9).

``write`` puts a record for each page into gzip archives (one member a record, files roll over at ``ARCHIVE_BYTES``).
Of equal payloads of at least ``LEAST`` bytes the one with the smallest page_id is a response record; the others are
revisit records, which name it and hold the HTTP headers without the payload. ``index`` sorts the captures by
(reversed-host URL key, page_id) over all executors and writes index files: gzip blocks of ``BLOCK_LINES`` lines, then
the sparse directory of the blocks' first keys, then its place. A list with one row for each index file is the only
thing above them. ``Captures.find`` bisects that list, then a file's directory, reads one block and then the record, all
by range reads; ``read`` goes through the whole index the same way.

Rows: null html is an empty payload; null urls have the empty key; pages without page_id have no record. Rows that
repeat a page_id have a record each; a page never revisits its own page_id. Long pages are held one at a time. Empty
tables give no records; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, open_fs, partitions, put_file, scratch, slices

LEAST, ARCHIVE_BYTES, BLOCK_LINES = 100, 64 << 20, 512
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query: com,example,blog)/en/7?a=1; no scheme, user, default port or fragment."""
    if not url:
        return ""
    try:
        x = urlsplit(url.strip())
        host, port = (x.hostname or "").rstrip("."), x.port
    except ValueError:
        return re.sub(r"\s", "", url.lower())
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return re.sub(r"\s", "%20", f"{labels}){x.path or '/'}" + (f"?{x.query}" if x.query else ""))


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload's size and digest come from the payload where there is one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(h["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(x[len("<urn:page:") : -1])
    out = {"page_id": number(h["WARC-Record-ID"]), "record_type": h["WARC-Type"], "payload_bytes": size, "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": None, "payload": None}
    if h["WARC-Type"] == "revisit":
        return out | {"refers_to": number(h["WARC-Refers-To"])}
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        raise ValueError(f"page {out['page_id']}: the payload is damaged")
    return out | {"payload": payload}


def with_first(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to)."""
    rows = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    return rows.join(materialize(first, "warc-first"), "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


CAPTURE = "key string, page_id long, file string, offset long, length long"


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives in ``folder``; a CAPTURE row for each record."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def archive(batches):
        part, seq, held, size, out = TaskContext.get().partitionId(), 0, [], 0, []
        fs, top = open_fs(folder)

        def close():
            put_file(fs, f"{top}/{part:06d}-{seq:04d}.warc.gz", held)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            for rows in slices(b, "payload"):
                for page, url, payload, digest, refers in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = z.compress(record(page, url or "", payload.encode(), digest, refers)) + z.flush()
                    out.append((url_key(url), page, f"{part:06d}-{seq:04d}.warc.gz", size, len(raw)))
                    held.append(raw)
                    size += len(raw)
                    if size >= archive_bytes:
                        yield close()
                        seq, held, size, out = seq + 1, [], 0, []
        if out:
            yield close()

    return materialize(with_first(pages).mapInArrow(archive, CAPTURE), "warc-captures")


def index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Index files in ``folder``; (part, first_key, file) for each."""

    def write_index(batches):
        part = TaskContext.get().partitionId()
        pieces, directory, size, lines, first = [], [], 0, [], None

        def end():
            nonlocal size, lines
            if lines:
                raw = zlib.compress("\n".join(lines).encode(), 6)
                directory.append([lines[0].split(" ", 1)[0], size, len(raw)])
                pieces.append(raw)
                size, lines = size + len(raw), []

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length"))):
                lines.append(" ".join(map(str, row)))
                if len(lines) >= block_lines:
                    end()
        end()
        if directory:
            fs, top = open_fs(folder)
            tail = zlib.compress(json.dumps(directory).encode())
            put_file(fs, f"{top}/{part:06d}.cdx", [*pieces, tail, len(tail).to_bytes(8, "big")])
            yield pa.RecordBatch.from_pylist([{"part": part, "first_key": directory[0][0], "file": f"{part:06d}.cdx"}], schema=pa.schema([("part", pa.int32()), ("first_key", pa.string()), ("file", pa.string())]))

    order = captures.repartitionByRange(partitions(captures.sparkSession), "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return materialize(order.mapInArrow(write_index, "part int, first_key string, file string"), "warc-index")


class IndexFile:
    def __init__(self, folder: str, name: str):
        fs, top = open_fs(folder)
        self.file = fs.open_input_file(f"{top}/{name}")
        end = self.file.size() - 8
        n = int.from_bytes(self.file.read_at(8, end), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, end - n)))

    def block(self, k: int) -> list[list[str]]:
        _, at, n = self.directory[k]
        return [x.split(" ") for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n")]

    def find(self, key: str):
        """The lines with that key: from the last block that starts before it, on as long as blocks start with it."""
        firsts = [x[0] for x in self.directory]
        k = bisect_right(firsts, key) - 1
        while k > 0 and firsts[k] == key:
            k -= 1
        for j in range(max(k, 0), len(firsts)):
            if firsts[j] > key:
                break
            yield from (x for x in self.block(j) if x[0] == key)


class Archives:
    """Records by range reads; keeps a few files open."""

    def __init__(self, folder: str, most: int = 64):
        (self.fs, self.top), self.most, self.files = open_fs(folder), most, {}

    def get(self, file: str, offset: int, length: int) -> dict:
        if file not in self.files:
            if len(self.files) >= self.most:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.fs.open_input_file(f"{self.top}/{file}")
        return parse(zlib.decompress(self.files[file].read_at(length, offset), 31))


class Captures:
    """Look-ups by URL. ``files`` has a row for each index file."""

    def __init__(self, folder: str, files: DataFrame):
        self.folder, self.archives = folder, Archives(folder)
        self.files = [(r.first_key, r.file) for r in files.orderBy("part").collect()]

    def find(self, url: str) -> list[dict]:
        key, firsts = url_key(url), [k for k, _ in self.files]
        k = bisect_right(firsts, key) - 1
        while k > 0 and firsts[k] == key:
            k -= 1
        out = []
        for first, name in self.files[max(k, 0) :]:
            if first > key:
                break
            out += [self.archives.get(f, int(o), int(n)) for _, _, f, o, n in IndexFile(self.folder, name).find(key)]
        return out


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record that the index names."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    listed = spark.createDataFrame([(r.file,) for r in files.toLocalIterator()], "file string")
    listed = listed.repartition(max(1, listed.count()))

    def records(batches):
        archives = Archives(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                own = IndexFile(folder, name)
                for k in range(len(own.directory)):
                    lines = sorted((f, int(o), int(n)) for _, _, f, o, n in own.block(k))
                    yield pa.RecordBatch.from_pylist([{x: r[x] for x in schema.names} for r in (archives.get(*x) for x in lines)], schema=schema)

    return listed.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc_index(pages: DataFrame) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    return read(pages.sparkSession, folder, index(write(pages, folder), folder))


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
