"""Exact repeated substrings by bucket-pointer refinement over sparse suffixes (operator 7).

Every byte covered by a ``WIDTH``-byte string that also starts in a document with a smaller doc_id goes. That asks for
suffixes sorted to depth ``WIDTH``: a bucket of equal prefixes holds the documents of one string. Sorting every suffix
of a corpus would move it many times over, so the suffixes are made sparse first, without losing a string:

1.  Of the q-grams (q = ``GRAM``) in each string the one with the smallest hash, the first of equals, is its anchor. It
    depends on the string's bytes alone, so equal strings have equal anchors at the same place, and neighbouring
    strings mostly share theirs: about one byte in sixteen is an anchor.
2.  The text that one anchor stands for (all strings that it anchors, 50 to 80 bytes) is its context. Hashes of anchors
    and contexts meet by bucket; each slice of documents sends a context once, however many of its documents hold it.
    Whoever holds a context that a smaller document holds whole loses all of it, and needs no closer look. That
    settles the inside of every repeated passage. Only where an anchor has several contexts, at passages' edges, does
    the smallest document of each send its text on.
3.  There the suffixes of an anchor's contexts are sorted by bucket-pointer refinement: initial buckets are the 8-grams;
    a bucket is refined by the bucket identifiers at a later offset (8, then 16, then 18), which earlier rounds have
    refined already, and suffixes alone in their bucket are done. Buckets at depth 50 give each string's smallest doc_id.
4.  Covered runs return to their documents, are merged, and cut out.

Anchors with more contexts than a thousandth of all documents (``HOT``; there can be no more of those than a thousand
times a document's anchors, so their list is small whatever the input) are not gathered in one bucket: their strings go
one by one to buckets of their own 128-bit hash, each slice again sending a string once. Buckets are as many as the
tasks, which the session sets by its input, so a bucket's size doesn't grow with the corpus.

Hashes: contexts are equal if 92 bits are; a document finds the contexts it is told of among its own by 48 of these, so
one of n contexts of which m are told loses a wrong one with a chance of n m / 2^48 (200 of 200: one in 7 * 10^9
documents; a text of a megabyte with 60 000 of 60 000: one in 80 000).

Rows: null text is empty; texts shorter than 50 bytes lose nothing; longer ones of any length are handled whole. Matches never cross documents. Rows without doc_id
are left out. Rows that repeat a doc_id don't remove from each other, as none is smaller, and each is returned; exact
copies with a larger doc_id go whole. Empty tables give no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, materialize, partitions, slices

WIDTH, GRAM, HOT = 50, 20, 1000
_WINDOW = WIDTH - GRAM + 1
_CHUNK = 1 << 18
_POS = np.uint64((1 << 20) - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


_UP = np.uint64(0x9E3779B97F4A7C15)
_DOWN = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLES: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64: sums of terms times the one turn into hashes of any
    stretch that don't depend on its place by the other."""
    if len(_TABLES[0]) < n:
        for i, x in enumerate((_DOWN, _UP)):
            _TABLES[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)]), dtype=np.uint64)
    return _TABLES


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data).data, strides=(1,)).astype(np.uint64)


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (and the last ends)."""
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def anchored(data: np.ndarray, offsets: np.ndarray):
    """(first start, last start, 44 bits of the anchor's hash, 48 of the context's) of every run of strings with one
    anchor; no string crosses an offset."""
    out = []
    for at in range(0, len(data) - WIDTH + 1, _CHUNK):
        part = data[at : at + _CHUNK + WIDTH - 1]
        v = _words8(part)
        n = len(part) - GRAM + 1
        h = v[:n] * _C[0]
        h ^= v[8 : 8 + n] * _C[1]
        h ^= h >> np.uint64(31)
        h += v[GRAM - 8 : GRAM - 8 + n]
        h *= _C[2]
        h ^= h >> np.uint64(29)
        h *= _C[3]
        h &= ~_POS
        h |= np.arange(n, dtype=np.uint64)
        least, size = h, 1
        while 2 * size <= _WINDOW:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: n - _WINDOW + 1], least[_WINDOW - size :])
        starts = len(least)
        ends = offsets[1:]
        ends = ends[(ends > at) & (ends < at + starts + WIDTH)] - at
        mark = np.zeros(starts + 1, np.int32)
        np.add.at(mark, np.clip(ends - WIDTH + 1, 0, starts), 1)
        np.add.at(mark, np.clip(ends, 0, starts), -1)
        least = np.where(np.cumsum(mark[:-1]) > 0, ~np.uint64(0), least)
        cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(cut[1:], starts) - 1
        good = least[cut] != ~np.uint64(0)
        cut, last = cut[good], last[good]
        out.append((cut + at, last + at, least[cut] >> np.uint64(20), (least[cut] & _POS).astype(np.int64) + at))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    first, last, h, place = (np.concatenate(c) for c in zip(*out))
    # a run that a chunk's end cut in two is one again, so that runs depend on the text alone
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)])
    begin = np.flatnonzero(new)
    first, last, h = first[begin], last[np.append(begin[1:], len(new)) - 1], h[begin]
    down, up = _powers(min(len(data), _CHUNK + 2 * WIDTH) + 1)
    contexts = [np.zeros(0, np.uint64)]
    for at in range(0, len(data), _CHUNK):
        own = slice(*np.searchsorted(first, (at, at + _CHUNK)))
        v = _words8(data[at : at + _CHUNK + 2 * WIDTH])
        terms = v * _C[1]
        terms ^= terms >> np.uint64(32)
        terms *= _C[3]
        terms ^= terms >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms * down[: len(v)], dtype=np.uint64)])
        g = (sums[last[own] - at + WIDTH - 7] - sums[first[own] - at]) * up[first[own] - at] + (last[own] - first[own]).astype(np.uint64) * _C[2]
        g ^= g >> np.uint64(32)
        contexts.append((g * _C[0]) >> np.uint64(16))
    return first, last, h, np.concatenate(contexts)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, the first most significant, and the starts of equal runs."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


ASK = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("anchors", pa.binary()), ("contexts", pa.binary()), ("docs", pa.binary())])
TOLD = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("hashes", pa.binary())])
COVERED, WANTED, FREQUENT = 0, 1, 2


def _told(kind: int, docs: np.ndarray, hashes: np.ndarray):
    """Rows of TOLD, one for each document."""
    if not len(docs):
        return []
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return [(int(docs[a]), kind, _six(hashes[a:b])) for a, b in zip(cut, np.append(cut[1:], len(docs)))]


def anchor_contexts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, context) of a column of texts."""
    data, offsets = _text(column)
    first, _, h, g = anchored(data, offsets)
    return np.searchsorted(offsets, first, "right") - 1, h, g


def shared_contexts(docs: DataFrame, extract, buckets: int, hot: int) -> DataFrame:
    """TOLD: for each document the contexts that smaller documents hold too (COVERED), and those that it is the smallest
    to hold while others hold the anchor with another (WANTED); and the anchors of more contexts than ``hot`` (FREQUENT).

    ``extract`` gives (row, anchor, context) for a column of texts, hashes of at most 48 bits.
    """

    def ask(batches):
        for b in batches:
            for rows in slices(b, "text"):
                row, h, g = extract(rows.column("text"))
                if not len(h):
                    continue
                doc = rows.column("doc_id").to_numpy()[row]
                order, cut = _groups(h, g, doc)  # each (anchor, context, document) once
                h, g, doc = h[order[cut]], g[order[cut]], doc[order[cut]]
                head = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
                out = [(d % buckets, d, None, raw, None) for d, _, raw in _told(COVERED, doc[~head], g[~head])]
                h, g, doc = h[head], g[head], doc[head]
                place = (h % np.uint64(buckets)).astype(np.int32)
                by = np.argsort(place, kind="stable")
                for p, own in zip(np.unique(place), np.split(by, np.flatnonzero(np.diff(place[by])) + 1)):
                    out.append((int(p), None, _six(h[own]), _six(g[own]), doc[own].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ASK)], schema=ASK)

    def answer(batches):
        held, at = [], None

        def close():
            h, g = (np.concatenate([_from_six(x[c]) for x in held]) for c in (0, 1))
            doc = np.concatenate([np.frombuffer(x[2], np.int64) for x in held])
            order, _ = _groups(h, g, doc)
            h, g, doc = h[order], g[order], doc[order]
            anchor = np.concatenate([[True], h[1:] != h[:-1]])
            head = anchor | np.concatenate([[True], g[1:] != g[:-1]])
            lowest = doc[head][np.cumsum(head) - 1]
            later = doc > lowest
            out = _told(COVERED, doc[later], g[later])
            h, g, doc, anchor = h[head], g[head], doc[head], anchor[head]
            begin = np.flatnonzero(anchor)
            n = np.diff(np.append(begin, len(h)))
            several = np.repeat((n > 1) & (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)), n)
            out += _told(WANTED, doc[several], g[several])
            often = h[begin[n > hot]]
            if len(often):
                out.append((0, FREQUENT, _six(often)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), TOLD)], schema=TOLD)

        for b in batches:
            known = []
            for bucket, doc, h, g, who in zip(*(b.column(c).to_pylist() for c in ASK.names)):
                if h is None:
                    known.append((doc, COVERED, g))
                    continue
                if held and bucket != at:
                    yield from close()
                    held = []
                at = bucket
                held.append((h, g, who))
            if known:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*known), TOLD)], schema=TOLD)
        if held:
            yield from close()

    asked = docs.select("doc_id", "text").mapInArrow(ask, "bucket int, doc_id long, anchors binary, contexts binary, docs binary")
    return asked.repartition(partitions(asked.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "doc_id long, kind int, hashes binary")


def refine(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each start the bucket of its ``WIDTH`` bytes; -1 where no other start has the same."""
    alive = starts
    rank = np.full(len(data), -1, np.int64)

    def bucket(places: np.ndarray, keys: np.ndarray) -> None:
        """Pointers of these places; places alone in their bucket get none and are done."""
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        number = np.cumsum(new) - 1
        size = np.diff(np.append(np.flatnonzero(new), len(s)))
        rank[places] = -1
        many = size[number] > 1
        rank[places[order[many]]] = number[many]

    if not len(starts):
        return np.zeros(0, np.int64)
    v = _words8(data)
    needed = np.zeros(len(data), bool)
    for d in range(0, WIDTH - 7, 1):  # every place that a later round may ask for
        needed[alive + d] = True
    places = np.flatnonzero(needed)
    bucket(places, v[places])
    depth, within = 8, WIDTH
    for offset in (8, 16, WIDTH - 32):
        within = depth + offset
        last = WIDTH - within
        needed[:] = False
        for d in range(last + 1):
            needed[alive + d] = True
        places = np.flatnonzero(needed)
        here, there = rank[places], rank[places + offset]
        fine = (here >= 0) & (there >= 0)
        keys = here[fine] << 32 | there[fine]
        rank[places[~fine]] = -1
        if fine.any():
            old = places[fine]
            bucket(old, keys)
        depth = within
        alive = alive[rank[alive] >= 0]
    return rank[starts]


SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("texts", pa.binary()), ("at", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
RUNS = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("runs", pa.binary())])


def _runs(docs: np.ndarray, texts: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Rows of RUNS: [first, last) pairs by document."""
    if not len(docs):
        return []
    order, cut = _groups(docs, texts, first)
    docs, texts = docs[order], texts[order]
    both = np.stack([first[order], last[order]], axis=1).astype("<i8")
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (texts[1:] != texts[:-1])]))
    return [(int(docs[a]), int(texts[a]), both[a:b].tobytes()) for a, b in zip(new, np.append(new[1:], len(docs)))]


def _window_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = _words8(data)
    a, b = np.zeros(len(starts), np.uint64), np.full(len(starts), 7, np.uint64)
    for d in (*range(0, WIDTH - 7, 8), WIDTH - 8):
        x = v[starts + d]
        a = (a ^ x) * _C[0]
        a ^= a >> np.uint64(32)
        b = (b + x) * _C[3]
        b ^= b >> np.uint64(29)
    return a, b


def covered_runs(docs: DataFrame, told: DataFrame, often: np.ndarray, buckets: int) -> DataFrame:
    """(doc_id, k, runs): byte runs to remove, from what documents were told."""
    own = [F.collect_list(F.when(F.col("kind") == kind, F.col("hashes"))).alias(name) for kind, name in ((COVERED, "covered"), (WANTED, "wanted"))]
    lists = told.where(F.col("kind") != FREQUENT).groupBy("doc_id").agg(*own)

    def send(batches):
        for b in batches:
            for rows in slices(b, "text"):
                data, offsets = _text(rows.column("text"))
                ids, ks = rows.column("doc_id").to_numpy(), rows.column("k").to_numpy()
                first, last, h, g = anchored(data, offsets)
                row = np.searchsorted(offsets, first, "right") - 1
                mark = g ^ (row.astype(np.uint64) << np.uint64(48))
                within = lambda c: np.isin(mark, np.concatenate([_from_six(b"".join(x)) ^ (np.uint64(n & 0xFFFF) << np.uint64(48)) for n, x in enumerate(rows.column(c).to_pylist())]))
                gone = within("covered")
                out = [(d % buckets, 2, np.int64([d]).tobytes(), np.int64([t]).tobytes(), r, None, None) for d, t, r in _runs(ids[row[gone]], ks[row[gone]], first[gone] - offsets[row[gone]], last[gone] + WIDTH - offsets[row[gone]])]
                keep = within("wanted") & ~gone
                first, last, h, row = first[keep], last[keep], h[keep], row[keep]
                frequent = np.isin(h, often)
                # strings of frequent anchors one by one, each once in a slice
                n = (last - first + 1)[frequent]
                starts = np.repeat(first[frequent] - np.cumsum(n) + n, n) + np.arange(n.sum())
                if len(starts):
                    a, c = _window_hashes(data, starts)
                    owner = np.repeat(row[frequent], n)
                    doc, k = ids[owner], ks[owner]
                    order, cut = _groups(a, c, doc)
                    a, c, doc, k, own, place = a[order], c[order], doc[order], k[order], owner[order], starts[order]
                    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
                    size = np.diff(np.append(head, len(a)))
                    lowest = np.repeat(doc[head], size)
                    later = doc > lowest
                    at = place - offsets[own]
                    out += [(int(d) % buckets, 2, np.int64([d]).tobytes(), np.int64([t]).tobytes(), r, None, None) for d, t, r in _runs(doc[later], k[later], at[later], at[later] + WIDTH)]
                    own = np.flatnonzero(~later)  # of the smallest document, every place
                    where = (a[own] % np.uint64(buckets)).astype(np.int32)
                    by = np.argsort(where, kind="stable")
                    for p, x in zip(np.unique(where), np.split(own[by], np.flatnonzero(np.diff(where[by])) + 1)):
                        out.append((int(p), 1, doc[x].tobytes(), k[x].tobytes(), at[x].tobytes(), None, np.stack([a[x], c[x]], axis=1).tobytes()))
                first, last, h, row = (x[~frequent] for x in (first, last, h, row))
                if len(h):
                    size = last - first + WIDTH
                    where = (h % np.uint64(buckets)).astype(np.int32)
                    by = np.argsort(where, kind="stable")
                    for p, x in zip(np.unique(where), np.split(by, np.flatnonzero(np.diff(where[by])) + 1)):
                        text = b"".join([data[s : s + z].tobytes() for s, z in zip(first[x].tolist(), size[x].tolist())])
                        out.append((int(p), 0, ids[row[x]].tobytes(), ks[row[x]].tobytes(), (first[x] - offsets[row[x]]).tobytes(), size[x].tobytes(), text))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SENT)], schema=SENT)

    def sort(batches):
        held, now = {0: [], 1: []}, None

        def close():
            out = []
            if held[0]:
                doc, k, at, size = (np.concatenate([np.frombuffer(x[c], np.int64) for x in held[0]]) for c in range(4))
                data = np.frombuffer(b"".join(x[4] for x in held[0]), np.uint8)
                begin = np.cumsum(size) - size
                n = size - WIDTH + 1
                own = np.repeat(np.arange(len(size)), n)
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rank = refine(data, begin[own] + inside)
                out += later(doc[own], k[own], at[own] + inside, rank)
            if held[1]:
                doc, k, at = (np.concatenate([np.frombuffer(x[c], np.int64) for x in held[1]]) for c in range(3))
                both = np.frombuffer(b"".join(x[4] for x in held[1]), np.uint64).reshape(-1, 2)
                order, cut = _groups(both[:, 0], both[:, 1])
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(order))))
                out += later(doc, k, at, rank)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RUNS)], schema=RUNS)

        def later(doc, k, at, rank):
            some = np.flatnonzero(rank >= 0)
            if not len(some):
                return []
            lowest = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(lowest, rank[some], doc[some])
            some = some[doc[some] > lowest[rank[some]]]
            doc, k, at = doc[some], k[some], at[some]
            order, _ = _groups(doc, k, at)
            doc, k, at = doc[order], k[order], at[order]
            if not len(doc):
                return []
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (k[1:] != k[:-1]) | (at[1:] > at[:-1] + WIDTH)])
            cut = np.flatnonzero(new)
            return _runs(doc[cut], k[cut], at[cut], at[np.append(cut[1:], len(at)) - 1] + WIDTH)

        for b in batches:
            known = []
            for bucket, kind, *rest in zip(*(b.column(c).to_pylist() for c in SENT.names)):
                if kind == 2:
                    known.append((int(np.frombuffer(rest[0], np.int64)[0]), int(np.frombuffer(rest[1], np.int64)[0]), rest[2]))
                    continue
                if bucket != now and (held[0] or held[1]):
                    yield from close()
                    held = {0: [], 1: []}
                now = bucket
                held[kind].append(rest)
            if known:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*known), RUNS)], schema=RUNS)
        yield from close()

    sent = docs.join(lists, "doc_id").select("doc_id", "k", "text", "covered", "wanted").mapInArrow(send, "bucket int, kind int, docs binary, texts binary, at binary, sizes binary, data binary")
    return sent.repartition(partitions(sent.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(sort, "doc_id long, k long, runs binary")


def merged(raw: list[bytes]) -> list[tuple[int, int]]:
    """Maximal runs from pieces in any order."""
    x = np.concatenate([np.frombuffer(r, "<i8").reshape(-1, 2) for r in raw]) if raw else np.zeros((0, 2), np.int64)
    if not len(x):
        return []
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.concatenate([[True], x[1:, 0] > reach[:-1]]))
    return list(zip(x[new, 0].tolist(), reach[np.append(new[1:], len(x)) - 1].tolist()))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, text, runs): every document with the lists of byte runs that earlier documents hold (null: none)."""
    spark = docs.sparkSession
    docs = keyed_texts(docs).withColumn("k", F.xxhash64("text"))
    buckets = max(64, 5 * partitions(spark))  # a task sorts one after another
    told = materialize(shared_contexts(docs, anchor_contexts, buckets, max(HOT, docs.count() // 1000)), "substring-told")
    often = np.unique(np.concatenate([_from_six(r.hashes) for r in told.where(F.col("kind") == FREQUENT).toLocalIterator()] or [np.zeros(0, np.uint64)]))
    # the documents are dealt by identifier once, for both joins
    dealt = docs.repartition(partitions(spark), "doc_id")
    runs = covered_runs(dealt, told, often, buckets)
    return dealt.join(runs.groupBy("doc_id", "k").agg(F.collect_list("runs").alias("runs")), ["doc_id", "k"], "left").select("doc_id", "text", "runs")


def op7_bucket_refinement(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(batches):
        for b in batches:
            out = []
            for doc, text, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                data, spans, at, h = text.encode(), merged(raw or []), 0, hashlib.sha256()
                for first, last in spans:
                    h.update(data[at:first])
                    at = last
                h.update(data[at:])
                out.append((doc, len(data), sum(y - x for x, y in spans), len(spans), h.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return repeated_bytes(docs).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
