"""Benchmark decontamination by a BM25 index with block-max WAND (operator 10).

Test items are cut into entries of at most ``ENTRY`` words, indexed by word with BM25 impacts divided by the entry's
score for itself, so one threshold ``LEAST`` (a share of the perfect score) serves all. Every passage of ``2 * ENTRY``
words, one each ``ENTRY`` words, of every document is a query; it holds any copy of an entry whole. Retrieval is safe:

1.  passages whose words' list maxima can't add up to the threshold fall out;
2.  the words' block maxima (of ``BLOCK`` entries) are added up, and blocks that can't reach it fall out;
3.  entries of the other blocks get their exact score.

All above the threshold are verified around the passage on the item's five-word shingles: at least 0.75 of them occur
there, and at least half of the question's (all but the last sentence) and of the answer's (the last sentence; with
fewer than five words, its words). An item of fewer than five words has its whole sequence as only shingle, which must
occur there as neighbours, anywhere in a text of any length.

Items are read in waves of at most ``WAVE`` words, whose index is the only thing broadcast; the usual benchmark is one
wave, a larger one more passes over the documents. Document frequencies and lengths are those of all items' entries,
counted before, and an entry's score depends on nothing else, so waves of any size and order give the same rows.

Rows: null or empty texts match nothing, null items and items without words neither. A document of fewer than five words
holds only items that are as short. Items that are equal all match. Documents of any length are searched whole. Documents
without doc_id are left out by ``matches`` and kept by ``clean``. Of several matches of a document and an item, in a text or
in rows that repeat a doc_id, that of most overlap counts (of equal ones that of the best score). Empty tables give no
matches. Other columns don't matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, materialize, scratch, slices
from .shingles import SIZE, combine, word_hashes, words

ENTRY, BLOCK, LEAST, OVERLAP, PART, WAVE = 64, 8, 0.5, 0.75, 0.5, 100_000
K1, B = 1.2, 0.75


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; a single sentence is all question."""
    cut = [m.end() for m in re.finditer(r"[.!?:]\s+|\n", text.strip())]
    return (text.strip()[: cut[-1]], text.strip()[cut[-1] :]) if cut else (text, "")


class Item:
    def __init__(self, item_id: int, text: str):
        own = word_hashes(words(text))
        self.item_id, self.size = item_id, len(own)
        self.gram = min(SIZE, self.size)
        self.all = np.unique(combine(own, self.gram))
        # question and answer: five-word shingles, or the words of one that has none
        self.parts = [(n, np.unique(combine(h, n))) for h in (word_hashes(words(t)) for t in question_and_answer(text)) for n in (SIZE if len(h) >= SIZE else 1,)]


def entries(text: str) -> list[list[bytes]]:
    """An item's words in parts; fewer than a shingle at the end belong to none."""
    own = words(text)
    return [own[at : at + ENTRY] for at in range(0, len(own), ENTRY) if not at or len(own) - at >= SIZE]


class Index:
    """Items' postings. ``total`` and ``words`` are the number of all entries, of these items or not, and their words;
    ``counts`` has how many of them hold a word. Left out, they are those of the items."""

    def __init__(self, items: list[tuple[int, str]], counts: dict[bytes, int] | None = None, total: int = 0, words: int = 0):
        self.items = [Item(i, t) for i, t in items]
        self.entry_item, docs = [], []
        for n, (_, text) in enumerate(items):
            own = entries(text)
            docs += own
            self.entry_item += [n] * len(own)
        self.terms: dict[bytes, int] = {}
        rows = []
        for e, own in enumerate(docs):
            tf: dict[bytes, int] = {}
            for w in own:
                tf[w] = tf.get(w, 0) + 1
            rows += [(self.terms.setdefault(w, len(self.terms)), e, n) for w, n in tf.items()]
        term, entry, tf = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        n, v = len(docs), len(self.terms)
        length = np.array([len(d) for d in docs], float)
        if counts is None:
            df, total, words = np.bincount(term, minlength=v), n, length.sum()
        else:
            df = np.array([counts[w] for w in self.terms], np.int64)
        idf = np.log((total - df + 0.5) / (df + 0.5) + 1)
        norm = K1 * (1 - B + B * length * total / words) if n else length
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[entry])
        impact /= np.bincount(entry, impact, n)[entry]
        most = np.zeros(v)
        np.maximum.at(most, term, impact)
        number = np.empty(v, np.int64)
        number[np.argsort(most, kind="stable")] = np.arange(v)  # terms in order of their largest impact
        self.terms = {w: int(number[t]) for w, t in self.terms.items()}
        self.most, term = np.sort(most), number[term]
        self.entries, self.blocks = max(1, n), max(1, -(-n // BLOCK))
        order = np.lexsort((entry, term))
        term, self.entry, self.impact = term[order], entry[order], impact[order]
        self.posting = term * self.entries + self.entry
        self.dense = np.zeros((max(1, v), self.blocks), np.float32)  # block maxima, rounded up
        np.maximum.at(self.dense, (term, self.entry // BLOCK), np.nextafter(self.impact.astype(np.float32), np.float32(2)))

    def retrieve(self, passage: np.ndarray, term: np.ndarray):
        """(passage, entry, score) of all at or above LEAST, for distinct (passage, term) rows in order of passage."""
        if not len(passage):
            return passage, passage, np.zeros(0)
        begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        likely = np.add.reduceat(self.most[term], begin) >= LEAST - 1e-9
        first, end = begin[likely], np.append(begin[1:], len(passage))[likely]
        # blocks that the passage's words could lift to the threshold
        rows, _ = _expand(first, end)
        if not len(rows):
            return passage[:0], passage[:0], np.zeros(0)
        n, block = np.nonzero(np.add.reduceat(self.dense[term[rows]], np.cumsum(end - first) - (end - first), axis=0) >= LEAST - 1e-4)
        # their entries
        row, at = _expand(first[n], end[n])
        begin = term[row] * self.entries + block[at] * BLOCK
        low = np.searchsorted(self.posting, begin)
        high = np.searchsorted(self.posting, np.minimum(begin + BLOCK, (term[row] + 1) * self.entries))
        place, of = _expand(low, high)
        pairs, which = np.unique(n[at[of]] * self.entries + self.entry[place], return_inverse=True)
        score = np.bincount(which, self.impact[place], len(pairs))
        keep = score >= LEAST - 1e-9
        return passage[first[pairs[keep] // self.entries]], pairs[keep] % self.entries, score[keep]

    def search(self, texts: pa.Array):
        """(row, item, score, overlap, question overlap, answer overlap) of verified matches, the best of each row and item."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        known = np.array([self.terms.get(w.encode(), -1) for w in coded.dictionary.to_pylist()] or [-1], np.int64)
        term = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sums = np.concatenate([[0], np.cumsum(np.where(term >= 0, self.most[term] if len(self.most) else 0, 0))])
        n = np.diff(offsets)
        count = np.maximum(1, -(-n // ENTRY) - 1) * (n > 0)
        row = np.repeat(np.arange(len(n)), count)
        begin = offsets[row] + ENTRY * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        end = np.minimum(begin + 2 * ENTRY, offsets[row + 1])
        likely = np.flatnonzero(sums[end] - sums[begin] >= LEAST - 1e-9)
        best: dict[tuple[int, int], tuple] = {}
        for part in np.array_split(likely, max(1, len(likely) * 64 * self.blocks // 4_000_000)):
            place, at = _expand(begin[part], end[part])
            fine = term[place] >= 0
            v = max(1, len(self.terms))
            distinct = np.unique(part[at[fine]] * v + term[place[fine]])
            for p, e, score in zip(*(x.tolist() for x in self.retrieve(distinct // v, distinct % v))):
                r, item = int(row[p]), self.items[self.entry_item[e]]
                score = round(score, 9)
                if (known_best := best.get((r, self.entry_item[e]))) and known_best[1] >= 1 and known_best[0] >= score:
                    continue
                own = words(texts[r].as_py()) if (r, -1) not in best else best[r, -1]
                best[r, -1] = own
                a, z = max(0, int(begin[p] - offsets[r]) - item.size), int(end[p] - offsets[r]) + item.size
                h = word_hashes(own[a:z])
                sets = {n: np.unique(combine(h, n)) for n in {item.gram, *(n for n, _ in item.parts)}}
                share = lambda n, x: float(np.isin(x, sets[n]).mean()) if len(x) else 1.0
                parts = [share(n, x) for n, x in ((item.gram, item.all), *item.parts)]
                if parts[0] >= OVERLAP and min(parts[1:]) >= PART and (not known_best or (parts[0], score) > (known_best[1], known_best[0])):
                    best[r, self.entry_item[e]] = (score, *parts)
        return [(r, self.items[i].item_id, *x) for (r, i), x in best.items() if i >= 0]


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges [first, last), and which range each is of."""
    n = np.maximum(last - first, 0)
    at = np.repeat(np.arange(len(n)), n)
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), at


MATCH = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def counted(items: DataFrame) -> tuple[DataFrame, int, int]:
    """(item_id, text, words, counts) with each item's words and how many entries of all items hold them; entries; their words."""

    def run(batches):
        for b in batches:
            for i, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                own = entries(text)
                if own:
                    held = [(w, k) for k, e in enumerate(own) for w in set(e)]
                    sizes = [len(own[k]) if n == 0 or held[n - 1][1] != k else 0 for n, (_, k) in enumerate(held)]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(held), pa.int64()), pa.array([w for w, _ in held], pa.binary()), pa.array(sizes, pa.int64())], names=["item", "word", "size"])

    rows = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    spread = materialize(rows.select("item", "text").mapInArrow(run, "item long, word binary, size long"), "item-words")
    total, held = spread.agg(F.count_if(F.col("size") > 0), F.sum("size")).first()
    df = spread.groupBy("word").agg(F.count("*").alias("df"))
    own = spread.select("item", "word").distinct().join(df, "word").groupBy("item").agg(F.collect_list("word").alias("words"), F.collect_list("df").alias("counts"))
    return rows.join(own, "item").select("item_id", "text", "words", "counts"), total, held or 0


def matches(docs: DataFrame, items: DataFrame, wave_words: int = WAVE) -> DataFrame:
    """MATCH: a row for each document and test item of which it holds a copy."""
    spark: SparkSession = docs.sparkSession
    docs, path = keyed_texts(docs), scratch(spark, "matches")
    spark.createDataFrame([], MATCH).write.parquet(path)
    listed = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    listed, total, held = counted(listed)

    def run(wave: list[tuple[int, str]], counts: dict[bytes, int]) -> None:
        shared = spark.sparkContext.broadcast(Index(wave, counts, total, held))

        def scan(batches):
            for b in batches:
                for rows in slices(b, "text"):
                    ids = rows.column("doc_id").to_pylist()
                    found = [(ids[r], *x) for r, *x in shared.value.search(rows.column("text"))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [pa.int64()] * 2 + [pa.float64()] * 4)], names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        docs.mapInArrow(scan, MATCH).write.mode("append").parquet(path)
        shared.destroy()

    wave, counts, size = [], {}, 0
    for item_id, text, own, df in listed.toLocalIterator():
        wave.append((item_id, text))
        counts.update(zip(map(bytes, own), df))
        size += len(words(text))
        if size >= wave_words:
            run(wave, counts)
            wave, counts, size = [], {}, 0
    if wave:
        run(wave, counts)
    found = spark.read.schema(MATCH).parquet(path)
    best = F.max(F.struct("overlap", "score", "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *(F.col(f"best.{c}").alias(c) for c in found.columns[2:]))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a test item."""
    bad = matches(docs, items).select("doc_id").distinct().withColumnRenamed("doc_id", "__leak")
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("__leak"), "left_anti")


def op10_bm25_wand(docs: DataFrame, items: DataFrame) -> DataFrame:
    return matches(docs, items)
