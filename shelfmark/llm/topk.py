"""Exact top-k search by multi-resolution segment statistics (operator 3).

Components become floor(256 * x). A vector is cut into 1, 4, 16 and more segments (``levels``); each keeps its mean m and
deviation s. For a segment of n components, n * ((m - m')² + (s - s')²) is a lower bound of the squared distance there,
and by q·v = (|q|² + |v|² - d²) / 2 the bound on distance is the upper bound n * (m m' + s s') on the inner product.
Components are put in order of their deviation over the wave's queries, so that segments hold like ones and the finest
levels are exact where vectors differ most. Pairs go from coarse to fine: at each level from ``SEED`` segments on a query's k pairs
of best bound get their exact product, which raises its threshold, and those whose bound falls below its k-th best score
so far are dropped. Only survivors of all levels get the exact integer product too; ``Search.exact_pairs`` counts all.

Queries are taken in waves of at most ``WAVE_BYTES``, the only data broadcast; every wave passes once over all vectors
in blocks, each task keeps k results for a query, and a ranked window joins the tasks' results. Statistics of a block are
made once for a wave, a small part of comparing it with that wave.

Rows: vectors null, empty, or holding null or non-finite components, and rows without vec_id, take no part. Vectors of
another length than the query's are no candidates for it. Ties go to the smaller vec_id. A repeated vec_id is a
candidate with each of its rows, and a query for each, ranked apart; its rows don't find one another. Scores beyond a
long are held to a long's range. Empty tables give no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

SCALE, SEED, WAVE_BYTES, BLOCK, QUERY_BLOCK = 256, 16, 16 << 20, 2048, 256
LONG = (1 << 63) - 1


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine)


def quantized(flat: np.ndarray, dims: int) -> np.ndarray:
    return np.floor(SCALE * flat.reshape(-1, dims).astype(np.float64))


def levels(dims: int) -> list[int]:
    """Numbers of segments, coarse to fine: 1, 4, 16, ... up to a fourth of the components, then half, three and seven eighths."""
    coarse = [4**k for k in range(dims.bit_length()) if 4 ** (k + 1) <= dims]
    return sorted({1, *coarse, *(d for d in (dims // 2, dims * 3 // 4, dims * 7 // 8) if 0 < d < dims)})


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row the means and deviations of its segments, times the root of their lengths; first segments are longest."""
    n, dims = min(segments, x.shape[1]), x.shape[1]
    size, longer = divmod(dims, n)
    parts = [x[:, : longer * (size + 1)].reshape(len(x), longer, size + 1), x[:, longer * (size + 1) :].reshape(len(x), n - longer, size)]
    return np.concatenate([f(p, axis=2) * np.sqrt(p.shape[2]) for p in parts for f in ((np.mean, np.std) if p.shape[2] > 1 else (np.mean,)) if p.shape[1]], axis=1)


class Search:
    """The k best of all blocks seen, for queries of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.order = np.argsort(x.std(axis=0), kind="stable") if len(x) else np.arange(x.shape[1])
        self.ids, self.x, self.k = ids, x[:, self.order], k
        self.best = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), LONG, np.int64)
        self.levels = levels(x.shape[1])
        self.stats = [statistics(self.x, s) for s in self.levels]
        self.seed = max(n for n, s in enumerate(self.levels) if s <= SEED)
        self.most = np.abs(x).max(initial=0)
        self.exact_pairs = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id][:, self.order]
        if x.shape[1] * max(1.0, self.most) * max(1.0, np.abs(x).max(initial=0)) >= 1 << 52:
            return self._add_wide(ids, x)
        stats = [statistics(x, s) for s in self.levels]
        for at in range(0, len(self.ids), QUERY_BLOCK):
            q = slice(at, at + QUERY_BLOCK)
            live = self.ids[q, None] != ids
            for level, (own, other) in enumerate(zip(self.stats, stats)):
                bound = np.full(live.shape, -np.inf)
                if np.count_nonzero(live) > live.size // 8:
                    np.copyto(bound, own[q] @ other.T, where=live)
                else:  # few are left: only theirs
                    i, j = np.nonzero(live)
                    for a in range(0, len(i), 65536):
                        u, v = i[a : a + 65536], j[a : a + 65536]
                        bound[u, v] = np.einsum("ij,ij->i", own[q][u], other[v])
                if level >= self.seed:
                    first = np.argpartition(-bound, min(self.k, len(ids)) - 1, axis=1)[:, : self.k]
                    i, j = np.repeat(np.arange(len(first)), first.shape[1]), first.ravel()
                    fine = live[i, j]
                    live[i, j] = False
                    self._exact(at, i[fine], ids, x, j[fine])
                live &= bound + np.abs(np.maximum(bound, -LONG)) * 1e-9 + 1e-3 >= self.best[q, -1:]  # a margin well above the bound's rounding
            i, j = np.nonzero(live)
            self._exact(at, i, ids, x, j)

    def _exact(self, at: int, i: np.ndarray, ids: np.ndarray, x: np.ndarray, j: np.ndarray) -> None:
        self.exact_pairs += len(i)
        for a in range(0, len(i), 65536):
            u, v = i[a : a + 65536], j[a : a + 65536]
            score = np.einsum("ij,ij->i", self.x[at + u], x[v])
            keep = score >= self.best[at + u, -1]
            self._merge(at, u[keep], ids[v[keep]], score[keep])

    def _merge(self, at: int, i: np.ndarray, who: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(i)
        if not len(touched):
            return
        old = np.repeat(touched, self.k)
        i, who, score = (np.concatenate(x) for x in ((i, old), (who, self.who[at + touched].ravel()), (score, self.best[at + touched].ravel())))
        order = np.lexsort((who, -score, i))
        i, who, score = i[order], who[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = rank < self.k
        self.best[at + i[top], rank[top]] = score[top]
        self.who[at + i[top], rank[top]] = who[top]

    def _add_wide(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Components too large for exact products in floating point: whole numbers of any size."""
        big = [[int(c) for c in v] for v in x]
        for n, (own, q) in enumerate(zip(self.ids, ([int(c) for c in v] for v in self.x))):
            score = [max(-LONG, min(LONG, sum(a * b for a, b in zip(q, v)))) for v in big]
            both = [(-s, int(w)) for s, w in zip(score, ids) if w != own] + [(-s if np.isinf(s) else -int(s), int(w)) for s, w in zip(self.best[n], self.who[n])]
            for r, (s, w) in enumerate(sorted(both)[: self.k]):
                self.best[n, r], self.who[n, r] = -s, w

    def rows(self):
        for n, r in zip(*np.nonzero(np.isfinite(self.best))):
            yield n, int(self.who[n, r]), max(-LONG, min(LONG, int(self.best[n, r])))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` its k best of ``vectors``; both from ``usable``."""
    spark = vectors.sparkSession
    path, schema = scratch(spark, "topk"), "wave int, q int, query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    wave, held, number = [], 0, 0

    def run(wave: list, number: int) -> None:
        by_length: dict[int, list] = {}
        for n, (i, v) in enumerate(wave):
            by_length.setdefault(len(v), []).append((n, i, v))
        shared = spark.sparkContext.broadcast({
            d: (np.array([n for n, _, _ in own]), np.array([i for _, i, _ in own], np.int64), quantized(np.concatenate([v for _, _, v in own]), d))
            for d, own in by_length.items()
        })

        def scan(batches):
            found = {d: (n, Search(i, x, k)) for d, (n, i, x) in shared.value.items()}
            for b in batches:
                v = b.column("v")
                lengths, flat, ids = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(), b.column("vec_id").to_numpy()
                starts = np.cumsum(lengths) - lengths
                for d in np.unique(lengths):
                    if d in found:
                        at = np.nonzero(lengths == d)[0]
                        for a in range(0, len(at), BLOCK):
                            own = at[a : a + BLOCK]
                            found[d][1].add(ids[own], quantized(flat[starts[own][:, None] + np.arange(d)], d))
            for numbers, s in found.values():
                out = [(number, int(numbers[n]), int(s.ids[n]), who, score) for n, who, score in s.rows()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["wave", "q", "query_id", "vec_id", "score"])

        vectors.mapInArrow(scan, schema).write.mode("append").parquet(path)
        shared.destroy()

    for row in queries.toLocalIterator(prefetchPartitions=True):
        wave.append((row.vec_id, np.array(row.v)))
        held += 8 * len(row.v) + 64
        if held >= wave_bytes:
            run(wave, number)
            wave, held, number = [], 0, number + 1
    if wave:
        run(wave, number)
    rank = F.row_number().over(Window.partitionBy("wave", "q").orderBy(F.desc("score"), "vec_id"))
    return spark.read.schema(schema).parquet(path).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_segment_topk(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    vectors = usable(embeddings, "vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
