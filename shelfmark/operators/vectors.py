"""Vectors of a whole table against a stated set of queries, and near-duplicate vectors.

Queries go to the tasks in waves of at most ``WAVE`` bytes of vectors, whose size is counted first; rows stay where they
are read, and a task keeps the k best of each query, so that what is shuffled is k rows for each query and task. Within a task
queries and rows meet in blocks of ``PRODUCTS`` pairs, so what it holds does not grow with their number. Each pair's
product is one sum in the same order, so equal vectors have equal products; where k are kept, products of matrices tell first
which pairs can be among them. Vectors that are null, hold a null or have
another length than the queries' have no similarity and are no row of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of query vectors (in double precision) that are sent to the tasks at once.
WAVE = 32 << 20
#: So many queries are fetched without being counted.
FEW = 2000
#: Products that a task holds at once, of a block of queries and a block of rows; rows of a result in one batch of Arrow.
PRODUCTS, BATCH = 1 << 20, 10_000
#: Bytes of the best places that a task holds for the queries of a wave.
HELD = 128 << 20


def matrix(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors in double precision) of a list column: those rows that have a whole vector of ``dim`` numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    dim = dim if dim is not None else int(sizes.max(initial=0))
    rows = np.flatnonzero((sizes == dim) & (dim > 0))
    flat = column.take(pa.array(rows)).flatten()
    m = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim) if len(rows) else np.zeros((0, dim))
    whole = ~np.isnan(m).any(axis=1)
    return rows[whole], np.ascontiguousarray(m[whole])


def waves(queries: DataFrame, most: int = WAVE) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of queries (query_id, qv), at most about ``most`` bytes at a time."""
    own = queries.select("query_id", "qv")
    first = own.limit(FEW + 1).toArrow()
    if first.num_rows <= FEW:  # one small batch: cut here where its vectors are long
        rows, m = matrix(first.column("qv"))
        ids, step = first.column("query_id").take(pa.array(rows)).to_pylist(), max(1, most // max(1, 8 * m.shape[1]))
        for at in range(0, len(rows), step):
            yield ids[at : at + step], m[at : at + step]
        return
    n, dim = own.agg(F.count("*"), F.max(F.size("qv"))).first()
    parts = max(1, -(-n * max(dim or 0, 1) * 8 // most))
    for part in range(parts):
        table = own.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
        rows, m = matrix(table.column("qv"), dim)
        if len(rows):
            yield table.column("query_id").take(pa.array(rows)).to_pylist(), m


def blocks(queries: int, rows: int) -> Iterator[tuple[slice, slice]]:
    """Blocks of queries and rows of at most ``PRODUCTS`` pairs, rows within queries."""
    width = max(1, min(rows, BATCH, PRODUCTS))
    step = max(1, PRODUCTS // width)
    for q in range(0, queries, step):
        for b in range(0, rows, width):
            yield slice(q, min(queries, q + step)), slice(b, min(rows, b + width))


class Best:
    """The k best places so far of each of some queries, as two matrices: similarities, and places in the rows that are held.

    Rows are kept once, whatever the number of queries that they are near to, and go when none has them any more; so what is
    held is k pairs of numbers for each query, and rows for as many of them as there are."""

    def __init__(self, queries: int, k: int, tie: str):
        self.k, self.tie, self.rows = k, tie, None
        self.sim, self.at = np.full((queries, 0), -np.inf), np.full((queries, 0), -1, np.int64)

    def add(self, own: np.ndarray, m: np.ndarray, rows: pa.Table) -> None:
        if not len(m):
            return
        if self.rows is not None and self.rows.num_rows > 2 * np.count_nonzero(self._used()) + 50_000:
            self._drop()
        begin = 0 if self.rows is None else self.rows.num_rows
        self.rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        tie = pc.rank(self.rows.column(self.tie).combine_chunks(), tiebreaker="dense").to_numpy()
        more = min(self.k - self.sim.shape[1], len(m))
        if more:
            self.sim, self.at = np.pad(self.sim, ((0, 0), (0, more)), constant_values=-np.inf), np.pad(self.at, ((0, 0), (0, more)), constant_values=-1)
        near = np.zeros(len(m), bool)
        size, largest = (np.sqrt(np.einsum("rd,rd->r", z, z)) for z in (own, m))
        for qs, bs in blocks(len(own), len(m)):
            sim, least = own[qs] @ m[bs].T, self.sim[qs].min(axis=1)
            # how far a product of matrices can be from the one sum that counts; without a bound all of them are summed
            off = 1e-15 * m.shape[1] * size[qs] * largest[bs].max()
            if not np.isfinite(off).all():
                sim, off = np.einsum("qd,bd->qb", own[qs], m[bs]), np.zeros(len(sim))
            rival = (sim >= (least - off)[:, None]).any(axis=1)
            if not rival.any():
                continue
            q = np.flatnonzero(rival) + qs.start
            sim, least = sim[rival], least[rival]
            if sim.shape[1] > self.k:  # what is below the k-th of the block can't be among the k best; equal ones all stay
                cut = np.partition(sim, -self.k, axis=1)[:, -self.k]
                x, y = np.nonzero(sim >= (np.fmax(cut - off[rival], least) - off[rival])[:, None])
            else:
                x, y = np.nonzero(sim >= (least - off[rival])[:, None])
            sim = np.concatenate([np.einsum("pd,pd->p", own[q[x[i : i + BATCH]]], m[bs][y[i : i + BATCH]]) for i in range(0, max(1, len(x)), BATCH)])
            fine = sim >= least[x]
            x, y, sim = x[fine], y[fine], sim[fine]
            held = self.at[q] >= 0
            of, place = np.nonzero(held)
            which = np.concatenate([of, x])
            sims, ats = np.concatenate([self.sim[q][held], sim]), np.concatenate([self.at[q][held], begin + bs.start + y])
            order = np.lexsort((tie[ats], -sims, which))
            which, sims, ats = which[order], sims[order], ats[order]
            rank = np.arange(len(which)) - np.searchsorted(which, which)
            fine = rank < self.k
            self.sim[q], self.at[q] = -np.inf, -1
            self.sim[q[which[fine]], rank[fine]], self.at[q[which[fine]], rank[fine]] = sims[fine], ats[fine]
            near[bs] = True
        if not near.any():
            self.rows = self.rows.slice(0, begin)

    def _used(self) -> np.ndarray:
        used = np.zeros(self.rows.num_rows, bool)
        used[self.at[self.at >= 0]] = True
        return used

    def _drop(self) -> None:
        used = self._used()
        to = np.cumsum(used) - 1
        self.at = np.where(self.at >= 0, to[self.at], -1)
        self.rows = self.rows.filter(pa.array(used)).combine_chunks()

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, places, similarities), at most ``BATCH`` at a time."""
        q, r = np.nonzero(self.at >= 0)
        for i in range(0, len(q), BATCH):
            x, y = q[i : i + BATCH], r[i : i + BATCH]
            yield x, self.at[x, y], self.sim[x, y]


def _scan(rows: DataFrame, queries: DataFrame, wave: tuple[list, np.ndarray], k: int | None, tie: str, vector: str) -> DataFrame:
    others = [c for c in rows.columns if c != vector]
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), *(rows.schema[c] for c in others), T.StructField("sim", T.DoubleType())]
    sent, id_kind = rows.sparkSession.sparkContext.broadcast(wave), to_arrow_type(fields[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = sent.value
        ids = np.array(ids, dtype=object)
        best = Best(len(own), k, tie) if k is not None else None

        def named(q: np.ndarray, found: pa.Table, at: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
            part = found.take(pa.array(at)).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array(ids[q].tolist(), id_kind), *part.columns, pa.array(sim)], names=["query_id", *others, "sim"])

        for batch in batches:
            at, m = matrix(batch.column(vector), own.shape[1])
            plain = pa.Table.from_batches([batch.select(others)]).take(pa.array(at))
            if best:
                best.add(own, m, plain)
                continue
            for qs, bs in blocks(len(own), len(m)):
                sim = np.einsum("qd,bd->qb", own[qs], m[bs])
                for i in range(0, sim.size, BATCH):
                    q, b = np.divmod(np.arange(i, min(sim.size, i + BATCH)), sim.shape[1])
                    yield named(q + qs.start, plain, b + bs.start, sim[q, b])
        if best and best.rows is not None:
            for q, at, sim in best.found():
                yield named(q, best.rows, at, sim)

    return rows.select(*others, vector).mapInArrow(run, T.StructType(fields))


def _over_waves(rows: DataFrame, queries: DataFrame, k: int | None, tie: str, vector: str) -> DataFrame:
    out = None
    for ids, own in waves(queries):
        step = max(1, HELD // (16 * k)) if k else len(ids)
        for at in range(0, len(ids), step):
            part = _scan(rows, queries, (ids[at : at + step], own[at : at + step]), k, tie, vector)
            out = part if out is None else out.unionByName(part)
    if out is None:  # no queries, no rows
        others = [c for c in rows.columns if c != vector]
        out = rows.where("false").select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *others, F.lit(None).cast("double").alias("sim"))
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int, tie: str = "ord", vector: str = "embedding", rank: str = "nn") -> DataFrame:
    """(query_id, the rows' other columns, sim, rank): the k rows of the largest inner product with each query (query_id, qv);
    of equal ones those of the smaller ``tie``, a column of which each row has another value."""
    found = _over_waves(rows, queries, k, tie, vector)
    return found.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), F.col(tie)))).where(F.col(rank) <= k)


def similarities(rows: DataFrame, queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """(query_id, the rows' other columns, sim) of every row and every query, written by the tasks that read the rows."""
    return _over_waves(rows, queries, None, "", vector)



#: Parts of a vector after which what is left bounds the rest of its product.
LEVELS = (0.25, 0.5)


def within(rows: DataFrame, queries: DataFrame, least: float, vector: str = "embedding", compared=None) -> DataFrame:
    """(query_id, the rows' other columns, sim): the pairs of a row and a query (query_id, qv) whose cosine reaches ``least``.

    Exact: after a quarter and after half of the dimensions a pair is dropped if the product so far and the lengths of what is
    left (by Cauchy and Schwarz no product is larger than theirs) cannot reach it; only survivors get the whole product,
    rounded to nine places. ``compared``, an accumulator, counts these. Zero vectors are like nothing.
    """
    others = [c for c in rows.columns if c != vector]
    fields = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *(rows.schema[c] for c in others), T.StructField("sim", T.DoubleType())])

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.einsum("bd,bd->b", m, m))[:, None]
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def scan(wave: tuple[list, np.ndarray]) -> DataFrame:
        ids, own = wave
        sent, id_kind = rows.sparkSession.sparkContext.broadcast((ids, unit(own))), to_arrow_type(fields[0].dataType)

        def whole(ids, own, m, q, b, later, batch, at) -> Iterator[pa.RecordBatch]:
            """Of some pairs those that are alike."""
            for c, after, left in later:
                fine = np.einsum("pd,pd->p", own[q, :c], m[b, :c]) + after[q] * left[b] >= least - 1e-6
                q, b = q[fine], b[fine]
            if compared is not None:
                compared.add(len(q))
            sim = np.round(np.einsum("pd,pd->p", own[q], m[b]), 9)
            q, b, sim = (x[sim >= least] for x in (q, b, sim))
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], id_kind), *(batch.column(c).take(pa.array(at[b])) for c in others), pa.array(sim)], names=["query_id", *others, "sim"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, own = sent.value
            cuts = [max(1, int(own.shape[1] * x)) for x in LEVELS]
            rest = [np.sqrt(np.maximum(0.0, 1 - (own[:, :c] ** 2).sum(axis=1))) for c in cuts]
            for batch in batches:
                at, m = matrix(batch.column(vector), own.shape[1])
                m = unit(m)
                left = [np.sqrt(np.maximum(0.0, 1 - (m[:, :c] ** 2).sum(axis=1))) for c in cuts]
                for qs, bs in blocks(len(own), len(m)):
                    so_far = own[qs, : cuts[0]] @ m[bs, : cuts[0]].T
                    q, b = np.nonzero(so_far + rest[0][qs, None] * left[0][bs] >= least - 1e-6)
                    q, b = q + qs.start, b + bs.start
                    for i in range(0, len(q), BATCH):
                        yield from whole(ids, own, m, q[i : i + BATCH], b[i : i + BATCH], list(zip(cuts, rest, left))[1:], batch, at)

        return rows.select(*others, vector).mapInArrow(run, fields)

    out = None
    for wave in waves(queries):
        out = scan(wave) if out is None else out.unionByName(scan(wave))
    return out if out is not None else rows.where("false").select(F.lit(None).cast(fields[0].dataType).alias("query_id"), *others, F.lit(None).cast("double").alias("sim"))
