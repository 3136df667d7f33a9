"""Approximate nearest vectors: navigable neighbour graphs in layers, one for each cell of the vectors, stored as a table.

Cells are around centres that are fitted to a sample of at most ``SAMPLE`` vectors; every vector is indexed, in the cell of its
nearest centre, and cells of more than ``most`` vectors are cut by hash, so a graph, and what a task holds, is bounded. In a
graph every layer has about a sixteenth of the one below. A vector's links are chosen from its ``BUILD`` nearest ones of the
layer: one that is nearer to a link that was chosen before than to the vector itself is passed over, so links point in
different directions; the link back is kept too, and parts that nothing leads to are joined to their nearest outside. A
search descends from the top layer and then keeps the ``ef`` best as it follows links; a query looks into the graphs of its
``probes`` nearest cells, where these are read, and what is shuffled is k rows for each query and graph.

Recall depends on the data and on ``probes``: measured against the exact search, see README. Vectors must be of length one
(inner products rank as cosines); null vectors, and those that hold a null, are not indexed. Equal vectors are one node with all their rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import vectors

#: links of a node (twice as many in the lowest layer), candidates when building, best kept when searching
M, BUILD, EF = 16, 200, 64
MOST, SAMPLE = 20_000, 50_000
GRAPH = "cell int, part int, dim int, n int, rows int, ords array<long>, starts array<int>, vectors binary, layers array<struct<members:binary,links:binary>>"


def _spread(near: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """For each node up to ``most`` of its candidates, nearest first, that lie in different directions; then the nearest others."""
    out = np.full((len(near), most), -1, np.int32)
    for i, own in enumerate(near):
        own = own[own != i]
        sims = v[own] @ v[i]
        among = v[own] @ v[own].T
        chosen: list[int] = []
        for j in range(len(own)):
            if len(chosen) == most:
                break
            if not chosen or among[j, chosen].max() < sims[j]:
                chosen.append(j)
        for j in range(len(own)):
            if len(chosen) >= most // 2:
                break
            if j not in chosen:
                chosen.append(j)
        out[i, : len(chosen)] = own[chosen]
    return out


def _both_ways(links: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Links and the links back, the nearest ``most`` of each node; parts apart are joined where they are nearest."""
    n = len(links)
    a, b = np.nonzero(links >= 0)
    b = links[a, b]
    pairs = np.unique(np.r_[np.c_[a, b], np.c_[b, a]], axis=0) if len(a) else np.zeros((0, 2), int)
    sims = np.einsum("pd,pd->p", v[pairs[:, 0]], v[pairs[:, 1]])
    order = np.lexsort((-sims, pairs[:, 0]))
    pairs = pairs[order]
    place = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
    pairs, place = pairs[place < most], place[place < most]
    out = np.full((n, most + 4), -1, np.int32)
    out[pairs[:, 0], place] = pairs[:, 1]
    while True:
        seen = np.zeros(n, bool)
        edge = np.array([0])
        seen[0] = True
        while len(edge):
            edge = np.unique(out[edge][out[edge] >= 0])
            edge = edge[~seen[edge]]
            seen[edge] = True
        apart = np.flatnonzero(~seen)
        if not len(apart):
            return out
        free = np.flatnonzero(seen & (out[:, -1] < 0))
        if not len(free):
            free = np.flatnonzero(seen)
        near = v[free] @ v[apart[0]]
        from_ = free[near.argmax()]
        slot = np.flatnonzero(out[from_] < 0)
        out[from_, slot[0] if len(slot) else -1] = apart[0]


def build(v: np.ndarray, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers (members, links between members by their place in the layer) of a graph over vectors, the lowest first."""
    members, layers, r = np.arange(len(v), dtype=np.int32), [], np.random.default_rng(seed)
    while True:
        own, most = v[members], M * (1 if layers else 2)
        near = np.empty((len(own), min(len(own), BUILD + 1)), np.int64)
        for at in range(0, len(own), 1000):
            sims = own[at : at + 1000] @ own.T
            some = np.argpartition(-sims, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
            near[at : at + 1000] = np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, 1), axis=1, kind="stable"), 1)
        layers.append((members, _both_ways(_spread(near, own, M), own, most)))
        if len(members) <= M:
            return layers
        members = np.sort(r.choice(members, max(1, len(members) // M), replace=False)).astype(np.int32)


def search(v: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, k: int, ef: int = EF) -> list[tuple[float, int]]:
    """(similarity, row) of about the k nearest, best first; works on the rows that links lead to."""
    at = 0
    for depth in range(len(layers) - 1, -1, -1):
        members, links = layers[depth]
        width = max(ef, k) if depth == 0 else 1
        place = int(np.searchsorted(members, at)) if depth < len(layers) - 1 else 0
        best = [(float(v[members[place]] @ q), place)]
        todo, seen = [(-best[0][0], place)], {place}
        while todo:
            far, place = heapq.heappop(todo)
            if len(best) >= width and -far < best[0][0]:
                break
            new = [x for x in links[place].tolist() if x >= 0 and x not in seen]
            seen.update(new)
            for sim, x in zip((v[members[new]] @ q).tolist() if new else (), new):
                if len(best) < width or sim > best[0][0]:
                    heapq.heappush(todo, (-sim, x))
                    heapq.heappush(best, (sim, x))
                    if len(best) > width:
                        heapq.heappop(best)
        at = int(members[max(best)[1]])
    return sorted(((s, int(layers[0][0][x])) for s, x in best), key=lambda z: (-z[0], z[1]))[:k]


def distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different vectors, the rows in their order, where each one's rows begin, and the end): copies would be a plain of equal
    similarity, from which no link leads on."""
    own, of = np.unique(v, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    return own, order, np.searchsorted(of[order], np.arange(len(own) + 1)).astype(np.int32)


class NeighbourIndex:
    """The stored graphs below a folder, and the centres of their cells."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame, most: int = MOST, cells: int | None = None) -> NeighbourIndex:
        """From rows (ord, embedding). The centres are rows of a sample of at most ``SAMPLE``, moved to the means of what is
        nearest to them a few times; everything else is over all rows."""
        n = rows.count()
        cells = cells or max(1, -(-n // most))
        share = min(1.0, 0.9 * SAMPLE / max(n, 1))
        sample = vectors.matrix((rows.sample(share, seed=7) if share < 1 else rows).select("embedding").limit(SAMPLE).toArrow().column(0))[1]
        centres = _centres(sample, cells)
        sent = self.spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, m = vectors.matrix(batch.column(1), sent.value.shape[1])
                cell = (m @ sent.value.T).argmax(axis=1).astype(np.int32) if len(at) else np.zeros(0, np.int32)
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(cell)], names=["ord", "embedding", "cell"])

        placed = rows.select("ord", F.col("embedding").cast("array<float>")).mapInArrow(place, "ord long, embedding array<float>, cell int")
        placed.write.mode("overwrite").parquet(f"{self.path}/placed")
        placed = self.spark.read.parquet(f"{self.path}/placed")
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
        dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int"))

        def graph(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ord", kind="stable")
            v, order, starts = distinct(np.stack(pdf["embedding"].to_numpy()).astype(np.float32))
            layers = [{"members": m.tobytes(), "links": links.tobytes()} for m, links in build(v)]
            return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "part": [pdf["part"].iloc[0]], "dim": [v.shape[1]], "n": [len(v)], "rows": [len(pdf)], "ords": [pdf["ord"].to_numpy()[order]], "starts": [starts], "vectors": [v.tobytes()], "layers": [layers]})

        dealt.select("cell", "part", "ord", "embedding").groupBy("cell", "part").applyInPandas(graph, GRAPH).write.mode("overwrite").parquet(f"{self.path}/graphs")
        self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{self.path}/centres")
        return self

    def search(self, queries: DataFrame, k: int, probes: int | None = None, ef: int = EF) -> DataFrame:
        """(query_id, rank, ord, sim): about the k nearest rows of each query (query_id, qv), from its ``probes`` nearest cells (all
        of them by default)."""
        table = self.spark.read.parquet(f"{self.path}/centres").toArrow()
        cells, centres = table.column("cell").to_numpy(), vectors.matrix(table.column("centre"))[1]
        graphs, out = self.spark.read.schema(GRAPH).parquet(f"{self.path}/graphs"), None
        id_kind = to_arrow_type(queries.schema["query_id"].dataType)
        kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, ord long, sim double"
        for ids, qv in vectors.waves(queries):
            wanted = cells[np.argsort(-(qv @ centres.T), axis=1, kind="stable")[:, : probes or len(cells)]]
            sent = self.spark.sparkContext.broadcast((ids, qv.astype(np.float32), wanted))

            def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, qv, wanted = sent.value
                for batch in batches:
                    for g in batch.to_pylist():
                        v = np.frombuffer(g["vectors"], np.float32).reshape(g["n"], g["dim"])
                        layers = [(m, np.frombuffer(x["links"], np.int32).reshape(len(m), -1)) for x in g["layers"] for m in (np.frombuffer(x["members"], np.int32),)]
                        own = np.flatnonzero((wanted == g["cell"]).any(axis=1))
                        found = [(ids[i], x, sim) for i in own for sim, row in search(v, layers, qv[i], k, ef) for x in g["ords"][g["starts"][row] : min(g["starts"][row + 1], g["starts"][row] + k)]]
                        if found:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (id_kind, pa.int64(), pa.float64()))], names=["query_id", "ord", "sim"])

            part = graphs.mapInArrow(look, kind)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], kind)
        by = Window.partitionBy("query_id").orderBy(F.desc("sim"), "ord")
        return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "ord", F.round("sim", 4).alias("sim"))


def _centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of about equally dense parts of a sample."""
    if not len(sample):
        return np.ones((1, 1))
    r = np.random.default_rng(seed)
    centres = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of the exact rows (query_id, ord) that were found."""
    hit = exact.select("query_id", "ord").join(found.select("query_id", "ord", F.lit(1).alias("hit")), ["query_id", "ord"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
