"""Vectors and words against brute force: waves, pruned pairs, stored neighbour graphs, stored postings."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import lexical, neighbours, retrieval, stores, vectors

rng = np.random.default_rng(3)


def unit(m):
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


POINTS = unit(np.r_[rng.normal(size=(300, 16)), rng.normal(size=(4, 16)).repeat(30, axis=0) + 0.05 * rng.normal(size=(120, 16))])
POINTS[7] = POINTS[3]


@pytest.fixture(scope="module")
def rows(spark):
    some = [(i, f"n{i}", [float(x) for x in v]) for i, v in enumerate(POINTS)] + [(900, "null", None), (901, "hole", [None] + [0.0] * 15), (902, "short", [1.0])]
    return spark.createDataFrame(some, "ord long, id string, embedding array<float>").repartition(5)


@pytest.fixture(scope="module")
def queries(rows):
    return rows.where("ord % 10 = 3").select(F.col("ord").alias("query_id"), F.col("embedding").alias("qv"))


def exact(k):
    out = {}
    for q in range(3, len(POINTS), 10):
        sims = POINTS.astype(float) @ POINTS[q].astype(float)
        out[q] = [int(i) for i in np.lexsort((np.arange(len(sims)), -np.round(sims, 12)))[:k]]
    return out


def test_nearest_over_waves(rows, queries, monkeypatch):
    for few, wave in ((2000, 32 << 20), (2000, 600), (1, 900)):  # one batch, slices of one, parts by hash
        monkeypatch.setattr(vectors, "FEW", few)
        monkeypatch.setattr(vectors, "WAVE", wave)
        monkeypatch.setattr(vectors.waves, "__defaults__", (wave,))
        got = {}
        for r in vectors.nearest(rows, queries, 4).orderBy("query_id", "nn").collect():
            got.setdefault(r.query_id, []).append(r.ord)
        assert got == exact(4)
    assert "Exchange" not in vectors.similarities(rows.repartition(3), queries)._jdf.queryExecution().optimizedPlan().toString()
    assert vectors.similarities(rows, queries).count() == len(POINTS) * len(exact(1))
    assert vectors.nearest(rows, queries.where("false"), 3).collect() == [] == vectors.within(rows, queries.where("false"), 0.9).collect()


def test_like_vectors_with_few_whole_products(spark, rows, queries):
    counted = spark.sparkContext.accumulator(0)
    got = {(r.query_id, r.ord) for r in vectors.within(rows, queries, 0.92, compared=counted).collect()}
    norm = np.linalg.norm(POINTS.astype(float), axis=1)
    cos = np.round(POINTS.astype(float) @ POINTS.astype(float).T / np.outer(norm, norm), 9)
    assert got == {(q, i) for q in exact(1) for i in range(len(POINTS)) if cos[q, i] >= 0.92} and len(got) > 300
    assert len(got) <= counted.value < 0.25 * len(POINTS) * len(exact(1))


def test_near_memories_by_vector(spark, rows):
    store = rows.select(F.col("id"), "ord", "embedding", F.lit("").alias("superseded_by"))
    new = rows.where("ord < 5").select(F.concat(F.lit("new"), "ord").alias("id"), "embedding")
    assert {("new3", "n7"), ("new3", "n3"), ("new0", "n0")} <= {(r.new_id, r.id) for r in stores.near_by_vector(new, store).collect()}


@pytest.mark.parametrize(("most", "probes", "least"), [(1000, None, 0.99), (60, None, 0.97), (60, 5, 0.6)])
def test_neighbour_graphs_find_the_nearest(spark, rows, queries, tmp_path, most, probes, least):
    index = neighbours.NeighbourIndex(spark, str(tmp_path / "index")).build(rows, most)
    graphs = spark.read.parquet(str(tmp_path / "index/graphs"))
    assert graphs.agg(F.sum("rows")).first()[0] == len(POINTS) and graphs.agg(F.max("rows")).first()[0] <= 1.5 * most
    got = index.search(queries, 10, probes)
    want = spark.createDataFrame([(q, i) for q, own in exact(10).items() for i in own], "query_id long, ord long")
    assert neighbours.recall(got, want).first()[0] >= least
    assert got.groupBy("query_id").count().where("count <> 10").count() == 0 or probes


def test_graphs_of_equal_vectors_are_one_piece():
    v = unit(np.r_[np.ones((300, 4)), -np.ones((40, 4)), rng.normal(size=(5, 4))])
    own, order, starts = neighbours.distinct(v)
    layers = neighbours.build(own)
    best = neighbours.search(own, layers, v[310], 1)[0][1]
    assert order[starts[best] : starts[best + 1]].tolist() == list(range(300, 340)) and sorted(order) == list(range(len(v)))
    assert neighbours.search(v[:1], neighbours.build(v[:1]), v[0], 3) == [(pytest.approx(1.0), 0)]


def test_stored_postings(spark, tmp_path):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(60)], k=r.randint(0, 40))) for i in range(300)}
    chunks = spark.createDataFrame(list(texts.items()), "ord long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w3 w40 w40"), (2, "W59 nothing"), (3, ""), (4, "w0 w1 w2"), (5, "absent")], "query_id long, qt string")
    index = lexical.Index(spark, str(tmp_path / "segments"), 16)
    for name, some in (("a", "ord < 100"), ("b", "ord >= 100 and ord < 200"), ("c", "ord >= 200"), ("c", "ord >= 200")):  # again: in its place
        index.add(chunks.where(some), name)
    n, lengths = len(texts), {i: len(t.split()) for i, t in texts.items()}
    avgdl = sum(lengths.values()) / n
    df = Counter(w for t in texts.values() for w in set(t.split()))

    def best(q):
        terms = {w for w in q.lower().split()}
        score = {i: round(sum(max(0.0, math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)) * (f := t.split().count(w)) * 2.5 / (f + 1.5 * (0.25 + 0.75 * lengths[i] / avgdl)) for w in terms if w in t.split()), 6) for i, t in texts.items()}
        return sorted(((i, s) for i, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:7]

    want = [(q.query_id, i, s) for q in asked.collect() for i, s in best(q.qt)]
    merged = index.merge(["a", "b", "c"], "whole")
    got = [(r.query_id, r.ord, r.bm25) for r in merged.search(asked, 7).orderBy("query_id", "rank").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert {r.term: r.df for r in merged.frequencies().collect()} == dict(df)
    opened, every = merged.opened(asked, 2)
    assert opened < every
    plan = merged.search(asked, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan
    direct = retrieval.bm25(chunks, asked, 7).select("query_id", "ord").collect()
    assert sorted(direct) == sorted((q, i) for q, i, _ in want)


def test_what_a_task_holds_does_not_grow_with_the_queries(rows, queries, monkeypatch):
    """The functions that the tasks run, here: many queries against one batch, whose products would be 320 MB."""
    import tracemalloc

    import pyarrow as pa

    n = 10_000
    points = rng.normal(size=(n, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([f"n{i}" for i in range(4000)]), pa.array(list(points[:4000]), pa.list_(pa.float64()))], names=["ord", "id", "embedding"])
    monkeypatch.setattr(vectors, "waves", lambda *_, **__: [(list(range(n)), points)])
    run = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: run.append(f) or self.selectExpr("0L as query_id", "ord", "id", "0d as sim"))
    vectors.nearest(rows, queries, 5)
    vectors.similarities(rows, queries)
    vectors.within(rows, queries, 0.999)
    for f, all_ in zip(run, (5 * n, 4000 * n, 4000)):
        tracemalloc.start()
        found, deepest = 0, 400 if all_ == 4000 * n else 1 << 30  # of all pairs the first batches are enough
        for out, _ in zip(f(iter([batch])), range(deepest)):
            found += out.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 << 20, peak >> 20
        assert found >= min(all_, deepest * 1000)


def test_scores_of_words_in_waves(spark, monkeypatch):
    """All chunks that share a word with a query, without shuffling or ordering the pairs."""
    words = [[random.Random(i).choice("abcdefgh") for _ in range(3 + i % 9)] for i in range(60)]
    chunks = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)] + [(90, None), (91, "")], "ord long, text string")
    asked = {f"q{i}": " ".join(dict.fromkeys(words[i][:3])) for i in range(0, 60, 7)} | {"none": "zz", "empty": None}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, qt string")
    n, mean = 62, sum(map(len, words)) / 62
    df = Counter(w for x in words for w in set(x))
    want = {}
    for q, qt in asked.items():
        for i, x in enumerate(words):
            own = [math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for t in (qt or "").split() if t in x]
            if own:
                want[q, i] = sum(own)
    for most in (2_000_000, 5):
        monkeypatch.setattr(retrieval, "WAVE", most)
        monkeypatch.setattr(retrieval, "BATCH", 50)
        found = retrieval.bm25_unranked(chunks, queries, 62)
        got = {(r.query_id, r.ord): r.bm25 for r in found.collect()}
        assert got == pytest.approx(want, abs=2e-6)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" not in plan and "Window" not in plan
    few = retrieval.bm25_unranked(chunks, queries, 4).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in few} == {q: min(4, sum(1 for x, _ in want if x == q)) for q, _ in want}
    assert retrieval.matches(chunks, queries.where("false")).collect() == []


@pytest.mark.parametrize("places", [2_000_000, 40])
def test_tasks_keep_the_best_scores_of_words(spark, monkeypatch, places):
    """Ranks as of all scores, with many ties; of the pairs no more than m a query leave a task."""
    r = random.Random(9)
    texts = [" ".join(r.choices("abcdef", k=r.choice((3, 3, 5, 8)))) for _ in range(300)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(texts[i].split()[:3])) for i in range(0, 300, 20)], "query_id long, qt string")
    want = {}
    for x in retrieval.matches(chunks, queries).collect():
        want.setdefault(x.query_id, []).append((-x.bm25, x.ord))
    monkeypatch.setattr(retrieval, "PLACES", places)
    monkeypatch.setattr(retrieval, "BATCH", 50)
    got = {}
    for x in retrieval.bm25(chunks, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((-x.bm25, x.ord))
    assert got == {q: sorted(x)[:4] for q, x in want.items()}
    assert max(map(len, want.values())) > 100
    assert retrieval.matches(chunks, queries, 4).count() <= 4 * len(want) * 4 < sum(map(len, want.values()))


def test_millionths_as_spark_rounds(spark):
    x = np.array([0.1234565, 0.1234564999, 1.0000005, 2.5e-7, 5e-7, 4.9999999e-7, 12.3456785, 1.0050005, 7.0000015, *(k + 0.0000005 for k in range(40))])
    got = retrieval.rounded(x) / 1e6
    want = [r.y for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").selectExpr("i", "round(x, 6) as y").orderBy("i").collect()]
    assert got.tolist() == pytest.approx(want, abs=1e-9)


def test_search_of_postings_shuffles_no_pairs(spark, tmp_path, monkeypatch):
    """Every text has a word of each question: no row for a question and a chunk is shuffled but the best of a task."""
    r = random.Random(6)
    texts = ["all " + " ".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(240)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    queries = spark.createDataFrame([(i, " ".join(["all", *r.sample("abcdefgh", 3)])) for i in range(30)], "query_id long, qt string")
    index = lexical.Index(spark, str(tmp_path / "one"), 16)
    index.add(chunks, "all")
    want = {(x.query_id, x.rank): (x.ord, x.bm25) for x in retrieval.bm25(chunks, queries, 5).collect()}
    for places, cells in ((2_000_000, 1 << 20), (40, 30)):
        monkeypatch.setattr(retrieval, "PLACES", places)
        monkeypatch.setattr(lexical, "CELLS", cells)
        found = index.search(queries, 5)
        got = {(x.query_id, x.rank): (x.ord, x.bm25) for x in found.collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert [got[k][1] for k in want] == pytest.approx([v[1] for v in want.values()], abs=1.1e-6)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "inline" not in plan and "Aggregate [query_id" not in plan
    assert index.search(queries.where("false"), 5).collect() == []


def test_best_by_products_of_matrices():
    """The places and products of one sum each, ties, copies and infinite numbers among them, and few of all pairs summed."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    points, own = r.integers(-3, 4, (700, 8)).astype(float) / 3, r.integers(-3, 4, (90, 8)).astype(float) / 3
    wild = points.copy()
    wild[[5, 300], [1, 2]] = np.inf, 1e200
    for m in (points, wild):
        for k in (1, 7, 900):
            best = vectors.Best(len(own), k, "ord")
            for at in range(0, len(m), 250):
                best.add(own, m[at : at + 250], pa.table({"ord": np.arange(at, min(at + 250, len(m)))}))
            got = {}
            ords = best.rows.column("ord").to_numpy()
            for q, at, sim in best.found():
                for a, b, c in zip(q.tolist(), at.tolist(), sim.tolist()):
                    got.setdefault(a, []).append((-c, int(ords[b])))
            with np.errstate(invalid="ignore"):
                sims = np.einsum("qd,bd->qb", own, m)
            for q in range(len(own)):
                assert sorted(got[q]) == sorted((-s, i) for i, s in enumerate(sims[q].tolist()) if s == s)[:k]


def test_searches_that_share_their_candidates(spark):
    """Modes of the router from rows that were found once are as from their own searches."""
    r = np.random.default_rng(5)
    words = [" ".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(400)]
    chunks = spark.createDataFrame([(i, f"c{i}", f"u{i % 9}", f"s{i % 5}", w, [float(x) for x in v]) for i, (w, v) in enumerate(zip(words, r.normal(size=(400, 4))))], "ord long, id string, url string, section_id string, text string, embedding array<float>")
    sections = chunks.where("ord < 5").selectExpr("section_id as id", "embedding")
    queries = chunks.where("ord % 100 = 7").selectExpr("ord as query_id", "embedding as qv", "text as qt")
    near, found = retrieval.dense(chunks, queries, 864), retrieval.bm25(chunks, queries, 144)
    for options in ({"hybrid_": False}, {}):
        plain, shared = (sorted(map(tuple, retrieval.retrieve(chunks, sections, queries, 6, **options, **more).collect())) for more in ({}, {"near": near, "words": found}))
        assert plain == shared and len(plain) == 24
