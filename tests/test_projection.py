"""Projections of cache items: sections, chunks, replacement, and removal."""

from pyspark.sql import functions as F

from shelfmark.operators import projection as P
from shelfmark.operators.integration import Graph
from shelfmark.plugins import HashingEmbedder, embed

CACHE = "id string, url string, title string, date string, text string, content_hash string, in_kg boolean, kg_chunk_ids array<string>, kg_projected_hash string, vectorized boolean, vector_projected_hash string"
LONG = "A sentence of some length that says little. " * 90


def library(spark, texts):
    cache = spark.createDataFrame([(f"c{i}", u, f"T{i}", "", t, f"h{len(t or '')}", False, [], "", False, "") for i, (u, t) in enumerate(texts)], CACHE)
    staging = spark.createDataFrame([], "id string, source_title string, source_url string, part int, tag string, text string")
    graph = Graph(spark.createDataFrame([("e", "entity", 3, "", "")], "id string, type string, layer int, title string, url string"), spark.createDataFrame([], "src string, dst string, kind string, label string"))
    return P.Library(cache, staging, graph, spark.createDataFrame([], "id string, url string, section_id string, position int, text string, embedding array<float>"))


def seen(lib):
    return [sorted(map(str, df.collect())) for df in (lib.cache, lib.staging, lib.held.nodes, lib.held.edges, lib.vectors)]


def projected(spark, lib, ids):
    chosen = spark.createDataFrame([(i,) for i in ids], "id string")
    lib = P.cache_to_graph(lib, chosen)
    return P.cache_to_vectors(lib, chosen, embed=lambda rows: embed(rows, "id", "embed_text", HashingEmbedder(8)))


def test_projection_replaces_what_was_there(spark):
    first = projected(spark, library(spark, [("http://a", LONG), ("", LONG + "end."), ("http://b", "short"), ("http://c", "    "), ("http://d", None)]), ["c0", "c1", "c2", "c3", "c4", "unknown"])
    cache = {r.id: r for r in first.cache.collect()}
    assert {i for i, r in cache.items() if r.in_kg} == {"c0", "c1", "c2"} and {i for i, r in cache.items() if r.vectorized} == {"c0", "c1"}
    assert cache["c0"].kg_projected_hash == cache["c0"].vector_projected_hash == cache["c0"].content_hash and cache["c3"].kg_projected_hash == ""
    staged = {r.id: r for r in first.staging.collect()}
    assert [staged[i].source_title for i in cache["c0"].kg_chunk_ids] == [f"T0 [{n}/{len(cache['c0'].kg_chunk_ids)}]" for n in range(1, len(cache["c0"].kg_chunk_ids) + 1)]
    assert staged[cache["c2"].kg_chunk_ids[0]].source_title == "T2" and {r.source_url for r in staged.values()} == {"http://a", "cache:c1", "http://b"}
    vectors = first.vectors.collect()
    assert {v.url for v in vectors} == {"http://a", "cache:c1"} and all(len(v.embedding) == 8 for v in vectors)
    edges = {(r.src, r.kind) for r in first.held.edges.collect()}
    assert {(v.id, k) for v in vectors for k in ("from_source", "in_section")} <= edges and {(v.section_id, "in_document") for v in vectors} <= edges
    again = projected(spark, first, ["c0", "c1", "c2"])
    assert seen(again) == seen(first)
    drifted = first._replace(cache=first.cache.withColumn("text", F.when(F.col("id") == "c0", F.substring("text", 1, 300)).otherwise(F.col("text"))).withColumn("content_hash", F.when(F.col("id") == "c0", "new").otherwise(F.col("content_hash"))))
    changed = projected(spark, drifted, ["c0"])
    assert changed.vectors.where("url = 'http://a'").count() == 1 and changed.vectors.where("url <> 'http://a'").count() == first.vectors.where("url <> 'http://a'").count()
    assert changed.cache.where("id = 'c0' and kg_projected_hash = 'new' and vector_projected_hash = 'new' and size(kg_chunk_ids) = 1").count() == 1
    left = P.delete_items(changed, spark.createDataFrame([("c0",), ("c2",)], "id string"))
    assert left.vectors.where("url = 'http://a'").count() == 0 and {r.source_url for r in left.staging.collect()} == {"cache:c1"} and left.cache.count() == 3
