"""Documents and cache items into sections, chunks, graph nodes and vectors, and out of them again.

Items are (id, url, title, date, text, content_hash); an item of fewer than ``LEAST`` characters has nothing to project. Every
projection is idempotent: ids follow from the address and the places of sections and chunks, and what an earlier projection
of the same item or address left is replaced. Rows are replaced by anti-joins on the keys of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import graph
from .chunking import OVERLAP, SECTION, SIZE, chunks_of
from .integration import Graph
from .stores import projection_url

LEAST, STAGED = 200, 1200
_PARTS = "url string, section int, section_text string, position int, text string"


class Projected(NamedTuple):
    sections: DataFrame
    chunks: DataFrame


def _split(items: DataFrame, section: int, size: int, overlap: int, breaks: bool) -> DataFrame:
    """(url, section, section_text, position, text): a row for each chunk; the section's text stands with its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for url, whole in zip(*(c.to_pylist() for c in batch.columns)):
                for s, own in enumerate(chunks_of(whole, section, 0)):
                    rows += [(url, s, own if not p else None, p, x) for p, x in enumerate(chunks_of(own, size, overlap, breaks))]
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 2000]), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()))], names=["url", "section", "section_text", "position", "text"])

    return items.select("url", "text").mapInArrow(run, _PARTS)


def sections_and_chunks(items: DataFrame, summary=lambda c: text.preview(c, 200), section: int = SECTION, size: int = SIZE, overlap: int = OVERLAP, breaks: bool = True) -> Projected:
    """Sections without overlap and their chunks with it, titled and with the texts to embed: each chunk's behind its document and
    its section's summary. ``summary``: a column from a section's text; a model's comes as a table joined by its caller. Without
    ``breaks`` a section is one paragraph: blank lines in it are where its parts were joined, as in documents that have none."""
    some = items.where(F.length("text") >= LEAST)
    doc = text.url_slug(F.col("url"))
    head = some.select("url", "title", F.coalesce("date", F.lit("")).alias("date"), doc.alias("doc_id"))
    parts = graph.cut(_split(some, section, size, overlap, breaks))
    sections = parts.where("position = 0").join(head, "url").select(
        F.format_string("section_%s_%d", "doc_id", "section").alias("id"), "doc_id", "url", "title", "date", F.col("section").alias("section_index"),
        F.concat("title", F.lit(" — part "), F.col("section") + 1).alias("section_title"), summary(F.col("section_text")).alias("summary"), F.col("section_text").alias("text"),
    )
    dated = F.concat("title", F.lit(" ("), F.coalesce(F.nullif("date", F.lit("")), F.lit("n/a")), F.lit(")"))
    sections = sections.withColumn("embed_text", F.concat(dated, F.lit(" — "), "section_title", F.lit(": "), "summary"))
    own = sections.select(F.col("url"), F.col("section_index").alias("section"), F.col("id").alias("section_id"), "doc_id", "title", "date", "section_title", F.col("summary").alias("contextual_summary"))
    chunks = parts.select("url", "section", "position", "text").join(own, ["url", "section"]).select(
        F.format_string("chunk_%s_%d_%d", "doc_id", "section", "position").alias("id"), "doc_id", "url", "title", "date", "section_id", "section_title", "contextual_summary", "text", text.preview(F.col("text"), 240, trimmed=False).alias("preview"), "position",
        F.concat(dated, F.lit("\nSection: "), "section_title", F.lit("\nContext: "), "contextual_summary", F.lit("\n\n"), "text").alias("embed_text"),
    )
    return Projected(sections, chunks)


def replaced(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """``old`` without the rows of the keys that ``new`` has, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def mirror(held: Graph, items: DataFrame, found: Projected) -> Graph:
    """The graph with each document as source, sections and chunks; what it had of these addresses goes, with its edges."""
    urls = items.join(found.sections.select("url").distinct(), "url", "left_semi").select("url", "title").distinct()
    gone = held.nodes.where("type in ('source', 'section', 'chunk')").join(urls.where("url <> ''").select("url"), "url", "left_semi").select("id")
    nodes, edges = graph.without(held.nodes, held.edges, graph.cut(gone))
    taken = nodes.where("type = 'source'").select("id", F.lit(True).alias("taken"))
    plain = F.concat(F.lit("source_"), text.slug(F.coalesce(F.nullif("url", F.lit("")), F.col("title"))))
    source = urls.withColumn("id", plain).join(taken, "id", "left")
    source = graph.cut(source.select(F.when(F.col("taken").isNull(), F.col("id")).otherwise(F.concat(F.lit("source_"), F.substring(F.sha2("url", 256), 1, 10))).alias("source_id"), "url", "title"))
    layer = lambda n: F.lit(n).alias("layer")
    of = lambda rows: rows.join(source.select("url", "source_id"), "url")
    new = source.select(F.col("source_id").alias("id"), F.lit("source").alias("type"), layer(0), F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("title"), "url")
    new = new.unionByName(found.sections.select("id", F.lit("section").alias("type"), layer(1), F.col("section_title").alias("title"), "url")).unionByName(found.chunks.select("id", F.lit("chunk").alias("type"), layer(2), "title", "url"))
    edge = lambda rows, to, kind: rows.select(F.col("id").alias("src"), F.col(to).alias("dst"), F.lit(kind).alias("kind"), F.lit(kind.replace("_", " ")).alias("label"))
    drawn = edge(of(found.sections), "source_id", "in_document").unionByName(edge(of(found.chunks), "source_id", "from_source")).unionByName(edge(found.chunks, "section_id", "in_section"))
    return Graph(nodes.unionByName(new, allowMissingColumns=True), edges.unionByName(drawn, allowMissingColumns=True))


def staged(items: DataFrame, size: int = STAGED, overlap: int = OVERLAP, least: int = 5) -> DataFrame:
    """(item_id, id, source_title, source_url, part, tag, text): an item's chunks for the staging table, numbered in its title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, len(own), x) for i, whole in zip(*(c.to_pylist() for c in batch.columns)) for own in (chunks_of(whole, size, overlap),) for n, x in enumerate(own, 1)]
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 2000]), (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["item_id", "n", "total", "text"])

    parts = items.where(F.length(text.strip(F.col("text"))) >= least).select("id", "text").mapInArrow(run, "item_id string, n int, total int, text string")
    head = items.select(F.col("id").alias("item_id"), "title", projection_url(F.col("url"), F.col("id")).alias("source_url"))
    some = parts.join(head, "item_id")
    number = lambda form: F.when(F.col("total") > 1, F.format_string(form, "n", "total"))
    return some.select(
        "item_id", F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws("|", "item_id", "n", "text"), 256), 1, 12)).alias("id"), F.concat("title", F.coalesce(number(" [%d/%d]"), F.lit(""))).alias("source_title"), "source_url", F.col("n").alias("part"), F.coalesce(number("part:%d/%d"), F.lit("")).alias("tag"), "text",
    )


class Library(NamedTuple):
    """The cache (id, ..., in_kg, kg_chunk_ids, kg_projected_hash, vectorized, vector_projected_hash), staged chunks, graph, vectors."""

    cache: DataFrame
    staging: DataFrame
    held: Graph
    vectors: DataFrame


def cache_to_graph(library: Library, chosen: DataFrame, **options) -> Library:
    """The chosen items (id) staged again: chunks of an earlier projection leave the staging table and the graph, flags and ids are set."""
    items = library.cache.join(chosen.select("id").distinct(), "id", "left_semi")
    new = graph.cut(staged(items, **options))
    done = new.groupBy(F.col("item_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", F.col("id").alias("c")))), lambda x: x["c"]).alias("__ids"))
    old = graph.cut(items.join(done.select("id"), "id", "left_semi").select(F.explode("kg_chunk_ids").alias("id")).distinct())
    nodes, edges = graph.without(library.held.nodes, library.held.edges, old)
    staging = library.staging.join(old, "id", "left_anti").unionByName(new.select(library.staging.columns))
    met = F.col("__ids").isNotNull()
    cache = library.cache.join(done, "id", "left").withColumns({"in_kg": met | F.col("in_kg"), "kg_projected_hash": F.when(met, F.col("content_hash")).otherwise(F.col("kg_projected_hash")), "kg_chunk_ids": F.coalesce("__ids", "kg_chunk_ids")}).select(library.cache.columns)
    return Library(cache, staging, Graph(nodes, edges), library.vectors)


def cache_to_vectors(library: Library, chosen: DataFrame, embed=None, **options) -> Library:
    """The chosen items as chunks to search, in place of those of their addresses, mirrored in the graph, with flags set. ``embed``: a
    function from (id, embed_text) to (id, embedding)."""
    items = library.cache.join(chosen.select("id").distinct(), "id", "left_semi").withColumn("url", projection_url(F.col("url"), F.col("id")))
    found = sections_and_chunks(items, **options)
    found = Projected(graph.cut(found.sections), graph.cut(found.chunks))
    rows = found.chunks.join(embed(found.chunks.select("id", "embed_text")), "id", "left") if embed else found.chunks
    done = found.chunks.select("url").distinct().withColumn("__done", F.lit(True))
    cache = library.cache.withColumn("__url", projection_url(F.col("url"), F.col("id"))).join(chosen.select("id", F.lit(True).alias("__asked")).distinct(), "id", "left").join(done.withColumnRenamed("url", "__url"), "__url", "left")
    met = F.coalesce(F.col("__done") & F.col("__asked"), F.lit(False))
    cache = cache.withColumns({"vectorized": met | F.col("vectorized"), "vector_projected_hash": F.when(met, F.col("content_hash")).otherwise(F.col("vector_projected_hash"))}).select(library.cache.columns)
    return Library(cache, library.staging, mirror(library.held, items, found), replaced(library.vectors, rows))


def delete_items(library: Library, gone: DataFrame) -> Library:
    """Without the cache items (id), the chunks that they became in staging table and graph, and the vectors of those that had some."""
    items = graph.cut(library.cache.join(gone.select("id").distinct(), "id", "left_semi").select("id", "kg_chunk_ids", "vectorized", projection_url(F.col("url"), F.col("id")).alias("url")))
    chunks = items.select(F.explode("kg_chunk_ids").alias("id")).distinct()
    nodes, edges = graph.without(library.held.nodes, library.held.edges, chunks)
    urls = items.where("vectorized").select("url").distinct()
    return Library(library.cache.join(items.select("id"), "id", "left_anti"), library.staging.join(chunks, "id", "left_anti"), Graph(nodes, edges), library.vectors.join(urls, "url", "left_anti"))
