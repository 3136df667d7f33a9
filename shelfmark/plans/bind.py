"""The library's tables, bound to the driver's: the same in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vector
from .scalars import DOT, SLUG, URL_SLUG  # noqa: F401

NOW = "TIMESTAMP '2024-02-01 00:00:00'"

#: cache items: documents by their text, pages by their url
CACHE_SQL = """cache AS (
SELECT 'cache_' || substr(sha256(sha256(text)), 1, 16) AS id, 'text' AS kind, '' AS source_url, source AS source_title, text AS raw_text, length(text)::BIGINT AS chars, sha256(text) AS content_hash,
       doc_id % 2 = 0 AS in_kg, doc_id % 3 = 0 AS vectorized, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(text) END AS kg_projected_hash, CASE WHEN doc_id % 9 = 0 THEN '' ELSE sha256(text) END AS vector_projected_hash, doc_id AS ord FROM documents
UNION ALL
SELECT 'cache_' || substr(sha256(url), 1, 16), 'url', url, substr(url, 1, 40), html, length(html)::BIGINT, sha256(html), page_id % 2 = 1, page_id % 2 = 0, sha256(html), 'old', 1000000000 + page_id FROM pages)"""


def cache_items(t) -> DataFrame:
    d = t.documents
    h = F.sha2("text", 256)
    docs = d.select(
        F.concat(F.lit("cache_"), F.substring(F.sha2(h, 256), 1, 16)).alias("id"), F.lit("text").alias("kind"), F.lit("").alias("source_url"), F.col("source").alias("source_title"),
        F.col("text").alias("raw_text"), F.length("text").cast("long").alias("chars"), h.alias("content_hash"), F.expr("doc_id % 2 = 0").alias("in_kg"), F.expr("doc_id % 3 = 0").alias("vectorized"),
        F.when(F.expr("doc_id % 4 = 0"), "old").otherwise(h).alias("kg_projected_hash"), F.when(F.expr("doc_id % 9 = 0"), "").otherwise(h).alias("vector_projected_hash"), F.col("doc_id").alias("ord"),
    )
    p = t.pages
    h = F.sha2("html", 256)
    pages = p.select(
        F.concat(F.lit("cache_"), F.substring(F.sha2("url", 256), 1, 16)).alias("id"), F.lit("url").alias("kind"), F.col("url").alias("source_url"), F.substring("url", 1, 40).alias("source_title"),
        F.col("html").alias("raw_text"), F.length("html").cast("long").alias("chars"), h.alias("content_hash"), F.expr("page_id % 2 = 1").alias("in_kg"), F.expr("page_id % 2 = 0").alias("vectorized"),
        h.alias("kg_projected_hash"), F.lit("old").alias("vector_projected_hash"), (F.lit(1_000_000_000) + F.col("page_id")).alias("ord"),
    )
    return docs.unionByName(pages)


#: chunks with vectors: url by number, section by label, text of the document of that number
CHUNK_SQL = """chunk AS (SELECT vec_id AS ord, 'chunk_' || vec_id AS id, 'u' || (vec_id % 50) AS url, 'section_' || label AS section_id, (vec_id // 50)::INT AS position, text, embedding FROM embeddings JOIN documents ON doc_id = vec_id)"""


def chunks(t) -> DataFrame:
    return t.embeddings.join(t.documents, F.col("doc_id") == F.col("vec_id")).select(
        F.col("vec_id").alias("ord"), F.concat(F.lit("chunk_"), "vec_id").alias("id"), F.concat(F.lit("u"), F.expr("vec_id % 50")).alias("url"),
        F.concat(F.lit("section_"), "label").alias("section_id"), F.expr("cast(vec_id div 50 as int)").alias("position"), "text", "embedding",
    )


#: sections: the vector of a label's first chunk, and the url of that chunk
SECTION_SQL = """section AS (SELECT section_id AS id, arg_min(url, ord) AS url, arg_min(embedding, ord) AS embedding, min(ord) AS ord, arg_min(substr(text, 1, 200), ord) AS overview FROM chunk GROUP BY section_id)"""


def sections(t) -> DataFrame:
    return chunks(t).groupBy(F.col("section_id").alias("id")).agg(
        F.min_by("url", "ord").alias("url"), F.min_by("embedding", "ord").alias("embedding"), F.min("ord").alias("ord"), F.min_by(F.substring("text", 1, 200), "ord").alias("overview")
    )


#: queries: the vectors whose number is divisible by 20, with the document's first words
QUERY_SQL = """q AS (SELECT ord AS query_id, embedding AS qv, array_to_string((string_split(lower(substr(text, 1, 200)), ' '))[1:5], ' ') AS qt FROM chunk WHERE ord % 20 = 0)"""


def questions(t) -> DataFrame:
    return chunks(t).where("ord % 20 = 0").select(F.col("ord").alias("query_id"), F.col("embedding").alias("qv"), F.array_join(F.slice(F.split(F.lower(F.substring("text", 1, 200)), " "), 1, 5), " ").alias("qt"))


#: memories: the turns of conversations
MEMORY_SQL = """memory AS (SELECT 'mem_' || conv_id || '_' || turn AS id, conv_id * 1000 + turn AS ord, CASE role WHEN 'assistant' THEN 'answer' WHEN 'user' THEN 'preference' ELSE 'observation' END AS kind, text,
(1 + conv_id % 5)::INT AS salience, CASE WHEN turn % 2 = 0 THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence, (turn % 4)::BIGINT AS use_count, CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN 'mem_' || conv_id || '_1' ELSE '' END AS superseded_by,
TIMESTAMP '2024-01-01 00:00:00' + to_hours((conv_id * 13 % 720)::INT) AS updated_at FROM conversations)"""


def memories(t) -> DataFrame:
    return t.conversations.select(
        F.concat_ws("_", F.lit("mem"), "conv_id", "turn").alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        F.when(F.col("role") == "assistant", "answer").when(F.col("role") == "user", "preference").otherwise("observation").alias("kind"), "text",
        F.expr("cast(1 + conv_id % 5 as int)").alias("salience"), F.when(F.expr("turn % 2 = 0"), "INFERRED").otherwise("EXTRACTED").alias("confidence"), F.expr("turn % 4").cast("long").alias("use_count"),
        F.when(F.expr("conv_id % 7 = 0 AND turn = 0"), F.concat(F.lit("mem_"), "conv_id", F.lit("_1"))).otherwise("").alias("superseded_by"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(conv_id * 13 % 720 as int), 0, 0)").alias("updated_at"),
    )


#: run log: events in order of their number
RUN_SQL = """run AS (SELECT event_id AS ord, event_type, CASE event_id % 4 WHEN 0 THEN 'build' WHEN 1 THEN 'refine' WHEN 2 THEN 'eval' ELSE 'use' END AS kind, 'skill_' || (user_id % 12) AS skill_id,
CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 < 3 THEN 'accept' WHEN event_id % 5 = 3 THEN 'review' ELSE 'reject' END AS gate, value * 10 AS duration_ms, json_extract_string(props, '$.k')::BIGINT AS tokens,
CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 100) / 100.0::DOUBLE END AS rubric_mean, ts AS "at" FROM events)"""


def runs(t) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("ord"), "event_type", F.element_at(F.array(*map(F.lit, ("build", "refine", "eval", "use"))), F.expr("cast(event_id % 4 + 1 as int)")).alias("kind"),
        F.concat(F.lit("skill_"), F.expr("user_id % 12")).alias("skill_id"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 < 3 THEN 'accept' WHEN event_id % 5 = 3 THEN 'review' ELSE 'reject' END").alias("gate"),
        (F.col("value") * 10).alias("duration_ms"), F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        F.expr("CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 100) / 100.0D END").alias("rubric_mean"), F.col("ts").cast("timestamp").alias("at"),
    )


#: graph: a source for each documents.source, a chunk for each document, an entity for each of its capital words
NODE_SQL = r"""ent AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(translate(text, 'àâäéèêëîïôöùûüçñíóúáßÀÂÄÉÈÊËÎÏÔÖÙÛÜÇÑÍÓÚÁ', repeat('_', 60)), '[A-Z][a-z]{5,}'))) AS name FROM documents),
node AS (SELECT 'source_' || source AS id, 'source' AS type, 0 AS layer, source AS name, min(doc_id) AS ord, count(*) AS mentions, '' AS preview FROM documents GROUP BY source
UNION ALL SELECT 'chunk_' || doc_id, 'chunk', 2, '', 100000000 + doc_id, 1, substr(text, 1, 80) FROM documents
UNION ALL SELECT 'entity_' || lower(name), 'entity', 3, name, 200000000 + min(doc_id), count(*), '' FROM ent GROUP BY name),
edge AS (SELECT 'chunk_' || doc_id AS src, 'source_' || source AS dst, 'from_source' AS kind FROM documents
UNION ALL SELECT 'chunk_' || doc_id, 'entity_' || lower(name), 'mentions' FROM ent)"""
_ACCENTS = "àâäéèêëîïôöùûüçñíóúáßÀÂÄÉÈÊËÎÏÔÖÙÛÜÇÑÍÓÚÁ"


def entities_of(t) -> DataFrame:
    plain = F.translate("text", _ACCENTS, "_" * len(_ACCENTS))
    names = F.array_distinct(F.regexp_extract_all(plain, F.lit("[A-Z][a-z]{5,}"), F.lit(0)))
    return t.documents.select("doc_id", "source", names.alias("names")).select("doc_id", "source", F.explode("names").alias("name"))


def nodes(t) -> DataFrame:
    d, e = t.documents, entities_of(t)
    sources = d.groupBy("source").agg(F.min("doc_id").alias("ord"), F.count("*").alias("mentions")).select(F.concat(F.lit("source_"), "source").alias("id"), F.lit("source").alias("type"), F.lit(0).alias("layer"), F.col("source").alias("name"), "ord", "mentions", F.lit("").alias("preview"))
    own = d.select(F.concat(F.lit("chunk_"), "doc_id").alias("id"), F.lit("chunk").alias("type"), F.lit(2).alias("layer"), F.lit("").alias("name"), (F.col("doc_id") + 100000000).alias("ord"), F.lit(1).cast("long").alias("mentions"), F.substring("text", 1, 80).alias("preview"))
    named = e.groupBy("name").agg((F.min("doc_id") + 200000000).alias("ord"), F.count("*").alias("mentions")).select(F.concat(F.lit("entity_"), F.lower("name")).alias("id"), F.lit("entity").alias("type"), F.lit(3).alias("layer"), "name", "ord", "mentions", F.lit("").alias("preview"))
    return sources.unionByName(own).unionByName(named)


def edges(t) -> DataFrame:
    chunk = F.concat(F.lit("chunk_"), "doc_id").alias("src")
    return t.documents.select(chunk, F.concat(F.lit("source_"), "source").alias("dst"), F.lit("from_source").alias("kind")).unionByName(
        entities_of(t).select(chunk, F.concat(F.lit("entity_"), F.lower("name")).alias("dst"), F.lit("mentions").alias("kind"))
    )
