"""Queries of curation: customers as entities, regions as topics; nations, orders and parts as what is done to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as U
from ..operators.integration import Graph
from . import bind
from .registry import query
from .scalars import SLUG

_HELD_SQL = f"""entity AS (SELECT 'entity_' || {SLUG("'Cust ' || c_custkey")} AS id, 'Cust ' || c_custkey AS name, lower(c_mktsegment) AS kind, ['C' || c_custkey] AS aliases, (c_custkey % 5 + 1)::INT AS importance, (c_custkey * 7 % 23)::BIGINT AS mentions, 'topic_' || (c_custkey % 7) AS topic_id, c_custkey AS ord FROM customer),
topic AS (SELECT 'topic_' || r_regionkey AS id, r_name AS name, 'old ' || r_name AS summary, r_regionkey - 10 AS ord FROM region)"""


def held(t) -> Graph:
    name = F.concat(F.lit("Cust "), "c_custkey")
    nodes = t.customer.select(
        F.concat(F.lit("entity_"), U.text.slug(name)).alias("id"), F.lit("entity").alias("type"), F.lit(3).alias("layer"), name.alias("name"), F.lower("c_mktsegment").alias("kind"), F.array(F.concat(F.lit("C"), "c_custkey")).alias("aliases"), F.expr("cast(c_custkey % 5 + 1 as int)").alias("importance"),
        F.expr("c_custkey * 7 % 23").cast("long").alias("mentions"), F.concat(F.lit("topic_"), F.expr("c_custkey % 7")).alias("topic_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("abstract"), F.col("c_custkey").cast("long").alias("ord"),
    )
    topics = t.region.select(F.concat(F.lit("topic_"), "r_regionkey").alias("id"), F.lit("topic").alias("type"), F.lit(4).alias("layer"), F.col("r_name").alias("name"), F.concat(F.lit("old "), "r_name").alias("summary"), (F.col("r_regionkey") - 10).cast("long").alias("ord"))
    edges = t.region.where("r_regionkey = 1").select(F.lit("topic_x").alias("src"), F.lit("topic_1").alias("dst"), F.lit("subtopic_of").alias("kind"), F.lit("subtopic of").alias("label"), F.lit("EXTRACTED").alias("confidence"))
    return Graph(nodes.unionByName(topics, allowMissingColumns=True), edges)


_LISTED = "SELECT id, name, kind, importance, mentions, topic_id FROM entity WHERE {} ORDER BY importance DESC, mentions DESC, ord LIMIT 100"
query("flt09", f"WITH {_HELD_SQL} {_LISTED.format("kind = 'building' AND topic_id = (SELECT id FROM topic WHERE lower(name) = 'asia')")}")(lambda t: U.list_entities(held(t).nodes, "Asia", "building"))
query("flt09_unknown", f"WITH {_HELD_SQL} {_LISTED.format("kind = 'building'")}")(lambda t: U.list_entities(held(t).nodes, "No such topic", "building"))

# each nation twice: under its region or the nation before it, then in lower case with another parent and a summary
_SPEC_SQL = f"""spec AS (SELECT n_name AS name, '' AS summary, CASE WHEN n_nationkey % 3 = 0 THEN (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) WHEN n_nationkey % 3 = 1 THEN (SELECT lower(p.n_name) FROM nation p WHERE p.n_nationkey = n.n_nationkey - 1) ELSE 'nowhere' END AS parent, n_nationkey AS ord FROM nation n
UNION ALL SELECT lower(n_name), CASE WHEN n_nationkey % 2 = 0 THEN 'about ' || n_name ELSE '' END, CASE WHEN n_nationkey % 4 = 0 THEN 'topic_' || n_regionkey WHEN n_nationkey % 4 = 1 THEN n_name ELSE NULL END, 100 + n_nationkey FROM nation),
made AS (SELECT 'topic_' || {SLUG('arg_min(name, ord)')} AS id, arg_min(name, ord) AS name, min(ord) AS made FROM spec GROUP BY lower(name)),
key AS (SELECT id AS key, id, NULL AS made FROM topic UNION SELECT lower(name), id, NULL FROM topic UNION SELECT id, id, made FROM made UNION SELECT lower(name), id, made FROM made),
under AS (SELECT s.ord, m.id, k.id AS up FROM spec s JOIN made m ON lower(m.name) = lower(s.name) JOIN key k ON k.key = s.parent OR k.key = lower(s.parent) WHERE (k.made IS NULL OR k.made <= s.ord) AND k.id <> m.id)"""


def _topics(t):
    n = t.nation
    before = n.select((F.col("n_nationkey") + 1).alias("n_nationkey"), F.lower("n_name").alias("before"))
    first = n.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(before, "n_nationkey", "left")
    parent = F.when(F.expr("n_nationkey % 3 = 0"), F.col("r_name")).when(F.expr("n_nationkey % 3 = 1"), F.col("before")).otherwise("nowhere")
    first = first.select(F.col("n_name").alias("name"), F.lit("").alias("summary"), parent.alias("parent"), F.col("n_nationkey").cast("long").alias("ord"))
    parent = F.when(F.expr("n_nationkey % 4 = 0"), F.concat(F.lit("topic_"), "n_regionkey")).when(F.expr("n_nationkey % 4 = 1"), F.col("n_name"))
    again = n.select(F.lower("n_name").alias("name"), F.when(F.expr("n_nationkey % 2 = 0"), F.concat(F.lit("about "), "n_name")).otherwise("").alias("summary"), parent.alias("parent"), (F.col("n_nationkey") + 100).cast("long").alias("ord"))
    return U.upsert_topics(held(t), first.unionByName(again))


query("grf08", f"WITH {_HELD_SQL}, {_SPEC_SQL} SELECT 'topic_x' AS src, 'topic_1' AS dst, 'subtopic_of' AS kind UNION ALL SELECT DISTINCT id, up, 'subtopic_of' FROM under")(lambda t: _topics(t).edges.select("src", "dst", "kind"))
query("grf08_topics", f"""WITH {_HELD_SQL}, {_SPEC_SQL}, last AS (SELECT id, arg_max(up, ord) AS up FROM under GROUP BY id) SELECT id, name, summary, NULL AS parent_id FROM topic
UNION ALL SELECT m.id, m.name, coalesce((SELECT max(summary) FROM spec WHERE lower(name) = lower(m.name) AND summary <> ''), ''), last.up FROM made m LEFT JOIN last USING (id)""")(
    lambda t: _topics(t).nodes.where("type = 'topic'").select("id", "name", "summary", "parent_id")
)

_REL_SQL = f"""rel AS (SELECT 'cust ' || o_custkey AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || (o_orderkey % 50 + 1) WHEN o_orderkey % 3 = 1 THEN 'New: ' || (o_orderkey % 9) ELSE 'NEW ' || (o_orderkey % 9) END AS target, 'kind ' || (o_orderkey % 4) AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, o_orderkey AS ord FROM orders),
nm AS (SELECT source AS name, ord FROM rel UNION ALL SELECT target, ord FROM rel),
known AS (SELECT lower(name) AS key, id FROM entity UNION SELECT lower(id), id FROM entity UNION SELECT lower(aliases[1]), id FROM entity),
ids AS (SELECT name, coalesce(a.id, b.id, 'entity_' || {SLUG('name')}) AS id, a.id IS NULL AND b.id IS NULL AS fresh FROM (SELECT DISTINCT name FROM nm) n LEFT JOIN known a ON a.key = lower(name) LEFT JOIN known b ON b.key = 'entity_' || {SLUG('name')})"""


def _related(t):
    k = F.col("o_orderkey")
    target = F.when(k % 3 == 0, F.concat(F.lit("c"), k % 50 + 1)).when(k % 3 == 1, F.concat(F.lit("New: "), k % 9)).otherwise(F.concat(F.lit("NEW "), k % 9))
    rows = t.orders.select(F.concat(F.lit("cust "), "o_custkey").alias("source"), target.alias("target"), F.concat(F.lit("kind "), k % 4).alias("predicate"), F.when(k % 2 == 0, "EXTRACTED").otherwise("INFERRED").alias("confidence"), k.cast("long").alias("ord"))
    return U.add_relations(held(t), rows)


query("grf11", f"WITH {_HELD_SQL}, {_REL_SQL} SELECT 'topic_x' AS src, 'topic_1' AS dst, 'subtopic of' AS label, 'EXTRACTED' AS confidence UNION ALL SELECT a.id, b.id, label, arg_min(confidence, ord) FROM rel JOIN ids a ON a.name = source JOIN ids b ON b.name = target WHERE a.id <> b.id GROUP BY ALL")(
    lambda t: _related(t).edges.select("src", "dst", "label", "confidence")
)
query("grf11_entities", f"WITH {_HELD_SQL}, {_REL_SQL} SELECT id, name, mentions FROM entity UNION ALL SELECT id, arg_min(name, ord), 1 FROM ids JOIN nm USING (name) WHERE fresh GROUP BY id")(lambda t: _related(t).nodes.where("type = 'entity'").select("id", "name", "mentions"))

_NOTE_SQL = f"note AS (SELECT 'Note ' || (p_partkey % 200) AS name, 'synthesis_' || {SLUG("'Note ' || (p_partkey % 200)")} AS id, 'notes/' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS abstract, p_partkey AS ord FROM part)"


def _noted(t):
    k = F.col("p_partkey")
    rows = t.part.select(F.concat(F.lit("Note "), k % 200).alias("name"), F.concat(F.lit("notes/"), k).alias("path"), F.when(k % 3 == 0, F.col("p_type")).otherwise("").alias("abstract"), F.array(F.concat(F.lit("CUST "), k % 100 + 1), F.lit("asia"), F.lit("nothing")).alias("covers"), k.cast("long").alias("ord"))
    return U.add_syntheses(held(t), rows)


query("grf10", f"WITH {_HELD_SQL}, {_NOTE_SQL} SELECT DISTINCT id AS src, 'entity_cust-' || (ord % 100 + 1) AS dst FROM note UNION SELECT n.id, t.id FROM note n, topic t WHERE lower(t.name) = 'asia'")(lambda t: _noted(t).edges.where("kind = 'covers'").select("src", "dst"))
query("grf10_syntheses", f"WITH {_NOTE_SQL} SELECT id, arg_min(name, ord) AS name, arg_max(path, ord) AS path, coalesce(arg_max(abstract, ord) FILTER (abstract <> ''), '') AS abstract FROM note GROUP BY id")(lambda t: _noted(t).nodes.where("type = 'synthesis'").select("id", "name", "path", "abstract"))

# the cache has each third page; half of the documents are chunks of the graph, a third vectors, of the pages' addresses
_FILL_SQL = """page AS (SELECT url, page_id, html, 'cache_' || substr(sha256(url), 1, 16) AS id FROM pages), n AS (SELECT count(*) AS n FROM pages),
kg AS (SELECT p.url, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FILTER (text <> '') AS text, array_to_string(list('chunk_' || doc_id ORDER BY doc_id), ' ') AS ids FROM documents, n JOIN page p ON page_id = doc_id % n WHERE doc_id % 2 = 0 GROUP BY p.url),
vec AS (SELECT p.url, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FILTER (text <> '') AS text FROM documents, n JOIN page p ON page_id = doc_id % n WHERE doc_id % 3 = 0 GROUP BY p.url),
had AS (SELECT id, min(url) AS url, min(sha256(html)) AS h FROM page WHERE page_id % 3 = 0 GROUP BY id),
found AS (SELECT coalesce(kg.url, vec.url) AS url, kg.url IS NOT NULL AS kg, vec.url IS NOT NULL AS vec, ids, coalesce(kg.text, vec.text) AS text FROM kg FULL JOIN vec ON kg.url = vec.url)"""


def _filled(t):
    n = t.pages.agg(F.count("*").alias("n"))
    paged = t.documents.join(F.broadcast(n)).join(t.pages.select("url", "page_id"), F.col("page_id") == F.col("doc_id") % F.col("n"))  # n: one row
    nodes = paged.where("doc_id % 2 = 0").select(F.concat(F.lit("chunk_"), "doc_id").alias("id"), F.lit("chunk").alias("type"), "url", "text", F.col("doc_id").alias("ord"))
    vectors = paged.where("doc_id % 3 = 0").select("url", "text", F.col("doc_id").alias("ord"))
    empty = F.array().cast("array<string>")
    cache = bind.cache_items(t).where("kind = 'url' and (ord - 1000000000) % 3 = 0").select("id", "source_url", "raw_text", "content_hash", F.lit(False).alias("in_kg"), empty.alias("kg_chunk_ids"), F.lit("").alias("kg_projected_hash"), F.lit(False).alias("vectorized"), F.lit("").alias("vector_projected_hash"))
    # of pages with one address the cache has that of the smallest hash
    own = [c for c in cache.columns if c != "id"]
    cache = cache.groupBy("id").agg(F.min_by(F.struct(*own), "content_hash").alias("x")).select("id", "x.*")
    return U.backfill(cache, nodes, vectors)


query("cac02", f"""WITH {_FILL_SQL}, b AS (SELECT coalesce(h.id, 'cache_' || substr(sha256(f.url), 1, 16)) AS id, coalesce(h.url, f.url) AS source_url, coalesce(h.h, sha256(f.text)) AS hash, h.id IS NOT NULL AS known, coalesce(kg, false) AS kg, coalesce(vec, false) AS vec, ids FROM had h FULL JOIN found f ON h.url = f.url)
SELECT id, source_url, hash AS content_hash, kg AS in_kg, CASE WHEN kg THEN ids ELSE '' END AS chunks, CASE WHEN kg THEN hash ELSE '' END AS kg_projected_hash, vec AS vectorized, CASE WHEN vec THEN hash ELSE '' END AS vector_projected_hash, CASE WHEN NOT known THEN 'created' WHEN kg OR vec THEN 'updated' ELSE 'kept' END AS outcome FROM b""")(
    lambda t: _filled(t).select("id", "source_url", "content_hash", "in_kg", F.array_join("kg_chunk_ids", " ").alias("chunks"), "kg_projected_hash", "vectorized", "vector_projected_hash", "outcome")
)
