"""Queries of integration: staged chunks with extractions into the graph.

Documents are the staged chunks, but for each seventh, which the graph has. A document's capital words are its entities, in
order; long ones have their first six letters, which other documents have as names, and a letter's group as aliases. Each
word is related to the next; each fourth document's first word to its language, which is an entity of the graph, with the
first word of the language as an alias.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import integration as N
from . import bind
from .bind import NODE_SQL
from .registry import query
from .scalars import SLUG

_INPUT_SQL = f"""{NODE_SQL},
chunk AS (SELECT 'chunk_' || doc_id AS id, doc_id AS ord, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'http://' || source || '/' || (doc_id % 2) END AS url, lang FROM documents),
staged AS (SELECT * FROM chunk WHERE ord % 7 <> 0),
word AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS pos FROM ent),
found AS (SELECT doc_id, pos, name, CASE length(name) % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'concept' ELSE 'thing' END AS kind, CASE WHEN length(name) >= 9 THEN [substr(name, 1, 6), 'Group ' || substr(name, 1, 1)] ELSE [] END AS aliases,
 CASE WHEN length(name) % 4 = 0 THEN 9 ELSE (1 + length(name) % 5)::INT END AS importance, repeat('s', ((doc_id + length(name)) % 11)::INT) AS summary, CASE WHEN doc_id % 2 = 0 THEN 'INFERRED' ELSE '' END AS confidence FROM word),
rel AS (SELECT a.doc_id, a.pos, a.name AS source, b.name AS target, (['next', '', 'after'])[a.pos % 3 + 1] AS predicate, 'EXTRACTED' AS confidence FROM word a JOIN word b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
 UNION ALL SELECT w.doc_id, 100000, name, 'Lang ' || lang, 'in', 'INFERRED' FROM word w JOIN documents d ON d.doc_id = w.doc_id WHERE pos = 1 AND w.doc_id % 4 = 0),
old AS (SELECT 'entity_' || {SLUG("'Lang ' || lang")} AS id, 'Lang ' || lang AS name, row_number() OVER (ORDER BY lang) - 100 AS ord, [min(name)] AS aliases FROM ent JOIN documents USING (doc_id) GROUP BY lang),
old_edge AS (SELECT id AS src, 'entity_' || {SLUG("'Lang ' || lang")} AS dst, 'mentions' AS kind, 'mentions' AS label, 'EXTRACTED' AS confidence, id AS chunk_id FROM chunk WHERE ord % 7 = 0)"""


def _words(t):
    return bind.entities_of(t).withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("name")))


def inputs(t):
    """(staged, entities, relations, graph) of the documents."""
    d = t.documents
    id_ = F.concat(F.lit("chunk_"), "doc_id")
    chunk = d.select(
        id_.alias("id"), F.col("doc_id").alias("ord"), F.when(F.expr("doc_id % 5 = 0"), "").otherwise(F.col("source")).alias("source_title"),
        F.when(F.expr("doc_id % 3 = 0"), "").otherwise(F.concat(F.lit("http://"), "source", F.lit("/"), F.expr("doc_id % 2"))).alias("source_url"), "lang",
    )
    w, n = _words(t), F.length("name")
    found = w.select(
        id_.alias("chunk_id"), "pos", "name", F.when(n % 3 == 0, "person").when(n % 3 == 1, "concept").otherwise("thing").alias("kind"),
        F.when(n >= 9, F.array(F.substring("name", 1, 6), F.concat(F.lit("Group "), F.substring("name", 1, 1)))).alias("aliases"), F.when(n % 4 == 0, 9).otherwise(1 + n % 5).alias("importance"),
        F.expr("repeat('s', cast((doc_id + length(name)) % 11 as int))").alias("summary"), F.when(F.expr("doc_id % 2 = 0"), "INFERRED").otherwise("").alias("confidence"),
    )
    by = Window.partitionBy("doc_id").orderBy("name")
    rel = w.withColumn("target", F.lead("name").over(by)).where("target is not null")
    rel = rel.select(id_.alias("chunk_id"), "pos", F.col("name").alias("source"), "target", F.element_at(F.array(F.lit("next"), F.lit(""), F.lit("after")), (F.col("pos") % 3 + 1).cast("int")).alias("predicate"), F.lit("EXTRACTED").alias("confidence"))
    lang = F.concat(F.lit("Lang "), "lang")
    more = w.where("pos = 1 and doc_id % 4 = 0").join(d.select("doc_id", "lang"), "doc_id").select(id_.alias("chunk_id"), F.lit(100000).alias("pos"), F.col("name").alias("source"), lang.alias("target"), F.lit("in").alias("predicate"), F.lit("INFERRED").alias("confidence"))
    old = bind.entities_of(t).select("doc_id", "name").join(d.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.array(F.min("name")).alias("aliases"))
    known = F.concat(F.lit("entity_"), bind.text.slug(lang))
    old = old.select(known.alias("id"), F.lit("entity").alias("type"), F.lit(3).alias("layer"), lang.alias("name"), F.lit("concept").alias("kind"), "aliases", F.lit(2).alias("importance"), F.lit(1).cast("long").alias("mentions"), F.lit("s").alias("summary"), F.lit("").alias("title"), F.lit("").alias("url"), (F.row_number().over(Window.orderBy("lang")) - 100).cast("long").alias("ord"))
    blank = lambda *names: [F.lit(None).cast(old.schema[c].dataType).alias(c) for c in names]
    had = chunk.where("ord % 7 = 0")
    nodes = old.unionByName(had.select("id", F.lit("chunk").alias("type"), F.lit(2).alias("layer"), *blank("name", "kind", "aliases", "importance", "mentions", "summary"), F.col("source_title").alias("title"), F.col("source_url").alias("url"), "ord"))
    first = t.spark.createDataFrame([("source_src1", "source", 0, "src1", "", -5)], "id string, type string, layer int, title string, url string, ord long")
    edges = had.select(F.col("id").alias("src"), known.alias("dst"), F.lit("mentions").alias("kind"), F.lit("mentions").alias("label"), F.lit("EXTRACTED").alias("confidence"), F.col("id").alias("chunk_id"))
    return chunk.where("ord % 7 <> 0").drop("lang"), found, rel.unionByName(more), N.Graph(nodes.unionByName(first, allowMissingColumns=True), edges)


_RESOLVED_SQL = f"""{_INPUT_SQL},
ev AS (SELECT f.doc_id, (f.doc_id * 10000000 + pos * 10) AS plc, f.name, lower(f.name) AS key, kind, aliases, importance, summary, confidence, true AS listed FROM found f JOIN staged s ON s.ord = f.doc_id
 UNION ALL SELECT doc_id, min(plc), arg_min(name, plc), key, 'concept', [], NULL, '', 'INFERRED', false FROM (SELECT r.doc_id, r.doc_id * 10000000 + 5000000 + pos * 10 + z.e AS plc, CASE z.e WHEN 0 THEN source ELSE target END AS name, lower(CASE z.e WHEN 0 THEN source ELSE target END) AS key FROM rel r JOIN staged s ON s.ord = r.doc_id, (SELECT unnest([0, 1]) AS e) z)
  WHERE (doc_id, key) NOT IN (SELECT (doc_id, lower(name)) FROM found) GROUP BY doc_id, key),
named AS (SELECT key, min(plc) AS plc, arg_min(name, plc) AS name FROM ev GROUP BY key),
given AS (SELECT key, arg_min(owner, plc) AS owner, min(plc) AS given FROM (SELECT plc, key AS owner, lower(unnest(aliases)) AS key FROM ev) GROUP BY key),
known AS (SELECT lower(id) AS key, id FROM old UNION ALL SELECT lower(name), id FROM old UNION ALL SELECT * FROM (SELECT key, arg_min(id, ord) AS id FROM (SELECT lower(unnest(aliases)) AS key, id, ord FROM old) GROUP BY key) a WHERE key NOT IN (SELECT lower(name) FROM old)),
head AS (SELECT n.key, n.name, n.plc, k.id AS known, CASE WHEN k.id IS NULL AND given < n.plc THEN owner END AS up FROM named n LEFT JOIN given g USING (key) LEFT JOIN (SELECT key, any_value(id) AS id FROM known GROUP BY key) k USING (key)),
chase AS (SELECT key AS x, key AS cur FROM head UNION ALL SELECT x, up FROM chase JOIN head ON key = cur WHERE up IS NOT NULL),
stem AS (SELECT key, known, {SLUG('name')} AS slug, row_number() OVER (PARTITION BY known IS NULL, {SLUG('name')} ORDER BY plc) AS k FROM head WHERE up IS NULL),
rooted AS (SELECT key, known IS NULL AS fresh, CASE WHEN known IS NOT NULL THEN known WHEN k = 1 AND 'entity_' || slug NOT IN (SELECT id FROM old) THEN 'entity_' || slug ELSE 'entity_' || slug || '-' || substr(sha256(key), 1, 4) END AS id FROM stem),
res AS (SELECT x AS key, r.id, fresh FROM chase JOIN rooted r ON r.key = cur),
own AS (SELECT ev.*, res.id, fresh FROM ev JOIN res USING (key)),
g AS (SELECT id, any_value(fresh) AS fresh, count(*) AS gain, max(importance) FILTER (importance BETWEEN 1 AND 5) AS most, arg_min(kind, plc) FILTER (kind = 'person') AS said, arg_min(summary, (-length(summary), plc)) AS longest, arg_min(name, plc) AS name, min(plc) // 10000000 AS ord,
 CASE WHEN arg_min(coalesce(importance, 9), plc) BETWEEN 1 AND 5 THEN arg_min(importance, plc) ELSE 3 END AS importance, list_distinct(flatten(list(aliases))) AS aliases FROM own GROUP BY id)"""
_EDGE_SQL = """pair AS (SELECT url, title, min(ord) AS ord, row_number() OVER (ORDER BY min(ord)) AS k FROM staged WHERE title <> '' OR url <> '' GROUP BY url, title),
src AS (SELECT 0::BIGINT AS k, ['']::VARCHAR[] AS us, ['src1'] AS ts, ['source_src1'] AS ids, NULL::VARCHAR AS id, NULL::VARCHAR AS url, NULL::VARCHAR AS title
UNION ALL SELECT k, CASE WHEN hit IS NULL THEN list_append(us, url) ELSE us END, CASE WHEN hit IS NULL THEN list_append(ts, coalesce(nullif(title, ''), url)) ELSE ts END, CASE WHEN hit IS NULL THEN list_append(ids, fresh) ELSE ids END, CASE WHEN hit IS NULL THEN fresh ELSE ids[hit] END, url, title
 FROM (SELECT p.k, us, ts, ids, p.url, p.title, 'source_' || """ + SLUG("coalesce(nullif(p.url, ''), p.title)") + """ AS fresh, list_min(list_filter(range(1, len(us) + 1), lambda i: (p.url <> '' AND us[i] = p.url) OR ts[i] = p.title)) AS hit FROM src JOIN pair p ON p.k = src.k + 1)),
m AS (SELECT 'chunk_' || doc_id AS src, id AS dst, arg_min(coalesce(nullif(confidence, ''), 'EXTRACTED'), plc) AS confidence FROM own WHERE listed GROUP BY ALL),
r AS (SELECT a.id AS src, b.id AS dst, coalesce(nullif(predicate, ''), 'related to') AS label, arg_min(rel.confidence, (doc_id, pos)) AS confidence, 'chunk_' || arg_min(doc_id, (doc_id, pos)) AS chunk_id FROM rel JOIN staged s ON s.ord = doc_id JOIN res a ON a.key = lower(source) JOIN res b ON b.key = lower(target) WHERE a.id <> b.id GROUP BY ALL)
SELECT * FROM old_edge UNION ALL SELECT s.id, src.id, 'from_source', 'from source', 'EXTRACTED', NULL FROM staged s JOIN src USING (url, title) UNION ALL SELECT src, dst, 'mentions', 'mentions', confidence, src FROM m UNION ALL SELECT src, dst, 'relation', label, confidence, chunk_id FROM r"""


def _twice(t):
    """Integrated, and the same staged chunks again, which changes nothing."""
    staged, found, rel, held = inputs(t)
    return N.integrate(staged, found, rel, N.integrate(staged, found, rel, held))


_COLUMNS = ("src", "dst", "kind", "label", "confidence", "chunk_id")
query("grf02", f"WITH RECURSIVE {_RESOLVED_SQL}, {_EDGE_SQL}")(lambda t: N.integrate(*inputs(t)).edges.select(*_COLUMNS))
query("grf02_again", f"WITH RECURSIVE {_RESOLVED_SQL}, {_EDGE_SQL}")(lambda t: _twice(t).edges.select(*_COLUMNS))
_ALIASES = "array_to_string(list_sort(list_filter({}, lambda a: lower(a) <> lower({}))), '|')"
_ENTITIES_SQL = f"""SELECT id, name, coalesce(said, 'concept') AS kind, mentions::BIGINT AS mentions, importance::INT AS importance, summary, aliases FROM (
SELECT o.id, o.name, said, 1 + coalesce(gain, 0) AS mentions, greatest(2, most) AS importance, CASE WHEN length(coalesce(longest, '')) > 1 THEN longest ELSE 's' END AS summary, array_to_string(list_sort(list_distinct(list_concat(o.aliases, list_filter(coalesce(g.aliases, []), lambda a: lower(a) <> lower(o.name))))), '|') AS aliases FROM old o LEFT JOIN g USING (id)
UNION ALL SELECT id, name, said, gain, greatest(importance, most), longest, {_ALIASES.format('aliases', 'name')} FROM g WHERE fresh)"""
query("grf03", f"WITH RECURSIVE {_RESOLVED_SQL} {_ENTITIES_SQL}")(
    lambda t: N.integrate(*inputs(t)).nodes.where("type = 'entity'").select("id", "name", "kind", "mentions", "importance", "summary", F.array_join("aliases", "|").alias("aliases"))
)
