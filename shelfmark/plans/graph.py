"""Queries for the graph operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph as G
from . import bind
from .bind import NODE_SQL
from .registry import query
from .scalars import SLUG

N, E = bind.nodes, bind.edges
W = f"WITH {NODE_SQL}"
HAY = "lower(concat_ws(' ', name, preview))"

query("flt01", f"{W} SELECT id, type FROM node WHERE contains({HAY}, 'the') ORDER BY ord LIMIT 30")(lambda t: G.search(N(t), "the").select("id", "type"))
query("flt02", f"{W} SELECT id, type, layer, coalesce(nullif(name, ''), substr(preview, 1, 80)) AS name, mentions FROM (SELECT * FROM node WHERE contains({HAY}, 'an') ORDER BY ord LIMIT 500) WHERE layer = 2 ORDER BY ord LIMIT 25")(lambda t: G.find_nodes(N(t), "an", layer=2))
_KEEP = "(SELECT id FROM node WHERE type IN ('source', 'section', 'chunk', 'entity', 'topic', 'synthesis'))"
query("flt03", f"{W} SELECT src, dst, kind FROM edge WHERE src IN {_KEEP} AND dst IN {_KEEP}")(lambda t: G.zoom(N(t), E(t), "chunk")[1].select("src", "dst", "kind"))
_BASE_SQL = "SELECT id, type FROM node WHERE type = 'source'"
query("flt03_document", f"{W} {_BASE_SQL}")(lambda t: G.zoom(N(t), E(t), "document")[0].select("id", "type"))
query("top11", f"{W} SELECT id, (mentions % 5)::INT AS importance, mentions FROM node WHERE type = 'entity' ORDER BY mentions % 5 DESC, mentions DESC, id LIMIT 50")(lambda t: N(t).where("type = 'entity'").withColumn("importance", F.expr("cast(mentions % 5 as int)")).orderBy(F.desc("importance"), F.desc("mentions"), "id").limit(50).select("id", "importance", "mentions"))
query("flt10", "SELECT doc_id FROM documents WHERE len(list_intersect([lower(lang), lower(source)], ['en', 'src3'])) > 0")(lambda t: t.documents.where(F.arrays_overlap(F.transform(F.array("lang", "source"), F.lower), F.array(F.lit("en"), F.lit("src3")))).select("doc_id"))
query("flt11", "SELECT doc_id, text FROM documents WHERE doc_id = 7")(lambda t: t.documents.where("doc_id = 7").select("doc_id", "text"))


@query("flt15", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
SELECT doc_id, i::INT AS i, substr(p, 1, 600) AS passage FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM p WHERE contains(lower(p), 'thin') OR contains(lower(p), 'sch')) WHERE k <= 4""")
def _flt15(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "p")).where(F.exists(F.array(F.lit("thin"), F.lit("sch")), lambda w: F.contains(F.lower("p"), w)))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).where("k <= 4").select("doc_id", (F.col("i") + 1).alias("i"), F.substring("p", 1, 600).alias("passage"))


query("flt17", "SELECT page_id, row_number() OVER (ORDER BY d NULLS LAST, n DESC, page_id)::INT AS place FROM (SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS d, length(html) AS n FROM pages) ORDER BY place LIMIT 60")(
    lambda t: t.pages.select("page_id", F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")).alias("d"), F.length("html").alias("n")).orderBy(F.asc_nulls_last("d"), F.desc("n"), "page_id").limit(60).withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("d"), F.desc("n"), "page_id"))).select("page_id", "place")
)

# joins
query("jon01", f"""{W}, ks AS (SELECT lower(id) AS key, id, 0 AS kind, ord FROM node WHERE type = 'entity' UNION ALL SELECT lower(name), id, 0, ord FROM node WHERE type = 'entity' UNION ALL SELECT lower(substr(name, 1, 6)), id, 1, ord FROM node WHERE type = 'entity')
SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY kind, CASE WHEN kind = 0 THEN -ord ELSE ord END, id) AS k FROM ks) WHERE k = 1""")(lambda t: _keys(t))


def _keys(t):
    return G.keys_of(N(t).where("type = 'entity'").withColumn("aliases", F.array(F.substring("name", 1, 6))))


@query("jon02", f"""{W}, m AS (SELECT dst AS id, src FROM edge WHERE kind = 'mentions') SELECT n.id, n.name, n.mentions, array_to_string((list(m.src ORDER BY m.src))[1:20], ' ') AS chunks FROM node n JOIN m USING (id) GROUP BY n.id, n.name, n.mentions""")
def _jon02(t):
    m = E(t).where("kind = 'mentions'").select(F.col("dst").alias("id"), "src")
    first = m.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("src"))).where("k <= 20")
    first = first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("src")), " ").alias("chunks"))
    return N(t).where("type = 'entity'").join(first, "id").select("id", "name", "mentions", "chunks")


_GONE = "(SELECT id FROM node WHERE type = 'source' AND name IN ('src0', 'src5'))"
query("jon03", f"{W} SELECT src, dst, kind FROM edge WHERE src NOT IN {_GONE} AND dst NOT IN {_GONE}")(lambda t: G.without(N(t), E(t), N(t).where("type = 'source' and name in ('src0', 'src5')").select("id"))[1].select("src", "dst", "kind"))
query("jon04", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda t: t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id"))
query("jon06", f"{W}, s AS (SELECT DISTINCT name, source FROM ent) SELECT a.source AS a, b.source AS b, count(*) AS weight FROM s a JOIN s b ON a.name = b.name AND a.source < b.source GROUP BY ALL HAVING count(*) >= 2")(lambda t: G.shared_mentions(bind.entities_of(t).select(F.col("name").alias("entity"), "source")))
query("grf_shares", f"{W}, s AS (SELECT DISTINCT name, source FROM ent), p AS (SELECT a.source AS a, b.source AS b, count(*) AS weight FROM s a JOIN s b ON a.name = b.name AND a.source < b.source GROUP BY ALL HAVING count(*) >= 2) SELECT 'shares_' || substr(sha256(a || '|' || b), 1, 16) AS id, weight || ' shared' AS label FROM p")(
    lambda t: G.shared_mentions(bind.entities_of(t).select(F.col("name").alias("entity"), "source")).select(F.concat(F.lit("shares_"), F.substring(F.sha2(F.concat_ws("|", "a", "b"), 256), 1, 16)).alias("id"), F.concat("weight", F.lit(" shared")).alias("label"))
)


@query("jon07", f"""WITH {bind.CHUNK_SQL}, g AS (SELECT url, count(*) AS kg, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS body FROM chunk WHERE ord % 3 = 0 GROUP BY url), v AS (SELECT url, count(*) AS vec, min(ord) AS first FROM chunk WHERE ord % 4 = 0 GROUP BY url)
SELECT coalesce(g.url, v.url) AS url, coalesce(kg, 0) AS kg, coalesce(vec, 0) AS vec, sha256(coalesce(body, '')) AS body FROM g FULL JOIN v ON g.url = v.url""")
def _jon07(t):
    c = bind.chunks(t)
    kg = c.where("ord % 3 = 0").groupBy("url").agg(F.count("*").alias("kg"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("text").alias("s")))), lambda x: x["s"]), "\n\n").alias("body"))
    vec = c.where("ord % 4 = 0").groupBy("url").agg(F.count("*").alias("vec"))
    return kg.join(vec, "url", "full_outer").select("url", F.coalesce("kg", F.lit(0)).alias("kg"), F.coalesce("vec", F.lit(0)).alias("vec"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("body"))


@query("jon15", "WITH m AS (SELECT b.item_id, x.p, x.c FROM benchmark b, (SELECT unnest([1, 2, 3]) AS p) y, LATERAL (SELECT y.p, CASE y.p WHEN 1 THEN b.item_id * 3 WHEN 2 THEN b.item_id * 3 + 1 ELSE b.item_id * 3 END AS c) x) SELECT item_id, doc_id, min(p)::INT AS place, any_value(source) AS source FROM m JOIN documents ON doc_id = c GROUP BY item_id, doc_id")
def _jon15(t):
    """Chunk ids cited in an answer, in the order first seen, at most twenty."""
    answer = F.format_string("as [chunk_%d] and [chunk_%d], again chunk_%d", F.col("item_id") * 3, F.col("item_id") * 3 + 1, F.col("item_id") * 3)
    cited = t.benchmark.select("item_id", F.posexplode(F.regexp_extract_all(answer, F.lit("chunk_([0-9a-z_]+)"), F.lit(1))).alias("p", "c")).groupBy("item_id", F.col("c").cast("long").alias("doc_id")).agg((F.min("p") + 1).alias("place"))
    return cited.where("place <= 20").join(t.documents.select("doc_id", "source"), "doc_id").select("item_id", "doc_id", "place", "source")


query("jon16", "SELECT n.n_name AS topic, count(s.s_suppkey) AS entities FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")(
    lambda t: t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("topic")).agg(F.count("s_suppkey").alias("entities"))
)
query("agg24", "SELECT n_name AS topic, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")(lambda t: t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("topic")).agg(F.count("*").alias("members")))


@query("jon18", "WITH ids AS (SELECT unnest(range(0, 60)) * 7 % 61 AS id, unnest(range(0, 60)) AS p), u AS (SELECT doc_id, 0 AS store, 'd' || text AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, 'o' || text FROM documents) SELECT p::INT AS place, doc_id, arg_min(text, store) AS text FROM ids JOIN u ON doc_id = id GROUP BY p, doc_id")
def _jon18(t):
    """The staging store first, then the whole one; in the order asked."""
    wanted = t.spark.sql("SELECT posexplode(transform(sequence(0, 59), x -> cast(x * 7 % 61 as bigint))) AS (place, doc_id)")
    d = t.documents
    both = d.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("store"), F.concat(F.lit("d"), "text").alias("text")).union(d.select("doc_id", F.lit(1), F.concat(F.lit("o"), "text")))
    return wanted.join(both, "doc_id").groupBy("place", "doc_id").agg(F.min_by("text", "store").alias("text"))


# aggregates over the graph
query("agg01", f"{W} SELECT count(*) FILTER (type = 'source') AS sources, count(*) FILTER (type = 'chunk') AS chunks, count(*) FILTER (type = 'entity') AS entities, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM edge WHERE kind = 'mentions') AS mentions FROM node")(
    lambda t: N(t).agg(F.count_if(F.col("type") == "source").alias("sources"), F.count_if(F.col("type") == "chunk").alias("chunks"), F.count_if(F.col("type") == "entity").alias("entities")).join(F.broadcast(E(t).agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "mentions").alias("mentions"))))
)
query("agg15", "SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) GROUP BY ALL")(
    lambda t: t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
)
_CUST = "SELECT c_custkey AS ord, 'entity_' || c_custkey AS id, upper(substr(c_mktsegment, 1, 4)) || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '-' END || (c_custkey % 400) AS name, (c_custkey % 17)::BIGINT AS mentions FROM customer"


def _people(t):
    return t.customer.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("entity_"), "c_custkey").alias("id"), F.concat(F.upper(F.substring("c_mktsegment", 1, 4)), F.when(F.expr("c_custkey % 2 = 0"), " ").otherwise("-"), F.expr("c_custkey % 400")).alias("name"), F.expr("c_custkey % 17").cast("long").alias("mentions"))


_GROUPS = f"WITH p AS ({_CUST}), k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM p)"
_MERGED = "g AS (SELECT key, arg_max(id, (mentions, -ord)) AS id, arg_max(name, (mentions, -ord)) AS name, sum(mentions)::BIGINT AS mentions, list_sort(list(DISTINCT name)) AS names FROM k GROUP BY key)"
query("agg16", f"{_GROUPS}, {_MERGED} SELECT id, name, mentions, array_to_string(list_filter(names, lambda x: x <> name), '|') AS aliases FROM g")(lambda t: G.merge_duplicates(_people(t), _people_edges(t))[0].select("id", "name", "mentions", F.array_join("aliases", "|").alias("aliases")))
query("set06", f"{_GROUPS}, {_MERGED} SELECT id, len(list_filter(names, lambda x: x <> name))::INT AS n_aliases FROM g")(lambda t: G.merge_duplicates(_people(t), _people_edges(t))[0].select("id", F.size("aliases").alias("n_aliases")))


def _people_edges(t):
    return t.orders.select(F.concat(F.lit("entity_"), "o_custkey").alias("src"), F.concat(F.lit("entity_"), F.expr("o_orderkey % 150")).alias("dst"), F.lit("relation").alias("kind"))


_EDGES = "e AS (SELECT 'entity_' || o_custkey AS src, 'entity_' || (o_orderkey % 150) AS dst, 'relation' AS kind FROM orders), to_ AS (SELECT k.id, g.id AS keep FROM k JOIN g USING (key)), r AS (SELECT DISTINCT coalesce(a.keep, src) AS src, coalesce(b.keep, dst) AS dst, kind FROM e LEFT JOIN to_ a ON a.id = src LEFT JOIN to_ b ON b.id = dst)"
query("grf07", f"{_GROUPS}, {_MERGED}, {_EDGES} SELECT * FROM r WHERE src <> dst")(lambda t: G.merge_duplicates(_people(t), _people_edges(t))[1])
query("set05", "WITH e AS (SELECT 'entity_' || o_custkey AS src, 'entity_' || (o_orderkey % 150) AS dst, o_orderkey AS ord FROM orders) SELECT src, dst, min(ord) AS ord FROM e WHERE src <> dst GROUP BY ALL")(
    lambda t: t.orders.select(F.concat(F.lit("entity_"), "o_custkey").alias("src"), F.concat(F.lit("entity_"), F.expr("o_orderkey % 150")).alias("dst"), "o_orderkey").where("src <> dst").groupBy("src", "dst").agg(F.min("o_orderkey").alias("ord"))
)


_MERGE_SQL = f"""WITH p AS (SELECT *, repeat('s', (ord % 13)::INT) AS summary, CASE WHEN ord % 4 = 0 THEN ['Alias ' || (ord % 5), ''] ELSE []::VARCHAR[] END AS aliases FROM ({_CUST})),
mp AS (SELECT 'entity_' || (c_custkey - c_custkey % 10 + 1) AS keep, id AS drop_ FROM p JOIN customer ON c_custkey = ord WHERE c_custkey % 10 IN (3, 8) AND ('entity_' || (c_custkey - c_custkey % 10 + 1)) IN (SELECT id FROM p)),
x AS (SELECT p.*, keep, coalesce(keep, id) AS to_ FROM p LEFT JOIN mp ON drop_ = id)"""


def _merging(t):
    """In every ten entities the fourth and the ninth go into the second."""
    people = _people(t).withColumn("summary", F.expr("repeat('s', cast(ord % 13 as int))")).withColumn("aliases", F.when(F.expr("ord % 4 = 0"), F.array(F.concat(F.lit("Alias "), F.expr("ord % 5")), F.lit(""))).otherwise(F.array().cast("array<string>")))
    pairs = people.where("ord % 10 in (3, 8)").select(F.concat(F.lit("entity_"), F.expr("ord - ord % 10 + 1")).alias("keep"), F.col("id").alias("drop"))
    return G.merge_entities(people, _people_edges(t), pairs)


query("grf06", f"""{_MERGE_SQL}, g AS (SELECT to_ AS id, arg_max(name, keep IS NULL) AS name, sum(mentions)::BIGINT AS mentions, arg_max(summary, (length(summary), keep IS NULL, -ord)) AS summary, list_distinct(flatten(list(list_concat(aliases, CASE WHEN keep IS NULL THEN []::VARCHAR[] ELSE [name] END)))) AS names FROM x GROUP BY to_)
SELECT id, name, mentions, summary, array_to_string(list_sort(list_filter(names, lambda a: a <> '' AND a <> name)), '|') AS aliases FROM g""")(
    lambda t: _merging(t)[0].select("id", "name", "mentions", "summary", F.array_join("aliases", "|").alias("aliases"))
)
query("grf06_edges", f"""{_MERGE_SQL}, e AS (SELECT 'entity_' || o_custkey AS src, 'entity_' || (o_orderkey % 150) AS dst, 'relation' AS kind FROM orders),
r AS (SELECT coalesce(a.keep, src) AS src, coalesce(b.keep, dst) AS dst, kind FROM e LEFT JOIN mp a ON a.drop_ = src LEFT JOIN mp b ON b.drop_ = dst) SELECT src, dst, kind FROM r WHERE NOT (src = dst AND src IN (SELECT keep FROM mp))""")(lambda t: _merging(t)[1].select("src", "dst", "kind"))


_FOUND_SQL = "f AS (SELECT event_id AS ord, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END || ' ' || (user_id % 50) AS name, CASE WHEN event_id % 4 = 0 THEN 'concept' ELSE 'person' END AS kind, (event_id % 5 + 1)::INT AS importance, repeat('x', (event_id % 11)::INT) AS summary, user_id AS source FROM events)"


def _found(t):
    return t.events.select(F.col("event_id").alias("ord"), F.concat(F.when(F.expr("event_id % 3 = 0"), F.upper("event_type")).otherwise(F.col("event_type")), F.lit(" "), F.expr("user_id % 50")).alias("name"), F.when(F.expr("event_id % 4 = 0"), "concept").otherwise("person").alias("kind"), F.expr("cast(event_id % 5 + 1 as int)").alias("importance"), F.expr("repeat('x', cast(event_id % 11 as int))").alias("summary"), F.col("user_id").alias("source"))


_UPSERT = f"SELECT 'entity_' || {SLUG('name')} AS id, name, kind, mentions, importance, summary FROM (SELECT arg_min(name, ord) AS name, coalesce(arg_min(kind, ord) FILTER (kind <> 'concept'), 'concept') AS kind, count(*) AS mentions, max(importance) AS importance, arg_max(summary, (length(summary), -ord)) AS summary FROM f GROUP BY lower(name))"
query("agg20", f"WITH {_FOUND_SQL} {_UPSERT}")(lambda t: G.upsert_entities(_found(t)).drop("ord"))
query("grf01", f"SELECT 'chunk_' || substr(sha256(text), 1, 12) AS id, any_value(substr(text, 1, 240)) AS preview, count(*) AS staged FROM documents GROUP BY 'chunk_' || substr(sha256(text), 1, 12)")(
    lambda t: t.documents.groupBy(F.concat(F.lit("chunk_"), F.substring(F.sha2("text", 256), 1, 12)).alias("id")).agg(F.first(F.substring("text", 1, 240)).alias("preview"), F.count("*").alias("staged"))
)
for _depth in (1, 2):
    query("grf05" if _depth == 2 else "grf05_one", f"""WITH RECURSIVE {NODE_SQL}, u AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge), w AS (SELECT 'chunk_7' AS id, 0 AS d UNION SELECT u.b, w.d + 1 FROM w JOIN u ON u.a = w.id WHERE w.d < {_depth}) SELECT id, min(d)::INT * 0 AS zero FROM w GROUP BY id""")(
        lambda t, d=_depth: G.neighbourhood(E(t), ["chunk_7"], d)[0].select("id", F.lit(0).alias("zero"))
    )
query("grf05_many", f"""WITH RECURSIVE {NODE_SQL}, u AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge), w AS (SELECT 'chunk_' || doc_id AS start, 'chunk_' || doc_id AS id, 0 AS d FROM documents WHERE doc_id % 100 = 7 UNION SELECT w.start, u.b, w.d + 1 FROM w JOIN u ON u.a = w.id WHERE w.d < 2) SELECT start, id, min(d)::INT AS steps FROM w GROUP BY start, id""")(
    lambda t: G.neighbourhoods(E(t), t.documents.where("doc_id % 100 = 7").select(F.concat(F.lit("chunk_"), "doc_id").alias("start"), F.concat(F.lit("chunk_"), "doc_id").alias("id")), 2)[0]
)
query("grf09", "SELECT c_custkey AS entity, CASE WHEN c_custkey % 10 = 0 THEN 'topic_new' ELSE 'topic_' || c_nationkey END AS topic FROM customer")(
    lambda t: t.customer.select(F.col("c_custkey").alias("entity"), F.concat(F.lit("topic_"), "c_nationkey").alias("topic")).join(t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("entity")), "entity", "left_anti").unionByName(t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("entity"), F.lit("topic_new").alias("topic")))
)
query("set01", f"{W} SELECT DISTINCT source AS url FROM documents UNION SELECT DISTINCT lang FROM documents")(lambda t: t.documents.select(F.col("source").alias("url")).union(t.documents.select("lang")).distinct())
query("set02", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")(lambda t: t.documents.select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id")))
query("set03", "SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM labels")(lambda t: t.embeddings.select("vec_id").join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti"))
query("set04", "SELECT doc_id, array_to_string(list_distinct([lang, source, lang, 'new']).list_sort(), ' ') AS tags FROM documents")(lambda t: t.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.array("lang", "source", "lang", F.lit("new")))), " ").alias("tags")))
query("set07", "SELECT doc_id, 'current' AS store FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'overall' FROM documents")(lambda t: t.documents.where("doc_id % 2 = 0").select("doc_id", F.lit("current").alias("store")).unionByName(t.documents.select("doc_id", F.lit("overall").alias("store"))))




_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
#: accented letters become word characters that no name has, since the other engine's word ends know ASCII alone
_PLAIN = "translate(text, (SELECT string_agg(chr(c::INT), '') FROM range(192, 592) r(c)), repeat('_', 400))"
_NAMES_SQL = rf"""names AS (SELECT doc_id, {_PLAIN} AS text FROM documents),
runs AS (SELECT doc_id, unnest(r) AS run, unnest(range(0, len(r))) AS p FROM (SELECT doc_id, regexp_extract_all(text, '\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){{0,4}}\b') AS r FROM names)),
begins AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|[.!?]\s+|\n\n)([A-Z][a-zA-Z]+)\b', 1)) AS name FROM names),
words AS (SELECT doc_id, p, string_split_regex(run, '\s+') AS w FROM runs),
lead AS (SELECT doc_id, p, w[coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_LIST(text.ARTICLES)}, w[i]))), len(w) + 1):] AS w FROM words),
found AS (SELECT doc_id, array_to_string(w, ' ') AS name, count(*) AS count, min(p) AS first, max(len(w) > 1) AS multi FROM lead WHERE len(w) > 0 AND NOT list_contains({_LIST(text.NO_ENTITY)}, w[1]) GROUP BY ALL)"""
query("str08", f"WITH {_NAMES_SQL} SELECT doc_id, name, count, multi FROM found")(lambda t: G.proper_nouns(t.documents).select("doc_id", "name", "count", "multi"))
query("top14", f"""WITH {_NAMES_SQL}, cand AS (SELECT f.*, b.name IS NOT NULL AS starts FROM found f LEFT JOIN begins b USING (doc_id, name)),
once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY multi DESC, count DESC, first) AS f FROM cand WHERE multi OR count >= 3 OR (count = 2 AND NOT starts)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, multi ORDER BY count DESC, first) AS r FROM once WHERE f = 1), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY multi DESC, r)::INT AS place FROM ranked WHERE NOT multi OR r <= 12)
SELECT doc_id, name, place FROM placed WHERE place <= 18""")(lambda t: G.heuristic_entities(t.documents))
