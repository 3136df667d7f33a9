"""What a curator does to the graph, many acts at a time: topics, assignments, relations, syntheses, lists; and the cache's backfill.

Acts come as tables with ``ord``; a batch ends as if they were done one after another. Names are looked up as everywhere: an
entity by id, name or alias in any case, or by the id that its name would have; a topic by id or name, the first of several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import graph
from .integration import Graph


def _key(c: str) -> Column:
    return F.lower(text.strip(F.coalesce(F.col(c), F.lit(""))))


def list_entities(nodes: DataFrame, topic: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """(id, name, kind, importance, mentions, topic_id): the most important entities, of a kind and a topic; a topic that there isn't is
    no filter. The topic is looked up within the plan, as one row beside every entity."""
    some = nodes.where("type = 'entity'")
    if kind:
        some = some.where(F.col("kind") == kind)
    if topic:
        same = (F.col("id") == topic) | (F.lower("name") == topic.lower())
        found = nodes.where("type = 'topic'").where(same).agg(F.min_by("id", "ord").alias("__topic"))  # one row
        some = some.join(F.broadcast(found)).where(F.col("__topic").isNull() | F.coalesce(F.col("topic_id") == F.col("__topic"), F.lit(False)))
    return some.orderBy(F.desc("importance"), F.desc("mentions"), "ord").limit(limit).select("id", "name", "kind", "importance", "mentions", "topic_id")


def _topics(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id, at): what each key, an id or a name in lower case, stands for among the topics and the new ones of ``wanted``
    (key, name, at), which are made by their first mention."""
    own = nodes.where("type = 'topic'").select("id", F.lower("name").alias("name"), F.lit(None).cast("long").alias("at"), "ord")
    keys = own.select(F.explode(F.array_distinct(F.array("id", "name"))).alias("key"), "id", "at", "ord")
    first = wanted.where(text.slug(F.col("name")) != "").groupBy("key").agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at")).join(keys.select("key"), "key", "left_anti")
    slug = text.slug(F.col("name"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy(slug).orderBy("at"))).withColumn("id", F.concat(F.lit("topic_"), slug)).join(nodes.select("id", F.lit(True).alias("taken")), "id", "left")
    made = first.select("key", "name", "at", F.when((F.col("k") == 1) & F.col("taken").isNull(), F.col("id")).otherwise(F.concat("id", F.lit("-"), F.substring(F.sha2("key", 256), 1, 4))).alias("id"))
    new = made.select(F.explode(F.array_distinct(F.array("id", "key"))).alias("key"), "id", "at", F.lit(None).cast("long").alias("ord"), "name")
    every = keys.withColumn("name", F.lit(None).cast("string")).unionByName(new)
    return every.groupBy("key").agg(F.min_by(F.struct("id", "at", "name"), F.struct(F.col("at").isNotNull(), F.coalesce("ord", "at"))).alias("x")).select("key", "x.*")


def _added(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return nodes.unionByName(new, allowMissingColumns=True)


def upsert_topics(held: Graph, specs: DataFrame) -> Graph:
    """Topics (name, summary, parent, ord): known ones by name get the summary, if there is one, others are made; a parent that there is
    by then, other than the topic itself, becomes its parent, with an edge for each parent it ever had."""
    specs = specs.select(text.strip(F.col("name")).alias("name"), _key("name").alias("key"), F.coalesce("summary", F.lit("")).alias("summary"), text.strip(F.coalesce("parent", F.lit(""))).alias("parent"), F.col("ord").alias("at"))
    known = graph.cut(_topics(held.nodes, specs.select("key", "name", "at")))
    own = specs.join(known.select("key", F.col("id")), "key")
    up = known.select(F.col("key").alias("pk"), F.col("id").alias("up"), F.col("at").alias("made"))
    # a parent is named by its id as it is, or by its name in any case
    exact, folded = (own.where("parent <> ''").withColumn("pk", c).join(up, "pk").where("made is null or made <= at").where("up <> id") for c in (F.col("parent"), F.lower("parent")))
    under = exact.unionByName(folded).groupBy("id", "at").agg(F.min("up").alias("up"))
    last = own.groupBy("id").agg(F.max_by("summary", F.when(F.col("summary") != "", F.col("at"))).alias("__said"))
    parent = under.groupBy("id").agg(F.max_by("up", "at").alias("__up"))
    new = known.where("at is not null").select("id", F.lit("topic").alias("type"), F.lit(4).alias("layer"), "name", F.lit("").alias("summary"), F.col("at").alias("ord")).dropDuplicates(["id"])
    nodes = _added(held.nodes, new).join(last, "id", "left").join(parent, "id", "left")
    nodes = nodes.withColumns({"summary": F.coalesce("__said", "summary"), "parent_id": F.coalesce("__up", "parent_id")}).drop("__said", "__up")
    edges = under.select(F.col("id").alias("src"), F.col("up").alias("dst"), F.lit("subtopic_of").alias("kind"), F.lit("subtopic of").alias("label")).distinct().join(held.edges.where("kind = 'subtopic_of'").select("src", "dst"), ["src", "dst"], "left_anti")
    return Graph(nodes, held.edges.unionByName(edges.select("src", "dst", "kind", "label"), allowMissingColumns=True))


def _entities(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): the entity of each name, by its keys or by the id that the name would have; null for none."""
    keys = graph.cut(graph.keys_of(nodes.where("type = 'entity'")))
    asked = names.select("name").distinct().withColumns({"key": _key("name"), "slug": F.concat(F.lit("entity_"), text.slug(F.col("name")))})
    by_slug = keys.withColumnsRenamed({"key": "slug", "id": "__by_slug"})
    return asked.join(keys, "key", "left").join(by_slug, "slug", "left").select("name", F.coalesce("id", "__by_slug").alias("id"))


def add_relations(held: Graph, rows: DataFrame) -> Graph:
    """Relations (source, target, predicate, confidence, ord). Ends that are no entity become concepts, one for each id that names
    make; an edge with the same ends and label, of any kind, is not added again, nor one from an entity to itself."""
    ends = rows.select(F.explode(F.array("source", "target")).alias("name"), "ord")
    known = graph.cut(_entities(held.nodes, ends))
    slug = F.concat(F.lit("entity_"), text.slug(F.col("name")))
    missing = ends.join(known.where("id is null").select("name"), "name").withColumn("id", slug).where("id <> 'entity_'")
    new = missing.groupBy("id").agg(F.min_by(text.strip(F.col("name")), "ord").alias("name"), F.min("ord").alias("ord"))
    new = new.select("id", F.lit("entity").alias("type"), F.lit(3).alias("layer"), "name", F.lit("concept").alias("kind"), F.array().cast("array<string>").alias("aliases"), F.lit(3).alias("importance"), F.lit(1).cast("long").alias("mentions"), F.lit("").alias("summary"), "ord")
    ids = known.select("name", F.coalesce("id", slug).alias("id")).where("id <> 'entity_'")
    made = rows.join(ids.withColumnsRenamed({"name": "source", "id": "src"}), "source").join(ids.withColumnsRenamed({"name": "target", "id": "dst"}), "target").where("src <> dst")
    made = made.groupBy("src", "dst", F.col("predicate").alias("label")).agg(F.min_by("confidence", "ord").alias("confidence")).withColumn("kind", F.lit("relation"))
    made = made.join(held.edges.select("src", "dst", "label"), ["src", "dst", "label"], "left_anti")
    return Graph(_added(held.nodes, new), held.edges.unionByName(made.select("src", "dst", "kind", "label", "confidence"), allowMissingColumns=True))


def add_syntheses(held: Graph, rows: DataFrame) -> Graph:
    """Syntheses (name, path, abstract, covers, ord) by the id of their name: the last path, the last abstract that says something,
    the first name; and an edge to each entity or else topic that they cover, once."""
    rows = rows.withColumn("id", F.concat(F.lit("synthesis_"), text.slug(F.col("name"))))
    said = rows.groupBy("id").agg(F.min_by(text.strip(F.col("name")), "ord").alias("name"), F.max_by("path", "ord").alias("__path"), F.max_by("abstract", F.when(F.col("abstract") != "", F.col("ord"))).alias("__abstract"), F.min("ord").alias("ord"))
    new = said.join(held.nodes.select("id"), "id", "left_anti").select("id", F.lit("synthesis").alias("type"), F.lit(5).alias("layer"), "name", F.lit("").alias("abstract"), "ord")
    nodes = _added(held.nodes, new).join(said.select("id", "__path", "__abstract"), "id", "left")
    nodes = nodes.withColumns({"path": F.coalesce("__path", "path"), "abstract": F.coalesce("__abstract", "abstract")}).drop("__path", "__abstract")
    asked = rows.select("id", F.explode("covers").alias("name"))
    topic = held.nodes.where("type = 'topic'").groupBy(F.lower("name").alias("key")).agg(F.min_by("id", "ord").alias("topic"))
    to = asked.join(_entities(held.nodes, asked).withColumnRenamed("id", "entity"), "name").withColumn("key", F.lower("name")).join(topic, "key", "left")
    edges = to.select(F.col("id").alias("src"), F.coalesce("entity", "topic").alias("dst"), F.lit("covers").alias("kind"), F.lit("covers").alias("label")).where("dst is not null").distinct()
    edges = edges.join(held.edges.where("kind = 'covers'").select("src", "dst"), ["src", "dst"], "left_anti")
    return Graph(nodes, held.edges.unionByName(edges.select("src", "dst", "kind", "label"), allowMissingColumns=True))


def backfill(cache: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """The cache (id, source_url, raw_text, content_hash, in_kg, kg_chunk_ids, kg_projected_hash, vectorized, vector_projected_hash) with
    what graph (id, type, url, text, ord) and vectors (url, text, ord) know of addresses. Items that there are only get flags, with
    the hash of their own text; addresses without one become items with the texts of their chunks, the graph's before the
    vectors'; those without any text, and those of the cache itself, are left out. ``outcome``: kept, updated or created."""
    address = lambda rows: rows.withColumn("url", text.strip(F.coalesce("url", F.lit("")))).where("url <> '' and not startswith(url, 'cache:')")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("ord", "text")))), lambda x: x["text"]), "\n\n").alias(c)
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "chunk", F.struct("ord", "id")))), lambda x: x["id"])
    kg = address(nodes.where("type in ('source', 'chunk')")).groupBy("url").agg(F.lit(True).alias("kg"), ids.alias("ids"), joined("kg_text"))
    vec = address(vectors).groupBy("url").agg(F.lit(True).alias("vec"), joined("vec_text"))
    found = kg.join(vec, "url", "full_outer").select("url", F.coalesce("kg", F.lit(False)).alias("kg"), F.coalesce("vec", F.lit(False)).alias("vec"), "ids", F.coalesce(F.nullif("kg_text", F.lit("")), "vec_text", F.lit("")).alias("text"), F.concat(F.lit("cache_"), F.substring(F.sha2("url", 256), 1, 16)).alias("id"))
    both = cache.join(found.withColumnRenamed("text", "__text"), "id", "full_outer").where(F.col("content_hash").isNotNull() | (text.strip(F.col("__text")) != ""))
    had, kg_, vec_ = F.col("content_hash").isNotNull(), F.coalesce("kg", F.lit(False)), F.coalesce("vec", F.lit(False))
    hash_ = F.coalesce("content_hash", F.sha2("__text", 256))
    return both.select(
        "id", F.coalesce("source_url", "url").alias("source_url"), F.coalesce("raw_text", "__text").alias("raw_text"), hash_.alias("content_hash"), (kg_ | F.coalesce("in_kg", F.lit(False))).alias("in_kg"),
        F.when(kg_, F.col("ids")).otherwise(F.coalesce("kg_chunk_ids", F.array().cast("array<string>"))).alias("kg_chunk_ids"), F.when(kg_, hash_).otherwise(F.coalesce("kg_projected_hash", F.lit(""))).alias("kg_projected_hash"),
        (vec_ | F.coalesce("vectorized", F.lit(False))).alias("vectorized"), F.when(vec_, hash_).otherwise(F.coalesce("vector_projected_hash", F.lit(""))).alias("vector_projected_hash"),
        F.when(~had, "created").when(kg_ | vec_, "updated").otherwise("kept").alias("outcome"),
    )
