"""Integration: staged chunks and what was extracted from them become sources, entities and edges of the graph.

Whether a name is a new entity or one that is known depends on what was named before it, so the rules are about order:
a name stands for the entity that first had it as a name or an alias. As tables that is a forest. Each name has at most one
pointer, to the name of the mention that gave it as an alias before it was a name itself; pointers lead to earlier mentions
only, so following them by doubling ends at a name of its own or at an entity of the graph. Sources are found likewise, by
address or title, in rounds: a pair of both that no earlier undecided one could have made makes a source.

Tables: nodes (id, type, layer, name, kind, aliases, importance, mentions, summary, title, url, ord), edges (src, dst, kind,
label, confidence, chunk_id); staged chunks (id, source_title, source_url, ord), entities (chunk_id, pos, name, kind, aliases,
importance, summary, confidence), relations (chunk_id, pos, source, target, predicate, confidence). Running again changes
nothing: chunks that the graph has are left out with all that was extracted from them, and edges that it has are not added.
Of staged rows with one id the first counts. Names without a letter or digit of ASCII are no entities. Aliases are kept in order of code points.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import chunking, graph

#: The kinds of entities; others count as concepts.
KINDS = ("person", "organization", "place", "concept", "technology", "method", "event", "product")
NEW, INFERRED = "EXTRACTED", "INFERRED"


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def _clean(c: str | Column) -> Column:
    return text.strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def sources_of(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(url, title, made, id, at): for each (url, title, ord) the source it belongs to, among ``known`` (id, url, title, ord) and
    those that pairs make; ``made`` where it is the first of one."""
    keys = lambda url, title: F.filter(F.array(F.concat(F.lit("u"), url), F.concat(F.lit("t"), title)), lambda k: F.length(k) > 1)
    wanted = pairs.select("url", "title", "ord", F.explode(keys(F.col("url"), F.col("title"))).alias("key"))
    offered = lambda rows: rows.select("url", "title", "ord", F.explode(keys(F.col("url"), F.coalesce(F.nullif("title", F.lit("")), F.col("url")))).alias("key"))
    had = known.select("id", "ord", F.explode(keys(F.col("url"), F.col("title"))).alias("key"))
    open_ = graph.cut(pairs.join(wanted.join(had, "key", "left_semi"), ["url", "title"], "left_anti"))
    makers = None
    while not open_.isEmpty():
        least = offered(open_).groupBy("key").agg(F.min("ord").alias("first"))
        own = wanted.join(open_.select("url", "title"), ["url", "title"], "left_semi")
        later = own.join(least, "key").where("first < ord").select("url", "title").distinct()
        made = graph.cut(open_.join(later, ["url", "title"], "left_anti"))
        makers = made if makers is None else graph.cut(makers.unionByName(made))
        taken = own.join(offered(made).select("key", F.col("ord").alias("maker")), "key").where("maker < ord").select("url", "title").distinct()
        open_ = graph.cut(open_.join(made, ["url", "title"], "left_anti").join(taken, ["url", "title"], "left_anti"))
    slug = text.slug(F.coalesce(F.nullif("url", F.lit("")), F.col("title")))
    full = F.sha2(F.concat_ws("\n", "url", "title"), 256)
    makers = pairs.where("false") if makers is None else makers
    named = makers.withColumn("slug", F.coalesce(F.nullif(slug, F.lit("")), F.substring(full, 1, 8))).withColumn("k", F.row_number().over(Window.partitionBy("slug").orderBy("ord")))
    taken = known.select("id", F.lit(True).alias("taken"))
    named = named.withColumn("id", F.concat(F.lit("source_"), "slug")).join(taken, "id", "left")
    new = named.select(F.when((F.col("k") == 1) & F.col("taken").isNull(), F.col("id")).otherwise(F.concat(F.lit("source_"), F.substring(full, 1, 10))).alias("id"), "url", "title", "ord")
    new = graph.cut(new)
    every = had.select("key", "id", F.struct(F.lit(0).alias("new"), "ord").alias("at")).unionByName(offered(new).join(new, ["url", "title", "ord"]).select("key", "id", F.struct(F.lit(1).alias("new"), "ord").alias("at")))
    before = (F.col("at.new") == 0) | (F.col("at.ord") <= F.col("ord"))
    first = wanted.join(every, "key").where(before).groupBy("url", "title").agg(F.min_by("id", "at").alias("id"))
    # a source of an address alone is its own, though nothing looks for that address as a title
    return first.join(new.select("url", "title", F.col("ord").alias("at")), ["url", "title"], "left").select("url", "title", F.col("at").isNotNull().alias("made"), "id", "at")


def resolved(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, entity_id, fresh): the entity of each name (lower case) of mentions (at, key, name, aliases), in their order."""
    named = events.groupBy("key").agg(F.min("at").alias("at"), F.min_by("name", "at").alias("name"))
    given = events.select("at", F.col("key").alias("owner"), F.explode("aliases").alias("alias")).select("at", "owner", F.lower(_clean("alias")).alias("key")).where("key <> ''")
    given = given.groupBy("key").agg(F.min_by("owner", "at").alias("owner"), F.min("at").alias("given"))
    known = graph.keys_of(nodes.where("type = 'entity'")).withColumnRenamed("id", "known")
    heads = graph.cut(named.join(given, "key", "left").join(known, "key", "left"))
    up = F.col("known").isNull() & F.col("owner").isNotNull() & (F.col("given") < F.col("at"))
    ends = graph.follow(heads.where(up).select(F.col("key").alias("x"), F.col("owner").alias("up")))
    roots = heads.where(~up | up.isNull())
    slug = text.slug(F.col("name"))
    fresh = roots.where("known is null").withColumn("slug", slug).withColumn("k", F.row_number().over(Window.partitionBy("slug").orderBy("at")))
    fresh = fresh.withColumn("id", F.concat(F.lit("entity_"), "slug")).join(nodes.select("id", F.lit(True).alias("taken")), "id", "left")
    plain = (F.col("k") == 1) & F.col("taken").isNull()
    fresh = fresh.select("key", F.when(plain, F.col("id")).otherwise(F.concat("id", F.lit("-"), F.substring(F.sha2("key", 256), 1, 4))).alias("entity_id"), F.lit(True).alias("fresh"))
    own = graph.cut(fresh.unionByName(roots.where("known is not null").select("key", F.col("known").alias("entity_id"), F.lit(False).alias("fresh"))))
    return own.unionByName(ends.join(own, F.col("end") == F.col("key")).select(F.col("x").alias("key"), "entity_id", "fresh"))


def mentions_of(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Mentions in order: a chunk's entities, then those ends of its relations that are none of them, each once."""
    at = lambda phase, *more: F.struct(F.col("ord").cast("long").alias("chunk"), F.lit(phase).alias("phase"), *(x.cast("long").alias(f"p{i}") for i, x in enumerate(more)))
    order = chunks.select(F.col("id").alias("chunk_id"), "ord")
    none = F.array().cast("array<string>")
    named = entities.join(order, "chunk_id").select(
        "chunk_id", at(0, F.col("pos"), F.lit(0)).alias("at"), _clean("name").alias("name"), "kind", F.coalesce("aliases", none).alias("aliases"), "importance", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce(F.nullif("confidence", F.lit("")), F.lit(NEW)).alias("confidence"), F.lit(True).alias("listed"),
    )
    named = named.where(text.slug(F.col("name")) != "").withColumn("key", F.lower("name"))
    ends = relations.join(order, "chunk_id").select("chunk_id", "ord", "pos", _clean("source").alias("s"), _clean("target").alias("t")).where("s <> '' and t <> ''")
    ends = ends.select("chunk_id", "ord", "pos", F.posexplode(F.array("s", "t")).alias("end", "name")).where(text.slug(F.col("name")) != "").withColumn("key", F.lower("name")).withColumn("at", at(1, F.col("pos"), F.col("end")))
    ends = ends.groupBy("chunk_id", "key").agg(F.min("at").alias("at"), F.min_by("name", "at").alias("name")).join(named.select("chunk_id", "key").distinct(), ["chunk_id", "key"], "left_anti")
    return named.unionByName(ends.select(
        "chunk_id", "at", "name", F.lit("concept").alias("kind"), none.alias("aliases"), F.lit(None).cast("int").alias("importance"), F.lit("").alias("summary"), F.lit(INFERRED).alias("confidence"), F.lit(False).alias("listed"), "key",
    ))


def add_extractions(held: Graph, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> Graph:
    """The graph with the entities and relations extracted from ``chunks`` (id, ord), which it has or is about to get.

    A mention of a known entity counts, raises its importance, names its kind if that was a mere concept, leaves a longer
    summary and adds aliases. Edges of mentions and relations are there once; a relation to itself is none."""
    events = graph.cut(mentions_of(chunks, entities, relations))
    keys = graph.cut(resolved(events, held.nodes))
    own = events.join(keys, "key")
    valid = F.when(F.col("importance").between(1, 5), F.col("importance"))
    concrete = F.when(F.col("kind").isin(*KINDS) & (F.col("kind") != "concept"), F.col("at"))
    gain = own.groupBy("entity_id", "fresh").agg(
        F.count("*").alias("gain"), F.max(valid).alias("most"), F.min_by("kind", concrete).alias("said"), F.min_by("summary", F.struct(-F.length("summary"), F.col("at"))).alias("longest"),
        F.min_by(F.struct("name", valid.alias("importance"), "at"), "at").alias("first"),
    )
    aliases = own.select("entity_id", F.explode("aliases").alias("alias")).select("entity_id", _clean("alias").alias("alias")).where("alias <> ''").groupBy("entity_id").agg(F.collect_set("alias").alias("new_aliases"))
    gain = gain.join(aliases, "entity_id", "left").withColumn("new_aliases", F.coalesce("new_aliases", F.array().cast("array<string>")))
    others = lambda names, name: F.array_sort(F.array_distinct(F.filter(names, lambda a: F.lower(a) != F.lower(name))))
    old = held.nodes.join(gain.where("not fresh").withColumnRenamed("entity_id", "id"), "id", "left")
    met = F.col("gain").isNotNull()
    old = old.withColumns({
        "mentions": F.col("mentions") + F.coalesce("gain", F.lit(0)), "importance": F.greatest(F.col("importance"), F.col("most")),
        "kind": F.when(met & (F.coalesce("kind", F.lit("concept")) == "concept"), F.coalesce("said", "kind")).otherwise(F.col("kind")),
        "summary": F.when(met & (F.length("longest") > F.length(F.coalesce("summary", F.lit("")))), F.col("longest")).otherwise(F.col("summary")),
        "aliases": F.when(met, F.array_sort(F.array_union("aliases", F.filter("new_aliases", lambda a: F.lower(a) != F.lower(F.col("name")))))).otherwise(F.col("aliases")),
    }).select(held.nodes.columns)
    ordinal = F.col("first.at.chunk") + 0
    fresh = gain.where("fresh").select(
        F.col("entity_id").alias("id"), F.lit("entity").alias("type"), F.lit(3).alias("layer"), F.col("first.name").alias("name"), F.coalesce("said", F.lit("concept")).alias("kind"), others(F.col("new_aliases"), F.col("first.name")).alias("aliases"),
        F.greatest(F.coalesce("first.importance", F.lit(3)), F.col("most")).alias("importance"), F.col("gain").alias("mentions"), F.col("longest").alias("summary"), ordinal.alias("ord"),
    )
    ids = keys.select("key", "entity_id")
    listed = own.where("listed").groupBy(F.col("chunk_id").alias("src"), F.col("entity_id").alias("dst")).agg(F.min_by("confidence", "at").alias("confidence"))
    listed = listed.select("src", "dst", F.lit("mentions").alias("kind"), F.lit("mentions").alias("label"), "confidence", F.col("src").alias("chunk_id"))
    listed = listed.join(held.edges.where("kind = 'mentions'").select("src", "dst"), ["src", "dst"], "left_anti")
    rel = relations.join(chunks.select(F.col("id").alias("chunk_id"), "ord"), "chunk_id").withColumns({"s": F.lower(_clean("source")), "t": F.lower(_clean("target"))})
    rel = rel.join(ids.withColumnsRenamed({"key": "s", "entity_id": "src"}), "s").join(ids.withColumnsRenamed({"key": "t", "entity_id": "dst"}), "t").where("src <> dst")
    label = text.strip(F.coalesce(F.nullif("predicate", F.lit("")), F.lit("related to")))
    rel = rel.groupBy("src", "dst", label.alias("label")).agg(F.min_by(F.struct(F.coalesce(F.nullif("confidence", F.lit("")), F.lit(NEW)).alias("c"), "chunk_id"), F.struct("ord", "pos")).alias("x"))
    rel = rel.select("src", "dst", F.lit("relation").alias("kind"), "label", F.col("x.c").alias("confidence"), F.col("x.chunk_id").alias("chunk_id")).join(held.edges.where("kind = 'relation'").select("src", "dst", "label"), ["src", "dst", "label"], "left_anti")
    edges = held.edges.unionByName(listed.select(held.edges.columns), allowMissingColumns=True).unionByName(rel.select(held.edges.columns), allowMissingColumns=True)
    return Graph(old.unionByName(fresh, allowMissingColumns=True), edges)


def integrate(staged: DataFrame, entities: DataFrame, relations: DataFrame, held: Graph) -> Graph:
    """The graph after the staged chunks that it lacks: their sources, the chunks, and what was extracted from them."""
    chunks = staged.groupBy("id").agg(F.min("ord").alias("ord"), F.min_by(F.struct(_clean("source_title").alias("title"), _clean("source_url").alias("url")), "ord").alias("s"))
    chunks = graph.cut(chunks.join(held.nodes.where("type = 'chunk'").select("id"), "id", "left_anti").select("id", "ord", "s.title", "s.url"))
    pairs = graph.cut(chunks.where("title <> '' or url <> ''").groupBy("url", "title").agg(F.min("ord").alias("ord")))
    known = held.nodes.where("type = 'source'").select("id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "ord")
    source = graph.cut(sources_of(pairs, known))
    made = source.where("made").select("id", F.lit("source").alias("type"), F.lit(0).alias("layer"), F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("title"), "url", F.col("at").alias("ord"))
    placed = chunks.join(source.select("url", "title", F.col("id").alias("source_id")), ["url", "title"], "left")
    own = placed.select("id", F.lit("chunk").alias("type"), F.lit(2).alias("layer"), F.col("title"), F.col("url"), "ord")
    came = placed.where("source_id is not null").select(F.col("id").alias("src"), F.col("source_id").alias("dst"), F.lit("from_source").alias("kind"), F.lit("from source").alias("label"), F.lit(NEW).alias("confidence"), F.lit(None).cast("string").alias("chunk_id"))
    came = came.join(held.edges.where("kind = 'from_source'").select("src", "dst"), ["src", "dst"], "left_anti")
    nodes = held.nodes.unionByName(made, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)
    return add_extractions(Graph(nodes, held.edges.unionByName(came.select(held.edges.columns))), chunks, entities, relations)


def heuristic_extractions(chunks: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """Entities of chunks (chunk_id, pos, name, ...) by rule of thumb, for each of a long chunk's parts, in their order."""
    parts = chunks.select(key, F.posexplode(chunking.sub_chunks(F.col(column))).alias("part", "own")).select(F.struct(F.col(key).alias("id"), "part").alias("piece"), "own")
    found = graph.heuristic_entities(parts, "piece", "own")
    return found.select(
        F.col("piece.id").alias("chunk_id"), (F.col("piece.part") * 100 + F.col("place")).alias("pos"), "name", F.lit("concept").alias("kind"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("int").alias("importance"), F.lit("").alias("summary"), F.lit(NEW).alias("confidence"),
    )


def drain(staging, nodes, edges, extract=heuristic_extractions, relations=None) -> Graph:
    """Integrate versioned tables: what is staged goes into the graph's two, then the staging table is empty. If it fails before
    that, the next run finds the chunks in the graph and adds nothing again."""
    staged, held = staging.read(), Graph(nodes.read(), edges.read())
    none = staged.sparkSession.createDataFrame([], "chunk_id string, pos long, source string, target string, predicate string, confidence string")
    out = integrate(staged, extract(staged), relations(staged) if relations else none, held)
    # chunks last: they are what says that a batch is done, so edges are written before the nodes
    out = Graph(graph.cut(out.nodes), graph.cut(out.edges))
    edges.write(out.edges)
    nodes.write(out.nodes)
    staging.clear()
    return out
