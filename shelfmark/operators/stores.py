"""Keyed stores: cache, memory, skills and run log as tables with explicit keys and order.

Every change is a new table from the old one (an anti-join with a union, or a join with conditions); ``VersionedTable`` in
``sources`` publishes it without touching what readers hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, vector
from . import graph, vectors

KEPT_RUNS = 500
STATUS_ORDER = ("pending_review", "accepted", "needs_revision", "draft", "rejected")
SEMANTIC_FLOOR, KEYWORD_FLOOR, DUPLICATE, KEYWORD_DUPLICATE = 0.20, 0.05, 0.92, 0.9


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace those of their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that came last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def set_flags(rows: DataFrame, where: Column, **flags: Column) -> DataFrame:
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in flags.items()})


def last_rows(log: DataFrame, n: int = KEPT_RUNS, order: str = "ord") -> DataFrame:
    """A bounded log: the n rows added last, by position."""
    return log.orderBy(F.desc(order)).limit(n)


def appended(log: DataFrame, new: DataFrame, n: int = KEPT_RUNS, order: str = "ord") -> DataFrame:
    """The log with new rows after its own, cut to the n added last."""
    both = log.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.orderBy(F.desc("__new"), F.desc(order)).limit(n).drop("__new")


def kept_of_each(log: DataFrame, key: str, n: int, order: str = "ord") -> DataFrame:
    """Of each key the n rows added last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


#: what leaves the store: neither whole bodies nor vectors
PUBLIC = ("id", "kind", "source_url", "source_title", "chars", "content_hash", "in_kg", "vectorized", "kg_projected_hash", "vector_projected_hash")


def public(items: DataFrame) -> DataFrame:
    return items.select(*(c for c in PUBLIC if c in items.columns), F.substring("raw_text", 1, 240).alias("preview"))


def projected(items: DataFrame, results: DataFrame, flag: str, hash_: str) -> DataFrame:
    """Items with the results (cache_id, ok) of a projection: where it went well the flag is on with the hash that went in,
    which is the input's and not what the item holds by now. The last result of an item counts; others stay as they are."""
    done = results.where("ok").groupBy(F.col("cache_id").alias("id")).agg(F.max_by("input_hash", "at").alias("__hash"))
    joined = items.join(done, "id", "left")
    return joined.withColumns({flag: F.col("__hash").isNotNull() | F.col(flag), hash_: F.coalesce("__hash", hash_)}).drop("__hash")


def ingest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent ingest of (id, content_hash, raw_text): what is there stays, a changed body is refreshed, flags of
    projections stay with the old row so that they can be seen to be stale. ``outcome``: created, unchanged or changed."""
    n = new.select("id", F.col("content_hash").alias("new_hash"), F.col("raw_text").alias("new_text"))
    both = old.join(n, "id", "full_outer")
    changed = F.col("new_hash").isNotNull() & F.col("content_hash").isNotNull() & (F.col("new_hash") != F.col("content_hash"))
    outcome = F.when(F.col("content_hash").isNull(), "created").when(changed, "changed").otherwise("unchanged")
    take = F.col("content_hash").isNull() | changed
    return both.select(
        "id", F.when(take, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(take, F.col("new_text")).otherwise(F.col("raw_text")).alias("raw_text"),
        F.coalesce("in_kg", F.lit(False)).alias("in_kg"), F.coalesce("vectorized", F.lit(False)).alias("vectorized"),
        F.coalesce("kg_projected_hash", F.lit("")).alias("kg_projected_hash"), F.coalesce("vector_projected_hash", F.lit("")).alias("vector_projected_hash"), outcome.alias("outcome"),
    )


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, columns of ``new``, change): the rows added, changed or gone between two versions of a table; those that are gone have
    nulls. Keys are unique and not null; values are compared as they are, null like null."""
    values = [c for c in new.columns if c != key]
    both = old.select(key, F.struct(*values).alias("__old")).join(new.select(key, F.struct(*values).alias("__new")), key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "gone").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(key, *(F.col(f"__new.{c}").alias(c) for c in values), "change")


def with_changes(old: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """The version that ``changes`` led to."""
    return old.join(change.select(key), key, "left_anti").unionByName(change.where("change <> 'gone'").select(old.columns))


def stale(flag: str, projected: str) -> Column:
    return F.col(flag) & (F.coalesce(F.col(projected), F.lit("")) != F.col("content_hash"))


def projection_url(url: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(text.strip(url), F.lit("")), F.concat(F.lit("cache:"), key))


def list_items(items: DataFrame, *, in_kg: bool | None = None, vectorized: bool | None = None, q: str = "", limit: int = 0, order: str = "ord") -> DataFrame:
    """Newest first; None asks for both; the words are looked for literally in title and url, in any case; 0 is no limit."""
    if in_kg is not None:
        items = items.where(F.col("in_kg") == in_kg)
    if vectorized is not None:
        items = items.where(F.col("vectorized") == vectorized)
    if q:
        items = items.where(F.contains(F.lower(F.concat_ws("\n", "source_title", "source_url")), F.lit(q.lower())))
    items = items.orderBy(F.desc(order))
    return items.limit(limit) if limit else items


def active(memories: DataFrame) -> DataFrame:
    return memories.where(F.coalesce("superseded_by", F.lit("")) == "")


def memory_score(similarity: Column, salience: Column, updated: Column, now: Column) -> Column:
    return similarity + 0.04 * (salience - 3) + 0.02 * dates.recency(updated, now)


def recall(memories: DataFrame, query: str, k: int, now: Column, floor: float = KEYWORD_FLOOR) -> DataFrame:
    """The k best by blended score; the floor on similarity applies to those k, not before."""
    sim = text.keyword_similarity(F.lit(query), F.col("text"))
    scored = active(memories).withColumn("similarity", sim).withColumn("score", F.round(memory_score(sim, F.col("salience"), F.col("updated_at"), now), 9))
    return scored.orderBy(F.desc("score"), "ord").limit(k).where(F.col("similarity") >= floor)


def meeting(own: DataFrame, old: DataFrame, least: float) -> DataFrame:
    """(new_id, id, kind): pairs of ``own`` (new_id, kind, q) and ``old`` (id, kind, w) of about as many keywords that share one of the
    rarest of each."""
    counts = old.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, key: str, words: str) -> DataFrame:
        # an id may have several texts
        ranked = rows.select(key, "kind", F.size(words).alias(f"{words}_size"), F.xxhash64(words).alias("h"), F.explode(words).alias("word")).join(counts, "word")
        ranked = ranked.groupBy(key, "kind", f"{words}_size", "h").agg(F.array_sort(F.collect_set(F.struct("n", "word"))).alias("x"))
        return ranked.select(key, "kind", f"{words}_size", F.explode(F.slice("x", 1, (F.ceil(F.col(f"{words}_size") * (1 - least)) + 1).cast("int"))["word"]).alias("word"))

    near = F.greatest("q_size", "w_size") * least <= F.least("q_size", "w_size") + 1e-6
    return rarest(own, "new_id", "q").join(rarest(old, "id", "w"), ["word", "kind"]).where(near & (F.col("id") != F.col("new_id"))).select("new_id", "id", "kind").distinct()


def near_duplicates(incoming: DataFrame, memories: DataFrame, least: float = KEYWORD_DUPLICATE, best: bool = True) -> DataFrame:
    """(new_id, id, similarity): for each new memory the active one of its kind that says the same in both directions; not
    only the ``best``: all, with ord.

    Texts that are like have about as many keywords, and share one of the rarest tenth (and one) of each, in an order that is
    the same for both; so these words alone meet, and only pairs that share one are held against all keywords.
    """
    own = incoming.select(F.col("id").alias("new_id"), "kind", text.keywords(F.col("text")).alias("q")).distinct()
    old = active(memories).select("id", "kind", "ord", text.keywords(F.col("text")).alias("w")).distinct()
    both = meeting(own, old, least).join(own, ["new_id", "kind"]).join(old, ["id", "kind"])
    shared = F.size(F.array_intersect("q", "w"))
    fine = both.select("new_id", "id", "ord", (shared / F.size("q")).alias("similarity"), (shared / F.size("w")).alias("back")).where((F.col("similarity") >= least) & (F.col("back") >= least)).drop("back").distinct()
    if not best:
        return fine.select("new_id", "id", "ord", "similarity")
    order = Window.partitionBy("new_id").orderBy(F.desc("similarity"), "ord")
    return fine.withColumn("k", F.row_number().over(order)).where("k = 1").select("new_id", "id", F.round("similarity", 6).alias("similarity"))


def near_by_vector(incoming: DataFrame, memories: DataFrame, least: float = DUPLICATE, compared=None) -> DataFrame:
    """(new_id, id, ord, similarity): pairs of a new memory and an active one, of any kind, whose vectors' cosine reaches ``least``.
    New memories come in batches, which meet the store where it is read; ``compared`` counts whole products."""
    new = incoming.where("embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("qv"))
    old = active(memories).where("embedding is not null").select("id", "ord", "embedding")
    return vectors.within(old, new, least, compared=compared).where(F.col("id") != F.col("query_id")).select(F.col("query_id").alias("new_id"), "id", "ord", F.col("sim").alias("similarity"))


def matches(incoming: DataFrame, memories: DataFrame) -> DataFrame:
    """(new_id, id, ord, similarity): every active memory that a new one repeats. Where both have vectors these decide, of any
    kind; else the keywords of memories of one kind, in both directions."""
    new = incoming.where("embedding is not null").select(F.col("id").alias("new_id"), F.lit(True).alias("__new")).distinct()
    old = memories.where("embedding is not null").select("id", F.lit(True).alias("__old")).distinct()
    by_words = near_duplicates(incoming, memories, best=False).join(new, "new_id", "left").join(old, "id", "left")
    plain = by_words.where("__new is null or __old is null").select("new_id", "id", "ord", "similarity")
    return plain.unionByName(near_by_vector(incoming, memories))


def duplicates(incoming: DataFrame, memories: DataFrame) -> DataFrame:
    """(new_id, id, similarity): the active memory that a new one repeats: the most similar counts, the first of equals."""
    order = Window.partitionBy("new_id").orderBy(F.desc(F.round("similarity", 9)), "ord")
    return matches(incoming, memories).withColumn("k", F.row_number().over(order)).where("k = 1").select("new_id", "id", F.round("similarity", 6).alias("similarity"))


def first_of_like(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id): the items (id, ord) that are kept if each, in order, is dropped where it is like an earlier kept one; ``pairs``
    (id, ord, like, like_ord) has an item and an earlier one. In rounds: what no undecided earlier one is like is kept, what
    is like a kept one is dropped; every round decides at least the first of all that are undecided."""
    open_, kept = graph.cut(items.select("id")), None
    pairs = graph.cut(pairs.select("id", "like"))
    while not open_.isEmpty():
        waiting = pairs.join(open_, "id", "left_semi").join(open_.withColumnRenamed("id", "like"), "like", "left_semi").select("id").distinct()
        new = graph.cut(open_.join(waiting, "id", "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
        gone = pairs.join(new.withColumnRenamed("id", "like"), "like", "left_semi").select("id").distinct()
        open_ = graph.cut(open_.join(new, "id", "left_anti").join(gone, "id", "left_anti"))
    return kept if kept is not None else items.where("false").select("id")


def remember(incoming: DataFrame, memories: DataFrame, rank) -> DataFrame:
    """The store after new memories (id, ord, kind, text, salience, confidence, tags, embedding), taken one after another: one that
    repeats an active memory, of the store or of those just added, reinforces the most similar (the store's before new ones,
    then the first); salience and confidence only rise, tags are joined; others are added, blank texts are neither.
    New memories of one kind and text are compared once, and a repeat of one that was added reinforces it."""
    conf = F.upper(F.coalesce("confidence", F.lit("INFERRED")))
    new = incoming.where(text.strip(F.coalesce("text", F.lit(""))) != "").withColumn("confidence", conf)
    first = graph.cut(new.groupBy("kind", "text").agg(F.min_by(F.struct("id", "ord", "embedding"), "ord").alias("x")).select("x.*", "kind", "text"))
    stored = graph.cut(matches(first, memories))
    fresh = first.join(stored.select(F.col("new_id").alias("id")), "id", "left_anti")
    among = matches(first, first.withColumn("superseded_by", F.lit(""))).join(first.select(F.col("id").alias("new_id"), F.col("ord").alias("new_ord")), "new_id")
    among = graph.cut(among)
    added = graph.cut(first_of_like(fresh, among.where("ord < new_ord").select(F.col("new_id").alias("id"), F.col("id").alias("like"))).join(first.select("id", "ord"), "id"))
    # what a text is like: the store's, of new ones those that were added, and itself if it was
    like = stored.select("new_id", "id", "ord", "similarity", F.lit(0).alias("late")).unionByName(among.join(added, "id", "left_semi").select("new_id", "id", "ord", "similarity", F.lit(1).alias("late")))
    like = like.unionByName(added.select(F.col("id").alias("new_id"), "id", "ord", F.lit(1.0).alias("similarity"), F.lit(1).alias("late")))
    like = like.select("new_id", F.col("id").alias("old"), F.col("ord").alias("old_ord"), "similarity", "late")
    items = new.select("id", "ord", "kind", "text", "salience", "confidence", "tags").join(first.select("kind", "text", F.col("id").alias("new_id")), ["kind", "text"])
    told = items.join(added.select("id"), "id", "left_anti").join(like, "new_id").where((F.col("late") == 0) | (F.col("old_ord") < F.col("ord")))
    told = told.groupBy("id").agg(F.min_by("old", F.struct(-F.round("similarity", 9), F.col("late"), F.col("old_ord"))).alias("old"), F.first("ord").alias("ord"), F.first("salience").alias("salience"), F.first("confidence").alias("confidence"), F.first("tags").alias("tags"))
    told = graph.cut(told)
    gain = told.groupBy(F.col("old").alias("id")).agg(F.count("*").alias("gain"), F.max("salience").alias("new_salience"), F.max_by("confidence", F.struct(rank(F.col("confidence")), -F.col("ord"))).alias("new_confidence"))
    tags = told.select(F.col("old").alias("id"), "ord", F.posexplode("tags").alias("p", "tag")).groupBy("id", "tag").agg(F.min(F.struct("ord", "p")).alias("at"))
    tags = tags.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda z: z["tag"]).alias("new_tags"))
    columns = ["id", "ord", "kind", "text", "salience", "confidence", "tags", "reinforced"]
    every = memories.select(columns).unionByName(new.join(added.select("id"), "id", "left_semi").withColumn("reinforced", F.lit(0).cast("long")).select(columns))
    higher = F.col("new_confidence").isNotNull() & (rank(F.col("new_confidence")) > rank(F.col("confidence")))
    return every.join(gain, "id", "left").join(tags, "id", "left").select(
        "id", "ord", "kind", "text", F.greatest("salience", "new_salience").alias("salience"), F.when(higher, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.array_distinct(F.concat("tags", F.coalesce("new_tags", F.array().cast("array<string>")))).alias("tags"), (F.col("reinforced") + F.coalesce("gain", F.lit(0))).alias("reinforced"),
    )


def upsert_skills(skills: DataFrame, specs: DataFrame) -> DataFrame:
    """Skills (slug, id, description, version, revisions, status, history) after specs (slug, id, description, note, ord) in their
    order: the first of an unknown slug is a draft of version 1; each further one revises in place: a version and a revision more,
    its description, a draft again, and an entry in the history."""
    own = specs.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "description", "note"))).alias("s"))
    both = skills.join(own, "slug", "full_outer")
    new, base = F.col("version").isNull(), F.coalesce("version", F.lit(1))
    revising = F.when(new, F.slice("s", 2, F.greatest(F.size("s"), F.lit(1)))).otherwise(F.col("s"))
    steps = F.when(F.col("r").isNull(), 0).otherwise(F.size("r"))
    named = lambda x: F.when(x["note"] != "", F.concat(F.lit(": "), F.substring(x["note"], 1, 200))).otherwise("")
    numbers = F.when(steps > 0, F.sequence(base, base + steps - 1))
    line = F.zip_with(numbers, "r", lambda v, x: F.concat(F.lit("v"), v.cast("string"), F.lit(" → v"), (v + 1).cast("string"), named(x)))
    return both.withColumn("r", revising).select(
        "slug", F.coalesce("id", F.get(F.col("s"), F.lit(0))["id"]).alias("id"), F.when(F.col("s").isNull(), F.col("description")).otherwise(F.element_at("s", -1)["description"]).alias("description"),
        (base + steps).cast("long").alias("version"), (F.coalesce("revisions", F.lit(0)) + steps).cast("long").alias("revisions"),
        F.when(F.col("s").isNull(), F.col("status")).otherwise("draft").alias("status"), F.concat(F.coalesce("history", F.array().cast("array<string>")), F.coalesce(line, F.array().cast("array<string>"))).alias("history"),
    )


def reinforced(rows: DataFrame, salience: Column, confidence: Column, rank) -> DataFrame:
    """Salience and confidence only rise."""
    higher = rank(confidence) > rank(F.col("confidence"))
    return rows.withColumns({"salience": F.greatest("salience", salience), "confidence": F.when(higher, F.upper(confidence)).otherwise(F.col("confidence"))})


def feedback(rows: DataFrame, mark: Column) -> DataFrame:
    """up: one more, to 5, and CONFIRMED; down: one less, to 1; nothing else changes."""
    return rows.withColumns({
        "salience": F.when(mark == "up", F.least(F.lit(5), F.col("salience") + 1)).when(mark == "down", F.greatest(F.lit(1), F.col("salience") - 1)).otherwise(F.col("salience")),
        "confidence": F.when(mark == "up", "CONFIRMED").otherwise(F.col("confidence")),
    })


def record_feedback(memories: DataFrame, said: DataFrame, rank) -> DataFrame:
    """Memories (id, ord, kind, text, salience, confidence, tags, reinforced, superseded_by) after feedback (memory_id, rating, correction,
    question, ord), one after another. A correction is a new memory that supersedes the one it is about; else up and down move
    that one's salience within 1 to 5 a step at a time, and up confirms and reinforces it; else a question that was rated down leaves a gap."""
    said = said.select(F.coalesce("memory_id", F.lit("")).alias("memory_id"), F.lower(text.strip(F.coalesce("rating", F.lit("")))).alias("rating"), text.strip(F.coalesce("correction", F.lit(""))).alias("correction"), F.coalesce("question", F.lit("")).alias("question"), "ord")
    made = F.concat(F.lit("memory_"), F.substring(F.sha2(F.concat_ws("|", "correction", "question", "memory_id", "ord"), 256), 1, 12))
    # fixed values: the texts of gaps and corrections
    gap = F.concat(F.lit("Answer to '"), "question", F.lit("' was rated poor — needs better sources or a correction."))
    body = F.when(F.col("question") != "", F.concat(F.lit("Q: "), "question", F.lit("\nCorrected answer: "), "correction")).otherwise(F.col("correction"))
    corrects, moves = F.col("correction") != "", (F.col("correction") == "") & (F.col("memory_id") != "") & F.col("rating").isin("up", "down")
    leaves = (F.col("correction") == "") & ~moves & (F.col("rating") == "down") & (F.col("question") != "")
    new = said.where(corrects | leaves).select(
        made.alias("id"), "ord", F.when(corrects, "correction").otherwise("gap").alias("kind"), F.when(corrects, body).otherwise(gap).alias("text"), F.when(corrects, 5).otherwise(4).alias("salience"), F.lit("USER").alias("confidence"), F.array(F.lit("feedback")).alias("tags"), F.lit(0).cast("long").alias("reinforced"), F.lit("").alias("superseded_by"),
    )
    last = said.where(corrects & (F.col("memory_id") != "")).groupBy(F.col("memory_id").alias("id")).agg(F.max_by(made, "ord").alias("__by"))
    step = lambda x: F.when(x == "up", 1).otherwise(-1)
    votes = said.where(moves).groupBy(F.col("memory_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rating"))), lambda x: x["rating"]).alias("__votes"))
    moved = F.aggregate("__votes", F.col("salience").cast("int"), lambda s, x: F.greatest(F.lit(1), F.least(F.lit(5), s + step(x))))
    ups = F.size(F.filter("__votes", lambda x: x == "up"))
    old = memories.join(votes, "id", "left").join(last, "id", "left")
    confirmed = F.col("__votes").isNotNull() & (ups > 0) & (rank(F.lit("CONFIRMED")) > rank(F.col("confidence")))
    old = old.select(
        "id", "ord", "kind", "text", F.coalesce(moved, "salience").alias("salience"), F.when(confirmed, "CONFIRMED").otherwise(F.col("confidence")).alias("confidence"), "tags",
        (F.col("reinforced") + F.when(F.col("__votes").isNotNull(), ups).otherwise(0)).cast("long").alias("reinforced"), F.coalesce("__by", "superseded_by").alias("superseded_by"),
    )
    return old.unionByName(new)


def recall_and_mark(memories: DataFrame, query: str, k: int, now: Column, floor: float = KEYWORD_FLOOR) -> tuple[DataFrame, DataFrame]:
    """(the recalled memories, the store in which their use is counted and dated)."""
    found = graph.cut(recall(memories, query, k, now, floor))
    marked = memories.join(found.select("id", F.lit(True).alias("__used")), "id", "left")
    used = F.coalesce("__used", F.lit(False))
    return found, marked.withColumns({"use_count": F.col("use_count") + used.cast("long"), "last_used_at": F.when(used, now)}).drop("__used")


def forget(memories: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the rows ``gone`` (id); what they had superseded is free again."""
    left = memories.join(gone, "id", "left_anti")
    freed = left.join(gone.withColumnsRenamed({"id": "superseded_by"}).withColumn("__gone", F.lit(True)), "superseded_by", "left")
    return freed.withColumn("superseded_by", F.when(F.col("__gone"), "").otherwise(F.col("superseded_by"))).drop("__gone")


def after_evaluation(status: Column, gate: Column) -> Column:
    """Drafts go to review unless the gate rejects."""
    return F.when(gate.isin("accept", "review"), "pending_review").when(gate == "reject", "rejected").otherwise(status)


def after_review(decision: Column, status: Column) -> Column:
    return F.when(decision == "accept", "accepted").when(decision == "reject", "rejected").when(decision == "revise", "needs_revision").otherwise(status)


def aligned(decision: Column, gate: Column) -> Column:
    """Whether person and gate agree on yes or not yes."""
    return (decision == "accept") == (gate == "accept")
