"""Queries for the stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import stores as S
from . import bind
from .bind import CACHE_SQL, MEMORY_SQL, NOW, RUN_SQL
from .registry import query
from .scalars import COSINE, KEYWORD_SIM, KEYWORDS, SKILL_SLUG, STRIP, confidence_rank

I, M, R = bind.cache_items, bind.memories, bind.runs
_NOW = lambda: F.expr(NOW)

query("src05", f"WITH {CACHE_SQL} SELECT kind, count(*) AS n, sum(chars)::BIGINT AS chars FROM cache GROUP BY kind")(lambda t: I(t).groupBy("kind").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")))
query("snk03", f"WITH {CACHE_SQL}, a AS (SELECT ord, content_hash FROM cache WHERE ord % 2 = 0), b AS (SELECT ord, 'new' AS content_hash FROM cache WHERE ord % 3 = 0) SELECT * FROM a WHERE ord NOT IN (SELECT ord FROM b) UNION ALL SELECT * FROM b")(
    lambda t: S.upsert(I(t).where("ord % 2 = 0").select("ord", "content_hash"), I(t).where("ord % 3 = 0").select("ord", F.lit("new").alias("content_hash")), "ord")
)
query("snk04", f"WITH {CACHE_SQL} SELECT ord FROM cache WHERE ord % 5 <> 0")(lambda t: I(t).select("ord").join(I(t).where("ord % 5 = 0").select("ord"), "ord", "left_anti"))
query("snk05", f"WITH {CACHE_SQL} SELECT ord, CASE WHEN ord % 4 = 1 THEN true ELSE in_kg END AS in_kg, vectorized FROM cache")(lambda t: S.set_flags(I(t), F.expr("ord % 4 = 1"), in_kg=F.lit(True)).select("ord", "in_kg", "vectorized"))
query("stm06", f"WITH {RUN_SQL} SELECT ord, kind FROM run ORDER BY ord DESC LIMIT 500")(lambda t: S.last_rows(R(t)).select("ord", "kind"))
query("snk07", f"WITH {RUN_SQL} SELECT ord, kind FROM run ORDER BY kind = 'use' AND ord % 12 = 3 DESC, ord DESC LIMIT 500")(
    lambda t: S.appended(R(t).where("not (kind = 'use' and ord % 12 = 3)"), R(t).where("kind = 'use' and ord % 12 = 3")).select("ord", "kind")
)
query("win06", f"WITH {RUN_SQL} SELECT skill_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY ord DESC) AS k FROM run) WHERE k <= 50")(lambda t: S.kept_of_each(R(t), "skill_id", 50).select("skill_id", "ord"))
query("flt12", f"WITH {CACHE_SQL} SELECT id, kind, source_url, source_title, chars, content_hash, in_kg, vectorized, kg_projected_hash, vector_projected_hash, substr(raw_text, 1, 240) AS preview FROM cache")(lambda t: S.public(I(t)))


@query("jon17", f"""WITH {CACHE_SQL}, r AS (SELECT id, max(ord) AS ord FROM cache WHERE ord % 3 = 0 AND ord % 5 <> 0 GROUP BY id)
SELECT c.ord, c.in_kg OR r.id IS NOT NULL AS in_kg, CASE WHEN r.id IS NOT NULL THEN 'in ' || r.ord ELSE kg_projected_hash END AS kg_projected_hash FROM cache c LEFT JOIN r USING (id)""")
def _jon17(t):
    """Each third item was projected, each fifth of these without success; some were retried."""
    late = I(t).where("ord % 3 = 0").select(F.col("id").alias("cache_id"), F.concat(F.lit("in "), "ord").alias("input_hash"), F.expr("ord % 5 <> 0").alias("ok"), F.col("ord").alias("at"))
    early = late.where("ok").select("cache_id", F.lit("before").alias("input_hash"), "ok", F.lit(-1).cast("long").alias("at"))
    return S.projected(I(t), late.unionByName(early), "in_kg", "kg_projected_hash").select("ord", "in_kg", "kg_projected_hash")


query("flt04", f"WITH {CACHE_SQL} SELECT ord, kind FROM cache WHERE in_kg AND contains(lower(source_title || chr(10) || source_url), 'src1') ORDER BY ord DESC LIMIT 40")(lambda t: S.list_items(I(t), in_kg=True, q="SRC1", limit=40).select("ord", "kind"))
query("flt05", f"WITH {CACHE_SQL} SELECT ord, in_kg AND kg_projected_hash <> content_hash AS kg_stale, vectorized AND vector_projected_hash <> content_hash AS vector_stale FROM cache")(lambda t: I(t).select("ord", S.stale("in_kg", "kg_projected_hash").alias("kg_stale"), S.stale("vectorized", "vector_projected_hash").alias("vector_stale")))
query("flt06", f"WITH {CACHE_SQL} SELECT ord FROM cache WHERE NOT in_kg OR kg_projected_hash <> content_hash ORDER BY ord DESC LIMIT 100")(lambda t: I(t).where(~F.col("in_kg") | S.stale("in_kg", "kg_projected_hash")).orderBy(F.desc("ord")).limit(100).select("ord"))
query("flt07", f"WITH {MEMORY_SQL} SELECT id FROM memory WHERE superseded_by = ''")(lambda t: S.active(M(t)).select("id"))
query("flt08", f"WITH {RUN_SQL} SELECT ord, skill_id, kind FROM run WHERE kind = 'build' AND skill_id = 'skill_3' ORDER BY ord DESC LIMIT 50")(lambda t: R(t).where("kind = 'build' and skill_id = 'skill_3'").orderBy(F.desc("ord")).limit(50).select("ord", "skill_id", "kind"))
query("agg03", f"WITH {CACHE_SQL} SELECT count(*) AS items, count(*) FILTER (in_kg) AS in_kg, count(*) FILTER (vectorized) AS vectorized, coalesce(sum(chars), 0)::BIGINT AS chars FROM cache")(
    lambda t: I(t).agg(F.count("*").alias("items"), F.count_if("in_kg").alias("in_kg"), F.count_if("vectorized").alias("vectorized"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
)
query("agg04", f"WITH {MEMORY_SQL} SELECT kind, count(*) FILTER (superseded_by = '') AS active, count(*) FILTER (superseded_by <> '') AS superseded, sum(use_count)::BIGINT AS uses FROM memory GROUP BY kind")(
    lambda t: M(t).groupBy("kind").agg(F.count_if(F.col("superseded_by") == "").alias("active"), F.count_if(F.col("superseded_by") != "").alias("superseded"), F.sum("use_count").alias("uses"))
)
query("agg05", f"WITH {RUN_SQL}, h AS (SELECT *, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'reject' ELSE NULL END AS human FROM run) SELECT coalesce(gate, 'none') AS gate, count(*) AS n, round(avg(CASE WHEN human IS NOT NULL AND gate IS NOT NULL THEN ((human = 'accept') = (gate = 'accept'))::INT END), 3) AS alignment FROM h GROUP BY ALL")(
    lambda t: R(t).withColumn("human", F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "view", "reject")).groupBy(F.coalesce("gate", F.lit("none")).alias("gate")).agg(F.count("*").alias("n"), F.round(F.avg(S.aligned(F.col("human"), F.col("gate")).cast("int")), 3).alias("alignment"))
)


@query("agg06", f"""WITH {RUN_SQL} SELECT skill_id, count(*) AS total_runs, count(*) FILTER (kind IN ('build', 'refine')) AS builds, count(*) FILTER (gate = 'accept' AND kind <> 'use') AS accepted,
round(count(*) FILTER (gate = 'accept' AND kind <> 'use') / nullif(count(*) FILTER (gate IS NOT NULL AND kind <> 'use'), 0)::DOUBLE, 3) AS gate_pass_rate, round(avg(duration_ms) FILTER (kind IN ('build', 'refine')), 3) AS avg_duration_ms,
round(avg(rubric_mean) FILTER (kind <> 'use'), 3) AS avg_rubric_mean, coalesce(sum(tokens), 0)::BIGINT AS total_tokens, epoch_us(arg_max("at", ord))::BIGINT AS last_run_us FROM run GROUP BY skill_id""")
def _agg06(t):
    built, judged = F.col("kind").isin("build", "refine"), F.col("kind") != "use"
    accepted = F.count_if((F.col("gate") == "accept") & judged)
    return R(t).groupBy("skill_id").agg(
        F.count("*").alias("total_runs"), F.count_if(built).alias("builds"), accepted.alias("accepted"),
        F.round(accepted / F.nullif(F.count_if(F.col("gate").isNotNull() & judged), F.lit(0)), 3).alias("gate_pass_rate"),
        F.round(F.avg(F.when(built, F.col("duration_ms"))), 3).alias("avg_duration_ms"), F.round(F.avg(F.when(judged, F.col("rubric_mean"))), 3).alias("avg_rubric_mean"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.unix_micros(F.max_by("at", "ord")).alias("last_run_us"),
    )


query("agg22", f"WITH {RUN_SQL} SELECT skill_id, kind, sum(tokens)::BIGINT AS tokens FROM run GROUP BY ALL")(lambda t: R(t).groupBy("skill_id", "kind").agg(F.sum("tokens").alias("tokens")))
query("agg23", f"WITH {RUN_SQL} SELECT skill_id, arg_min(kind, (rubric_mean, ord)) AS weakest, coalesce(string_agg(DISTINCT gate, ', ' ORDER BY gate), '') AS gates FROM run WHERE rubric_mean IS NOT NULL GROUP BY skill_id")(lambda t: R(t).where("rubric_mean is not null").groupBy("skill_id").agg(F.min_by("kind", F.struct("rubric_mean", "ord")).alias("weakest"), F.array_join(F.array_sort(F.collect_set("gate")), ", ").alias("gates")))
_Q = "the of and with thin"
_SCORE = f"round({KEYWORD_SIM(repr(_Q), 'text')} + 0.04 * (salience - 3) + 0.02 * greatest(0.0::DOUBLE, 1.0 - (epoch_us({NOW}) - epoch_us(updated_at)) / (86400e6 * 30)), 9)"
query("top09", f"WITH {MEMORY_SQL}, s AS (SELECT id, ord, {KEYWORD_SIM(repr(_Q), 'text')} AS similarity, {_SCORE} AS score FROM memory WHERE superseded_by = '') SELECT id, round(score, 4) AS score, round(similarity, 4) AS similarity FROM (SELECT * FROM s ORDER BY score DESC, ord LIMIT 20) WHERE similarity >= 0.05")(
    lambda t: S.recall(M(t), _Q, 20, _NOW()).select("id", F.round("score", 4).alias("score"), F.round("similarity", 4).alias("similarity"))
)
query("top10", f"WITH s AS (SELECT doc_id, {KEYWORD_SIM(repr(_Q), 'text')} AS similarity FROM documents WHERE lang = 'en') SELECT doc_id, round(similarity, 4) AS similarity FROM (SELECT * FROM s ORDER BY similarity DESC, doc_id LIMIT 30) WHERE similarity >= 0.2")(
    lambda t: t.documents.where("lang = 'en'").withColumn("similarity", text.keyword_similarity(F.lit(_Q), F.col("text"))).orderBy(F.desc("similarity"), "doc_id").limit(30).where("similarity >= 0.2").select("doc_id", F.round("similarity", 4).alias("similarity"))
)
query("top12", f"WITH {MEMORY_SQL} SELECT id, salience FROM memory ORDER BY salience DESC, updated_at DESC, ord LIMIT 100")(lambda t: M(t).orderBy(F.desc("salience"), F.desc("updated_at"), "ord").limit(100).select("id", "salience"))
_STATUS = lambda: F.expr("element_at(array('pending_review', 'accepted', 'needs_revision', 'draft', 'rejected'), cast(ord % 5 + 1 as int))")
query("top13", f"WITH {RUN_SQL} SELECT ord, (['pending_review', 'accepted', 'needs_revision', 'draft', 'rejected'])[ord % 5 + 1] AS status FROM run ORDER BY ord % 5, \"at\" DESC, ord LIMIT 100")(
    lambda t: R(t).withColumn("status", _STATUS()).orderBy(F.array_position(F.array(*map(F.lit, S.STATUS_ORDER)), F.col("status")), F.desc("at"), "ord").limit(100).select("ord", "status")
)


# memories of conversations' first turns have the vector of their number; new ones are each fifth, under another name
_SHARE = lambda a, b: f"(CASE WHEN len({a}.kw) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}.kw, {b}.kw))::DOUBLE / len({a}.kw) END)"
_VEC_SQL = f"""{MEMORY_SQL}, v AS (SELECT m.*, CASE WHEN ord % 1000 = 0 THEN embedding END AS embedding, ['k' || (ord % 3), 'all'] AS tags, 0 AS reinforced FROM memory m LEFT JOIN embeddings ON vec_id * 1000 = ord),
n AS (SELECT 'n' || id AS id, ord, CASE WHEN ord % 1000 = 0 THEN 'other' ELSE kind END AS kind, CASE WHEN ord % 7 = 0 THEN text || ' again' ELSE text END AS text, (1 + ord % 5)::INT AS salience, CASE WHEN ord % 2 = 0 THEN 'confirmed' ELSE 'ambiguous' END AS confidence, ['new', 'k0'] AS tags, embedding FROM v WHERE ord % 5 = 0),
vw AS (SELECT *, {KEYWORDS('text')} AS kw FROM v), nw AS (SELECT *, {KEYWORDS('text')} AS kw FROM n),
p AS (SELECT n.id AS new_id, v.id, v.ord, CASE WHEN n.embedding IS NOT NULL AND v.embedding IS NOT NULL THEN {COSINE('n.embedding', 'v.embedding')} ELSE {_SHARE('n', 'v')} END AS s,
 CASE WHEN n.embedding IS NOT NULL AND v.embedding IS NOT NULL THEN round({COSINE('n.embedding', 'v.embedding')}, 9) >= 0.92 ELSE n.kind = v.kind AND {_SHARE('n', 'v')} >= 0.9 AND {_SHARE('v', 'n')} >= 0.9 END AS same FROM nw n JOIN vw v ON superseded_by = ''),
dup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(s, 9) DESC, ord) AS k FROM p WHERE same) WHERE k = 1)"""


def _vectored(t):
    own = t.embeddings.select((F.col("vec_id") * 1000).alias("ord"), "embedding")
    return M(t).join(own, "ord", "left").withColumns({"tags": F.array(F.concat(F.lit("k"), F.expr("ord % 3")), F.lit("all")), "reinforced": F.lit(0).cast("long")})


def _incoming(t):
    new = _vectored(t).where("ord % 5 = 0")
    return new.select(
        F.concat(F.lit("n"), "id").alias("id"), "ord", F.when(F.expr("ord % 1000 = 0"), "other").otherwise(F.col("kind")).alias("kind"), F.when(F.expr("ord % 7 = 0"), F.concat("text", F.lit(" again"))).otherwise(F.col("text")).alias("text"),
        F.expr("cast(1 + ord % 5 as int)").alias("salience"), F.when(F.expr("ord % 2 = 0"), "confirmed").otherwise("ambiguous").alias("confidence"), F.array(F.lit("new"), F.lit("k0")).alias("tags"), "embedding",
    )


query("jon10", f"WITH {_VEC_SQL} SELECT new_id, id, round(s, 6) AS similarity FROM dup")(lambda t: S.duplicates(_incoming(t), _vectored(t)))


_INGEST = f"WITH {CACHE_SQL}, o AS (SELECT 'c' || ord AS id, content_hash, in_kg FROM cache WHERE ord % 3 <> 0), n AS (SELECT 'c' || ord AS id, CASE WHEN ord % 4 = 0 THEN sha256('v2') ELSE content_hash END AS new_hash FROM cache WHERE ord % 2 = 0) SELECT coalesce(o.id, n.id) AS id, CASE WHEN content_hash IS NULL OR (new_hash IS NOT NULL AND new_hash <> content_hash) THEN new_hash ELSE content_hash END AS content_hash, coalesce(in_kg, false) AS in_kg, CASE WHEN content_hash IS NULL THEN 'created' WHEN new_hash <> content_hash THEN 'changed' ELSE 'unchanged' END AS outcome FROM o FULL JOIN n ON o.id = n.id"


def _ingested(t, times=1):
    """The second time nothing changes."""
    c = I(t).withColumn("id", F.concat(F.lit("c"), "ord"))
    new = c.where("ord % 2 = 0").withColumn("content_hash", F.when(F.expr("ord % 4 = 0"), F.sha2(F.lit("v2"), 256)).otherwise(F.col("content_hash")))
    out = c.where("ord % 3 <> 0").drop("ord")
    for _ in range(times):
        out = S.ingest(out, new)
    return out.select("id", "content_hash", "in_kg", "outcome")


query("cac01", _INGEST)(_ingested)
query("stm02", f"{_INGEST.replace(_INGEST[_INGEST.index(', CASE WHEN content_hash IS NULL THEN'):], '')}, 'unchanged' AS outcome FROM o FULL JOIN n ON o.id = n.id")(lambda t: _ingested(t, times=2))
_MEM2 = f"WITH {MEMORY_SQL}"
_RANK = "(CASE upper({}) WHEN 'AMBIGUOUS' THEN 0 WHEN 'EXTRACTED' THEN 2 WHEN 'CONFIRMED' THEN 3 WHEN 'USER' THEN 4 ELSE 1 END)"
query("mem02", f"{_MEM2} SELECT id, greatest(salience, (ord % 5 + 1)::INT) AS salience, CASE WHEN {_RANK.format('c')} > {_RANK.format('confidence')} THEN upper(c) ELSE confidence END AS confidence FROM (SELECT *, CASE WHEN ord % 3 = 0 THEN 'confirmed' ELSE 'ambiguous' END AS c FROM memory)")(
    lambda t: S.reinforced(M(t), F.expr("cast(ord % 5 + 1 as int)"), F.when(F.expr("ord % 3 = 0"), "confirmed").otherwise("ambiguous"), confidence_rank).select("id", "salience", "confidence")
)
# besides what repeats the store, a batch has texts that no memory has, each with a longer version of it later on
_BATCH_SQL = f"""{_VEC_SQL.replace("FROM v WHERE ord % 5 = 0),", "FROM v WHERE ord % 5 = 0 UNION ALL SELECT 'x' || e || id, ord + e::BIGINT * 1000000000, kind, reverse(text) || repeat(' again', e - 1) || repeat(' more', (e = 3)::INT), 3, 'confirmed', ['x' || e], NULL FROM v, (SELECT unnest([1, 2, 3]) AS e) WHERE ord % 3 = 0),")},
f AS (SELECT kind, text, min(ord) AS ord, arg_min(id, ord) AS id, arg_min(struct_pack(e := embedding), ord).e AS embedding FROM n GROUP BY kind, text),
fw AS (SELECT *, row_number() OVER (ORDER BY ord) AS k, {KEYWORDS('text')} AS kw FROM f),
pp AS (SELECT a.id AS new_id, a.ord AS new_ord, b.id, b.ord, CASE WHEN a.embedding IS NOT NULL AND b.embedding IS NOT NULL THEN {COSINE('a.embedding', 'b.embedding')} ELSE {_SHARE('a', 'b')} END AS s, CASE WHEN a.embedding IS NOT NULL AND b.embedding IS NOT NULL THEN {COSINE('a.embedding', 'b.embedding')} ELSE {_SHARE('b', 'a')} END AS s_back,
 CASE WHEN a.embedding IS NOT NULL AND b.embedding IS NOT NULL THEN round({COSINE('a.embedding', 'b.embedding')}, 9) >= 0.92 ELSE a.kind = b.kind AND {_SHARE('a', 'b')} >= 0.9 AND {_SHARE('b', 'a')} >= 0.9 END AS same FROM fw a JOIN fw b ON b.ord < a.ord AND (a.embedding IS NOT NULL AND b.embedding IS NOT NULL OR a.kind = b.kind AND len(a.kw) * 9 <= len(b.kw) * 10 AND len(b.kw) * 9 <= len(a.kw) * 10)),
step AS (SELECT f.id, f.k, f.id IN (SELECT new_id FROM dup) AS stored, list(pp.id) FILTER (same) AS near FROM fw f LEFT JOIN pp ON pp.new_id = f.id GROUP BY f.id, f.k),
fold AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS added UNION ALL SELECT s.k, CASE WHEN stored OR list_has_any(added, coalesce(near, [])) THEN added ELSE list_append(added, s.id) END FROM fold JOIN step s ON s.k = fold.k + 1),
added AS (SELECT unnest(arg_max(added, k)) AS id FROM fold),
cand AS (SELECT new_id AS rep, id AS old, ord AS old_ord, s, 0 AS late FROM p WHERE same AND new_id IN (SELECT id FROM f) UNION ALL SELECT new_id, id, ord, s, 1 FROM pp WHERE same AND id IN (SELECT id FROM added)
 UNION ALL SELECT id, new_id, new_ord, s_back, 1 FROM pp WHERE same AND new_id IN (SELECT id FROM added) UNION ALL SELECT id, id, ord, 1.0::DOUBLE, 1 FROM f WHERE id IN (SELECT id FROM added)),
it AS (SELECT n.id, n.ord, n.salience, upper(n.confidence) AS confidence, n.tags, f.id AS rep FROM n JOIN f ON f.kind = n.kind AND f.text = n.text WHERE n.id NOT IN (SELECT id FROM added)),
told AS (SELECT it.*, c.old FROM it JOIN cand c USING (rep) WHERE late = 0 OR old_ord < it.ord QUALIFY row_number() OVER (PARTITION BY it.id ORDER BY round(s, 9) DESC, late, old_ord) = 1),
g AS (SELECT old AS id, count(*) AS gain, max(salience) AS s, arg_max(confidence, ({_RANK.format('confidence')}, -ord)) AS c, flatten(list(tags ORDER BY ord)) AS more FROM told GROUP BY old),
every AS (SELECT id, salience, confidence, tags, 0 AS reinforced FROM v UNION ALL SELECT id, salience, upper(confidence), tags, 0 FROM n WHERE id IN (SELECT id FROM added)),
joined AS (SELECT e.*, g.s, g.c, gain, list_concat(tags, coalesce(more, [])) AS every_tag FROM every e LEFT JOIN g USING (id))
SELECT id, greatest(salience, coalesce(s, 0)) AS salience, CASE WHEN c IS NOT NULL AND {_RANK.format('c')} > {_RANK.format('confidence')} THEN c ELSE confidence END AS confidence, (reinforced + coalesce(gain, 0))::BIGINT AS reinforced, array_to_string(list_sort(list_distinct(every_tag)), ' ') AS tags FROM joined"""


def _batch(t):
    late = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("e")
    more = _vectored(t).where("ord % 3 = 0").select("id", "ord", "kind", "text", late)
    e = F.col("e")
    more = more.select(
        F.concat(F.lit("x"), "e", "id").alias("id"), (F.col("ord") + e.cast("long") * 1000000000).alias("ord"), "kind", F.concat(F.reverse("text"), F.when(e == 1, "").when(e == 2, " again").otherwise(" again again more")).alias("text"),
        F.lit(3).alias("salience"), F.lit("confirmed").alias("confidence"), F.array(F.concat(F.lit("x"), "e")).alias("tags"), F.lit(None).cast("array<float>").alias("embedding"),
    )
    return _incoming(t).unionByName(more)


query("mem01", f"WITH RECURSIVE {_BATCH_SQL}")(lambda t: S.remember(_batch(t), _vectored(t), confidence_rank).select("id", "salience", "confidence", "reinforced", F.array_join(F.array_sort("tags"), " ").alias("tags")))
query("mem03", f"{_MEM2} SELECT id, use_count + CASE WHEN ord % 9 = 0 THEN 1 ELSE 0 END AS use_count FROM memory")(lambda t: S.set_flags(M(t), F.expr("ord % 9 = 0"), use_count=F.col("use_count") + 1).select("id", "use_count"))
query("mem04", f"{_MEM2} SELECT id, CASE ord % 3 WHEN 0 THEN least(5, salience + 1) WHEN 1 THEN greatest(1, salience - 1) ELSE salience END::INT AS salience, CASE WHEN ord % 3 = 0 THEN 'CONFIRMED' ELSE confidence END AS confidence FROM memory")(
    lambda t: S.feedback(M(t), F.expr("element_at(array('up', 'down', 'none'), cast(ord % 3 + 1 as int))")).select("id", "salience", "confidence")
)
# feedback: every memory is rated or corrected up to three times, and every benchmark item was answered badly
_SAID_SQL = """said AS (SELECT m.id AS memory_id, CASE WHEN ord % 3 = 0 THEN 'up' ELSE 'down' END AS rating, CASE WHEN ord % 11 = 4 THEN ' better ' || ord ELSE '' END AS correction, CASE WHEN ord % 2 = 0 THEN 'why ' || ord ELSE '' END AS question, e::BIGINT * 1000000 + ord AS o FROM memory m, (SELECT unnest([1, 2, 3]) AS e) WHERE (ord + e) % 4 <> 1
UNION ALL SELECT '', 'down', '', 'item ' || item_id, 9000000 + item_id FROM benchmark),
new_ AS (SELECT *, 'memory_' || substr(sha256(concat_ws('|', trim(correction), question, memory_id, o)), 1, 12) AS id FROM said)"""


def _said(t):
    e = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("e")
    ord_ = F.col("ord")
    m = M(t).select("id", "ord", e).where((ord_ + F.col("e")) % 4 != 1)
    m = m.select(F.col("id").alias("memory_id"), F.when(ord_ % 3 == 0, "up").otherwise("down").alias("rating"), F.when(ord_ % 11 == 4, F.concat(F.lit(" better "), ord_)).otherwise("").alias("correction"), F.when(ord_ % 2 == 0, F.concat(F.lit("why "), ord_)).otherwise("").alias("question"), (F.col("e").cast("long") * 1000000 + ord_).alias("ord"))
    b = t.benchmark.select(F.lit("").alias("memory_id"), F.lit("down").alias("rating"), F.lit("").alias("correction"), F.concat(F.lit("item "), "item_id").alias("question"), (F.col("item_id") + 9000000).alias("ord"))
    return m.unionByName(b)


query("mem04_feedback", f"""WITH {_VEC_SQL}, {_SAID_SQL}, vote AS (SELECT memory_id AS id, list(rating ORDER BY o) AS votes FROM said WHERE correction = '' AND memory_id <> '' GROUP BY memory_id), last AS (SELECT memory_id AS id, arg_max(id, o) AS by_ FROM new_ WHERE correction <> '' GROUP BY memory_id)
SELECT id, kind, text, (CASE WHEN votes IS NULL THEN salience ELSE list_reduce(list_prepend(salience::BIGINT, list_transform(votes, lambda x: CASE x WHEN 'up' THEN 1::BIGINT ELSE -1::BIGINT END)), lambda s, x: greatest(1, least(5, s + x))) END)::INT AS salience, CASE WHEN list_contains(votes, 'up') AND {_RANK.format('confidence')} < 3 THEN 'CONFIRMED' ELSE confidence END AS confidence,
 coalesce(len(list_filter(votes, lambda x: x = 'up')), 0)::BIGINT AS reinforced, coalesce(by_, superseded_by) AS superseded_by FROM v LEFT JOIN vote USING (id) LEFT JOIN last USING (id)
UNION ALL SELECT id, CASE WHEN correction <> '' THEN 'correction' ELSE 'gap' END, CASE WHEN correction = '' THEN 'Answer to ' || chr(39) || question || chr(39) || ' was rated poor — needs better sources or a correction.' WHEN question <> '' THEN 'Q: ' || question || chr(10) || 'Corrected answer: ' || trim(correction) ELSE trim(correction) END, CASE WHEN correction <> '' THEN 5 ELSE 4 END, 'USER', 0, '' FROM new_ WHERE correction <> '' OR memory_id = ''""")(
    lambda t: S.record_feedback(_vectored(t), _said(t), confidence_rank).select("id", "kind", "text", "salience", "confidence", "reinforced", "superseded_by")
)
query("mem06_marked", f"WITH {MEMORY_SQL}, s AS (SELECT id, ord, {KEYWORD_SIM(repr(_Q), 'text')} AS similarity, {_SCORE} AS score FROM memory WHERE superseded_by = ''), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS k FROM s) SELECT m.id, use_count + (r.id IS NOT NULL)::BIGINT AS use_count, CASE WHEN r.id IS NOT NULL THEN epoch_us({NOW}) END AS last_used_us FROM memory m LEFT JOIN r ON r.id = m.id AND k <= 6 AND similarity >= 0.05")(
    lambda t: S.recall_and_mark(M(t), _Q, 6, _NOW())[1].select("id", "use_count", F.unix_micros("last_used_at").alias("last_used_us"))
)
query("mem05", f"{_MEM2}, g AS (SELECT id FROM memory WHERE ord % 14 IN (0, 1)) SELECT id, CASE WHEN superseded_by IN (SELECT id FROM g) THEN '' ELSE superseded_by END AS superseded_by FROM memory WHERE id NOT IN (SELECT id FROM g)")(
    lambda t: S.forget(M(t), M(t).where("ord % 14 in (0, 1)").select("id")).select("id", "superseded_by")
)
query("mem06", f"WITH {MEMORY_SQL}, s AS (SELECT ord, kind, text, {KEYWORD_SIM(repr(_Q), 'text')} AS similarity, {_SCORE} AS score FROM memory WHERE superseded_by = ''), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS k FROM s) SELECT string_agg('- [' || kind || '] ' || {STRIP('text')}, chr(10) ORDER BY k) AS block FROM r WHERE k <= 6 AND similarity >= 0.05")(
    lambda t: S.recall(M(t), _Q, 6, _NOW()).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", F.concat(F.lit("- ["), "kind", F.lit("] "), text.strip(F.col("text"))).alias("line")))), lambda x: x["line"]), "\n").alias("block"))
)
query("skl01", f"""WITH s AS (SELECT {SKILL_SLUG('p_name')} AS slug, p_partkey AS ord, p_type AS description, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'note ' || p_partkey END AS note FROM part),
o AS (SELECT slug, 's' || min(ord) AS id, arg_min(description, ord) AS description, 3 AS version, 2 AS revisions, 'accepted' AS status FROM s GROUP BY slug HAVING min(ord) % 2 = 0),
n AS (SELECT s.*, row_number() OVER (PARTITION BY slug ORDER BY ord) AS k, o.version FROM s LEFT JOIN o USING (slug) WHERE ord % 5 <> 0),
r AS (SELECT slug, arg_max(description, ord) AS description, min(ord) AS first, count(*) - CASE WHEN any_value(version) IS NULL THEN 1 ELSE 0 END AS steps,
 coalesce(string_agg(CASE WHEN version IS NOT NULL OR k > 1 THEN 'v' || (coalesce(version, 0) + k - 1) || ' → v' || (coalesce(version, 0) + k) || CASE WHEN note <> '' THEN ': ' || note ELSE '' END END, '; ' ORDER BY k), '') AS history FROM n GROUP BY slug)
SELECT slug, coalesce(o.id, 't' || first) AS id, coalesce(r.description, o.description) AS description, (coalesce(version, 1) + coalesce(steps, 0))::BIGINT AS version, (coalesce(revisions, 0) + coalesce(steps, 0))::BIGINT AS revisions, CASE WHEN r.slug IS NULL THEN o.status ELSE 'draft' END AS status,
 array_to_string(list_filter([CASE WHEN o.slug IS NOT NULL THEN 'v2 → v3' END, nullif(r.history, '')], lambda x: x IS NOT NULL), '; ') AS history FROM o FULL JOIN r USING (slug)""")(lambda t: _skl01(t))


def _skl01(t):
    """Parts as specs of the skill of their name; half of the skills are there before, accepted in their third version."""
    every = t.part.select(text.skill_slug(F.col("p_name")).alias("slug"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("description"), F.when(F.expr("p_partkey % 3 = 0"), "").otherwise(F.concat(F.lit("note "), "p_partkey")).alias("note"))
    old = every.groupBy("slug").agg(F.min("ord").alias("ord"), F.min_by("description", "ord").alias("description")).where("ord % 2 = 0")
    old = old.select("slug", F.concat(F.lit("s"), "ord").alias("id"), "description", F.lit(3).alias("version"), F.lit(2).alias("revisions"), F.lit("accepted").alias("status"), F.array(F.lit("v2 → v3")).alias("history"))
    specs = every.where("ord % 5 <> 0").withColumn("id", F.concat(F.lit("t"), "ord"))
    return S.upsert_skills(old, specs).withColumn("history", F.array_join("history", "; "))


_DEC = "(['accept', 'reject', 'revise', 'later'])[ord % 4 + 1]"
query("skl02", f"WITH {RUN_SQL} SELECT ord, CASE WHEN gate IN ('accept', 'review') THEN 'pending_review' WHEN gate = 'reject' THEN 'rejected' ELSE 'draft' END AS evaluated, CASE {_DEC} WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'revise' THEN 'needs_revision' ELSE 'pending_review' END AS reviewed, ({_DEC} = 'accept') = (gate = 'accept') AS aligned FROM run")(
    lambda t: R(t).withColumn("d", F.expr("element_at(array('accept', 'reject', 'revise', 'later'), cast(ord % 4 + 1 as int))")).select("ord", S.after_evaluation(F.lit("draft"), F.col("gate")).alias("evaluated"), S.after_review(F.col("d"), F.lit("pending_review")).alias("reviewed"), S.aligned(F.col("d"), F.col("gate")).alias("aligned"))
)


@query("skl05", """WITH a AS (SELECT doc_id, 0 AS pri, doc_id AS o FROM documents WHERE doc_id IN (5, 3, 9) UNION ALL SELECT doc_id, 1, doc_id FROM documents WHERE contains(text, 'thin') UNION ALL SELECT doc_id, 2, doc_id FROM documents WHERE lang = 'de'),
l AS (SELECT * FROM a ORDER BY pri, o LIMIT 24), f AS (SELECT doc_id, min((pri, o)) AS k FROM l GROUP BY doc_id) SELECT substr(string_agg(text, chr(10) || chr(10) ORDER BY k), 1, 12000) AS context, count(*) AS chunks FROM f JOIN documents USING (doc_id)""")
def _skl05(t):
    """Named chunks, then found ones, then tagged ones: 24 before repeats go, 12 000 characters."""
    d = t.documents.select("doc_id", "text", "lang")
    part = lambda rows, n: rows.select("doc_id", "text", F.lit(n).alias("pri"))
    every = part(d.where("doc_id in (5, 3, 9)"), 0).union(part(d.where(F.contains("text", F.lit("thin"))), 1)).union(part(d.where("lang = 'de'"), 2))
    first = every.orderBy("pri", "doc_id").limit(24).groupBy("doc_id").agg(F.min("pri").alias("pri"), F.first("text").alias("text"))
    return first.agg(F.array_sort(F.collect_list(F.struct("pri", "doc_id", "text"))).alias("x")).select(F.substring(F.array_join(F.transform("x", lambda z: z["text"]), "\n\n"), 1, 12000).alias("context"), F.size("x").cast("long").alias("chunks"))




@query("win07", f"WITH {RUN_SQL}, p AS (SELECT ord, greatest(1, round(duration_ms)::BIGINT) AS ms, 2000 AS cap FROM run), r AS (SELECT *, sum(ms) OVER (PARTITION BY ord // 8 ORDER BY ord) AS e FROM p) SELECT ord, least(e - ms, cap)::BIGINT AS start_ms, least(e, cap)::BIGINT AS end_ms FROM r")
def _win07(t):
    """Phases, eight to a run, end to end within their run's time."""
    w = Window.partitionBy(F.expr("ord div 8")).orderBy("ord")
    p = R(t).withColumn("ms", F.greatest(F.lit(1), F.round("duration_ms").cast("long"))).withColumn("e", F.sum("ms").over(w))
    return p.select("ord", F.least(F.col("e") - F.col("ms"), F.lit(2000)).alias("start_ms"), F.least("e", F.lit(2000)).alias("end_ms"))


query("snk10", f"WITH {RUN_SQL} SELECT ord, 'skill.' || kind AS name, epoch_us(\"at\")::BIGINT - round(duration_ms * 1000)::BIGINT AS start_us, epoch_us(\"at\")::BIGINT AS end_us, coalesce(gate, '') AS tag FROM run")(
    lambda t: R(t).select("ord", F.concat(F.lit("skill."), "kind").alias("name"), (F.unix_micros("at") - F.round(F.col("duration_ms") * 1000).cast("long")).alias("start_us"), F.unix_micros("at").alias("end_us"), F.coalesce("gate", F.lit("")).alias("tag"))
)
query("snk08", "SELECT p_partkey, '---' || chr(10) || 'name: ' || p_name || chr(10) || 'description: ' || p_type || chr(10) || '---' || chr(10) || chr(10) || '# ' || p_name || chr(10) AS markdown FROM part")(lambda t: t.part.select("p_partkey", F.concat(F.lit("---\nname: "), "p_name", F.lit("\ndescription: "), "p_type", F.lit("\n---\n\n# "), "p_name", F.lit("\n")).alias("markdown")))
query("snk09", "SELECT source, string_agg('- ' || text, chr(10) ORDER BY doc_id) AS page FROM documents GROUP BY source")(lambda t: t.documents.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.col("text").alias("h")))), lambda x: F.concat(F.lit("- "), x["h"])), "\n").alias("page")))
_VERSIONS_SQL = "a AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 5 <> 1), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 7 <> 2)"


def _versions(t):
    """Two versions of a table: some rows gone, some new, some with another text or no language."""
    d = t.documents
    new = d.where("doc_id % 7 <> 2").select("doc_id", F.when(F.expr("doc_id % 4 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(F.expr("doc_id % 9 <> 0"), F.col("lang")).alias("lang"))
    return d.where("doc_id % 5 <> 1").select("doc_id", "text", "lang"), new


query("stm03", f"""WITH {_VERSIONS_SQL} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, b.text, b.lang, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text IS DISTINCT FROM b.text OR a.lang IS DISTINCT FROM b.lang""")(lambda t: S.changes(*_versions(t), "doc_id"))
query("stm03_applied", f"WITH {_VERSIONS_SQL} SELECT * FROM b")(lambda t: S.with_changes(_versions(t)[0], S.changes(*_versions(t), "doc_id"), "doc_id"))
query("stm07", f"WITH {MEMORY_SQL} SELECT id, round(greatest(0.0::DOUBLE, 1.0 - (epoch_us({NOW}) - epoch_us(updated_at)) / (86400e6 * 30)), 9) AS weight FROM memory")(lambda t: M(t).select("id", F.round(S.dates.recency(F.col("updated_at"), _NOW()), 9).alias("weight")))
