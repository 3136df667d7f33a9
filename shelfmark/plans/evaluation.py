"""Queries for texts, pages and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import plugins
from ..functions import html, text
from ..operators import chunking as K
from ..operators import evaluation as V
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import vectors as X
from . import bind, graph  # noqa: F401  graph's SQL is used below
from .registry import SQL, query
from .scalars import NORMAL, SENTENCES, STRIP

T = lambda: F.col("text")

# texts
def chunk_sql(size: int, overlap: int) -> str:
    """The chunker as two recursions: sentences to pieces, pieces to chunks. For texts of one paragraph."""
    tail = f"CASE WHEN length(buf) <= {overlap} THEN buf WHEN strpos(substr(buf, -{overlap}), ' ') - 1 > 0 AND strpos(substr(buf, -{overlap}), ' ') - 1 < {overlap // 2} THEN {STRIP(f"substr(substr(buf, -{overlap}), strpos(substr(buf, -{overlap}), ' ') + 1)")} ELSE {STRIP(f'substr(buf, -{overlap})')} END"
    tail = tail if overlap else "''"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {NORMAL('text')} AS t FROM documents), s AS (SELECT doc_id, {SENTENCES('t')} AS s FROM d WHERE length(t) > {size}),
a AS (SELECT doc_id, 0 AS i, '' AS buf, []::VARCHAR[] AS emit, len(s) AS n FROM s
UNION ALL SELECT doc_id, i + 1, CASE WHEN x IS NULL THEN '' WHEN fits THEN joined WHEN length(x) > {size} THEN '' ELSE x END,
  CASE WHEN x IS NULL THEN CASE WHEN buf = '' THEN [] ELSE [buf] END WHEN fits THEN [] ELSE list_concat(CASE WHEN buf = '' THEN [] ELSE [buf] END, CASE WHEN length(x) > {size} THEN list_transform(range(0, (length(x) - 1) // {size} + 1), lambda k: substr(x, k * {size} + 1, {size})) ELSE [] END) END, n
  FROM (SELECT a.*, s.s[i + 1] AS x, CASE WHEN buf = '' THEN s.s[i + 1] ELSE buf || ' ' || s.s[i + 1] END AS joined, length(CASE WHEN buf = '' THEN s.s[i + 1] ELSE buf || ' ' || s.s[i + 1] END) <= {size} AS fits FROM a JOIN s USING (doc_id) WHERE i <= a.n)),
p AS (SELECT doc_id, flatten(list(emit ORDER BY i)) AS p FROM a GROUP BY doc_id),
b AS (SELECT doc_id, 0 AS i, '' AS buf, NULL::VARCHAR AS emit, len(p) AS n FROM p
UNION ALL SELECT doc_id, i + 1, CASE WHEN x IS NULL THEN '' WHEN fits THEN joined WHEN buf = '' OR ({tail}) = '' THEN x ELSE {STRIP(f"({tail}) || chr(10) || chr(10) || x")} END, CASE WHEN (x IS NULL OR NOT fits) AND buf <> '' THEN buf END, n
  FROM (SELECT b.*, p.p[i + 1] AS x, CASE WHEN buf = '' THEN p.p[i + 1] ELSE {STRIP("buf || chr(10) || chr(10) || p.p[i + 1]")} END AS joined, length(CASE WHEN buf = '' THEN p.p[i + 1] ELSE {STRIP("buf || chr(10) || chr(10) || p.p[i + 1]")} END) <= {size} AS fits FROM b JOIN p USING (doc_id) WHERE i <= b.n))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS position, emit AS text FROM b WHERE emit IS NOT NULL UNION ALL SELECT doc_id, 0, t FROM d WHERE t <> '' AND length(t) <= {size}"""


query("txt01", chunk_sql(800, 120))(lambda t: K.chunk(t.documents, "doc_id", "text"))
query("udtf1", chunk_sql(400, 60))(lambda t: K.chunk_table(t.documents, "doc_id", "text", 400, 60))
query("txt02", f"SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE CASE WHEN strpos(substr(text, -120), ' ') - 1 > 0 AND strpos(substr(text, -120), ' ') - 1 < 60 THEN {STRIP('''substr(substr(text, -120), strpos(substr(text, -120), ' ') + 1)''')} ELSE {STRIP('substr(text, -120)')} END END AS tail FROM documents")(lambda t: t.documents.select("doc_id", text.overlap_tail(T(), 120).alias("tail")))
query("txt03", "SELECT doc_id, i::INT AS position, substr(text, i * 2500 + 1, 2500) AS part FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 2500 THEN [0] ELSE range(0, (length(text) - 1) // 2500 + 1) END) AS i FROM (SELECT doc_id, " + STRIP("text") + " AS text FROM documents))")(
    lambda t: t.documents.select("doc_id", F.posexplode(K.sub_chunks(text.strip(T()))).alias("position", "part"))
)
_S = f"s AS (SELECT doc_id, unnest(list_filter({SENTENCES('text')}, lambda s: length(s) > 30)) AS s, unnest(range(0, len(list_filter({SENTENCES('text')}, lambda s: length(s) > 30)))) AS p FROM documents)"
_LIGHT = "(" + ", ".join(f"'{w}'" for w in text.LIGHT_WORDS) + ")"
_SUMMARY = f"""WITH {_S}, w AS (SELECT doc_id, p, unnest(regexp_extract_all(lower(s), '[a-z]{{4,}}')) AS w FROM s), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), g AS (SELECT doc_id, p, sum(n) AS n FROM w JOIN c USING (doc_id, w) WHERE w NOT IN {_LIGHT} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p) AS r FROM (SELECT s.*, coalesce(g.n, 0)::DOUBLE / greatest(1, len(regexp_extract_all(lower(s), '[a-z]{{4,}}'))) AS score FROM s LEFT JOIN g USING (doc_id, p))),
j AS (SELECT doc_id, string_agg(s, ' ' ORDER BY p) AS summary FROM r WHERE r <= 6 GROUP BY doc_id) SELECT d.doc_id, coalesce(summary, substr(text, 1, 600)) AS summary FROM documents d LEFT JOIN j USING (doc_id)"""
query("txt05", _SUMMARY)(lambda t: K.summarize(t.documents))
query("top15", f"{_SUMMARY[: _SUMMARY.index('j AS (')]} k AS (SELECT 1) SELECT doc_id, p::INT AS p, r::INT AS r, round(score, 6) AS score FROM r WHERE r <= 6")(
    lambda t: K.ranked_sentences(t.documents).where("r <= 6").select("doc_id", "p", "r", F.round("score", 6).alias("score"))
)
_HTML = "html"
for _tag in ("script", "style", "nav", "header", "footer", "aside"):
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_HTML = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_HTML}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"
query("txt04", f"SELECT page_id, {_HTML} AS plain FROM pages")(lambda t: t.pages.select("page_id", html.stripped(F.col("html")).alias("plain")))
query("src08")(lambda t: t.pages.select("page_id", html.main_text_of("html").alias("main_text")))
query("dat02")(lambda t: t.pages.select("page_id", html.page_date_of("html").alias("date")))
@query("txt07")
def _txt07(t):
    from ..plugins import HashingEmbedder, embed

    return embed(t.documents.select("doc_id", "text"), "doc_id", "text", HashingEmbedder())


def named_words(own: str) -> list[dict]:
    """A model's stand-in: a text's first two capital words, and no answer for every seventh length."""
    if len(own) % 7 == 0:
        raise ValueError("no answer")
    return [{"name": w, "kind": "word"} for w in re.findall("[A-Z][a-z]{5,}", own)[:2]]


def _extracted_sql(table: str) -> str:
    """What the stand-in finds, and the rule of thumb where it fails."""
    failed = f"(SELECT doc_id, text FROM {table} WHERE length(text) % 7 = 0)"
    return f"""SELECT doc_id, unnest((regexp_extract_all(text, '[A-Z][a-z]{{5,}}'))[1:2]) AS name, 'word' AS kind, '' AS error FROM {table} WHERE length(text) % 7 <> 0
UNION ALL SELECT doc_id, name, 'concept', 'ValueError: no answer' FROM ({SQL['top14'].replace('FROM documents', f'FROM {failed}')})"""


query("udf01", _extracted_sql("documents"))(lambda t: plugins.extract(t.documents.select("doc_id", "text"), "doc_id", "text", named_words))


@query("grf15", _extracted_sql(f"(SELECT doc_id * 1000 + position AS doc_id, text FROM ({chunk_sql(2500, 0)}))"))
def _grf15(t):
    """Extraction from every section of every document, side by side."""
    parts = K.chunk(t.documents, "doc_id", "text", K.SECTION, 0).select((F.col("doc_id") * 1000 + F.col("position")).alias("doc_id"), "text")
    return plugins.extract(G.cut(parts), "doc_id", "text", named_words)


_ENTITY_SQL = """e AS (SELECT c_custkey AS ord, 'entity_' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) END AS kind, (c_custkey % 5 + 1)::INT AS importance, (c_custkey * 7 % 23)::BIGINT AS mentions,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'topic_' || (c_custkey % 31) END AS topic FROM customer)"""


def _entities(t):
    return t.customer.select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("entity_"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.expr("c_custkey % 3 = 0"), "").otherwise(F.lower("c_mktsegment")).alias("kind"),
        F.expr("cast(c_custkey % 5 + 1 as int)").alias("importance"), F.expr("c_custkey * 7 % 23").cast("long").alias("mentions"), F.when(F.expr("c_custkey % 4 <> 0"), F.concat(F.lit("topic_"), F.expr("c_custkey % 31"))).alias("topic"),
    )


@query("grf16", f"""WITH {_ENTITY_SQL}, a AS (SELECT * FROM e ORDER BY importance DESC, mentions DESC, ord LIMIT 90) SELECT CASE WHEN ord % 6 = 2 THEN 'Later' ELSE 'Group ' || (ord % 7) END AS topic, id FROM a WHERE ord % 6 <> 3""")
def _grf16(t):
    """A grouping as a model would say it: in odd case, with blanks, unknown names, a blank topic, and some entities twice."""

    def answer(asked):
        group = F.concat(F.lit(" Group "), F.expr("ord % 7"), F.lit(" "))
        said = asked.where("ord % 6 <> 3").select(group.alias("topic"), F.concat(F.lit(" "), F.upper("name")).alias("entity"), F.lit(0).alias("place"))
        said = said.unionByName(asked.where("ord % 6 = 2").select(F.lit("Later").alias("topic"), F.col("name").alias("entity"), F.lit(1).alias("place")))
        said = said.unionByName(asked.where("ord % 6 = 3").select(F.lit("  ").alias("topic"), F.col("name").alias("entity"), F.lit(2).alias("place")))
        return said.unionByName(asked.select(F.lit("Group x").alias("topic"), F.concat("name", F.lit("?")).alias("entity"), F.lit(3).alias("place")))

    return G.build_topics(_entities(t), answer)


# retrieval metrics: the chunk found for the start of each chunk's own text
_EV = f"""WITH RECURSIVE {bind.CHUNK_SQL}, q AS (SELECT ord AS query_id, embedding AS qv, '' AS qt FROM chunk WHERE ord % 20 = 0), sim AS (SELECT query_id, c.ord, c.url, round(list_sum(list_transform(list_zip(c.embedding, q.qv), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS sim FROM chunk c, q WHERE c.ord <> q.query_id),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ord) AS rank FROM sim QUALIFY rank <= 6),
ex AS (SELECT query_id, list(url ORDER BY rank) AS got, ['u' || (query_id % 50), 'u' || ((query_id + 7) % 50), 'u' || ((query_id * 3) % 50)] AS expected FROM hit GROUP BY query_id),
m AS (SELECT query_id, coalesce(list_min(list_filter(list_transform(expected, lambda e: list_position(got, e)), lambda p: p > 0)), 0) AS place, len(list_distinct(list_intersect(got, expected)))::DOUBLE / len(list_distinct(expected)) AS recall FROM ex)"""


def _examples(t):
    c = bind.chunks(t)
    q = c.where("ord % 20 = 0").select(F.col("ord").alias("query_id"), F.col("embedding").alias("qv"))
    # the best 7, of which the question's own chunk can be one
    scored = X.nearest(c.select("ord", "url", "embedding"), q, 7).where("ord <> query_id").withColumn("sim", F.round("sim", 9))
    hits = R.top(scored, 6, F.desc("sim"), F.col("ord")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("got"))
    u = lambda e: F.concat(F.lit("u"), F.expr(e))
    return hits.withColumn("expected", F.array(u("query_id % 50"), u("(query_id + 7) % 50"), u("(query_id * 3) % 50")))


def _share(row: dict) -> float | None:
    """The expected addresses' share that was found; none where nothing was, and a failure for some questions."""
    if row["query_id"] % 40 == 0:
        raise ValueError("no judge")
    found = set(row["got"]) & set(row["expected"])
    return len(found) / len(set(row["expected"])) if found else None


# evaluators that a caller brings: one for every row, one that leaves some out and fails on others, one that has no score
query("udf05_any", f"""{_EV} SELECT 'hit' AS evaluator, count(*) AS n, round(avg((recall > 0)::INT), 6) AS mean, 0 AS errors FROM m UNION ALL SELECT 'share', count(*) FILTER (recall > 0 AND query_id % 40 <> 0), round(avg(recall) FILTER (recall > 0 AND query_id % 40 <> 0), 6), count(*) FILTER (query_id % 40 = 0) FROM m
UNION ALL SELECT 'none', 0, NULL, 0""")(lambda t: V.mean_scores(_examples(t), {"hit": lambda r: float(bool(set(r["got"]) & set(r["expected"]))), "share": _share, "none": lambda r: None}))



_G, _X = lambda: F.col("got"), lambda: F.col("expected")
query("jon13", f"{_EV} SELECT query_id, place::BIGINT AS place FROM m")(lambda t: _examples(t).select("query_id", V.first_hit(_G(), _X()).cast("long").alias("place")))
query("agg09", f"{_EV} SELECT query_id, round(recall, 6) AS recall, recall > 0 AS any_hit FROM m")(lambda t: _examples(t).select("query_id", F.round(V.recall(_G(), _X()), 6).alias("recall"), (V.recall(_G(), _X()) > 0).alias("any_hit")))
query("agg07", f"{_EV} SELECT count(*) AS n, round(avg((place > 0)::INT), 4) AS hit_rate, round(avg(CASE WHEN place > 0 THEN 1.0::DOUBLE / place ELSE 0.0::DOUBLE END), 4) AS mrr FROM m")(
    lambda t: _examples(t).agg(F.count("*").alias("n"), F.round(F.avg((V.first_hit(_G(), _X()) > 0).cast("int")), 4).alias("hit_rate"), F.round(F.avg(V.reciprocal_rank(_G(), _X())), 4).alias("mrr"))
)
query("evl02", f"{_EV} SELECT round(avg(recall), 4) AS recall, round(avg((recall > 0)::INT), 4) AS any_hit FROM m")(lambda t: _examples(t).agg(F.round(F.avg(V.recall(_G(), _X())), 4).alias("recall"), F.round(F.avg((V.recall(_G(), _X()) > 0).cast("int")), 4).alias("any_hit")))
query("udf05", f"{_EV} SELECT query_id, CASE WHEN place > 0 THEN round(1.0::DOUBLE / place, 6) ELSE 0.0::DOUBLE END AS score FROM m")(lambda t: _examples(t).select("query_id", F.round(V.reciprocal_rank(_G(), _X()), 6).alias("score")))
query("agg08", "SELECT event_type AS key, round(avg(value) FILTER (event_id % 4 <> 0), 3) AS mean, count(*) FILTER (event_id % 4 <> 0) AS n FROM events GROUP BY event_type")(lambda t: t.events.withColumn("v", F.when(F.expr("event_id % 4 <> 0"), F.col("value"))).groupBy(F.col("event_type").alias("key")).agg(F.round(F.avg("v"), 3).alias("mean"), F.count("v").alias("n")))

# judges: two of them over the labels
_J = """j AS (SELECT 'a' AS judge, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 10) / 10.0::DOUBLE END AS score, quality::DOUBLE AS human, 'Same  Text' AS answer, CASE WHEN doc_id % 7 = 0 THEN 'other' WHEN doc_id % 7 = 1 THEN '' ELSE 'same text ' END AS reviewed, doc_id FROM labels
UNION ALL SELECT 'b', toxic::DOUBLE, quality::DOUBLE, 'x', NULL, doc_id FROM labels)"""


def _judged(t):
    a = t.labels.select(F.lit("a").alias("judge"), F.when(F.expr("doc_id % 11 <> 0"), F.expr("doc_id % 10 / 10.0D")).alias("score"), F.col("quality").cast("double").alias("human"), F.lit("Same  Text").alias("answer"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'other' WHEN doc_id % 7 = 1 THEN '' ELSE 'same text ' END").alias("reviewed"), "doc_id")
    b = t.labels.select(F.lit("b").alias("judge"), F.col("toxic").cast("double").alias("score"), F.col("quality").cast("double").alias("human"), F.lit("x").alias("answer"), F.lit(None).cast("string").alias("reviewed"), "doc_id")
    return a.unionByName(b)


query("agg10", f"WITH {_J} SELECT judge, count(*) AS n, round(avg(abs(score - human)), 3) AS mae, round(1.0::DOUBLE - avg(abs(score - human)), 3) AS alignment, round(avg((abs(score - human) <= 0.2::DOUBLE)::INT), 3) AS within FROM j WHERE (coalesce(reviewed, '') = '' OR regexp_replace(trim(lower(answer)), '\\s+', ' ', 'g') = regexp_replace(trim(lower(reviewed)), '\\s+', ' ', 'g')) AND score IS NOT NULL GROUP BY judge")(
    lambda t: V.judge_alignment(_judged(t))
)
query("jon14", f"WITH {_J} SELECT judge, doc_id, score, human FROM j WHERE score IS NOT NULL AND coalesce(reviewed, '') <> 'other'")(lambda t: _judged(t).where("score is not null and coalesce(reviewed, '') <> 'other'").select("judge", "doc_id", "score", "human"))
query("agg11", f"WITH {_J}, e AS (SELECT doc_id % 20 AS skill, judge, round(avg(score), 3) AS overall FROM j WHERE score IS NOT NULL GROUP BY ALL) SELECT skill, count(*) AS judges, round(avg(overall), 3) AS mean FROM e GROUP BY skill")(lambda t: V.rubric_panel(_judged(t).withColumn("skill", F.expr("doc_id % 20"))))
_TRIG = """c AS (SELECT doc_id % 30 AS skill, quality = 1 AS want, (doc_id * 7) % 3 <> 0 AS got FROM labels), k AS (SELECT skill, count(*) FILTER (want AND got) AS tp, count(*) FILTER (NOT want AND got) AS fp, count(*) FILTER (want AND NOT got) AS fn, count(*) FILTER (NOT want AND NOT got) AS tn FROM c GROUP BY skill),
p AS (SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 3) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 3) AS recall FROM k)"""
query("agg12", f"WITH {_TRIG} SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 3) WHEN precision = 0 OR recall = 0 THEN 0.0::DOUBLE END AS f1 FROM p")(
    lambda t: V.confusion(t.labels.select(F.expr("doc_id % 30").alias("skill"), (F.col("quality") == 1).alias("want"), F.expr("(doc_id * 7) % 3 <> 0").alias("got")), "want", "got", "skill")
)

# skills out of parts and documents
_SK = """sk AS (SELECT doc_id, substr(text, 1, (doc_id % 90)::INT) AS name, substr(text, 1, (doc_id % 60)::INT) AS description, substr(text, 1, (doc_id % 7000)::INT) AS instructions, doc_id % 5 AS n_steps, doc_id % 3 AS n_triggers, doc_id % 4 AS n_anti, doc_id % 6 AS n_tools, doc_id % 2 = 0 AS pos, doc_id % 3 = 0 AS neg, doc_id % 7 <> 0 AS grounded FROM documents)"""


def _skills(t):
    fill = lambda n: F.expr(f"array_repeat('x', cast({n} as int))")
    d = t.documents
    return d.select(
        "doc_id", F.expr("substr(text, 1, cast(doc_id % 90 as int))").alias("name"), F.expr("substr(text, 1, cast(doc_id % 60 as int))").alias("description"), F.expr("substr(text, 1, cast(doc_id % 7000 as int))").alias("instructions"),
        fill("doc_id % 5").alias("steps"), fill("doc_id % 3").alias("triggers"), fill("doc_id % 4").alias("anti_triggers"), fill("doc_id % 6").alias("tools"),
        F.expr("filter(array(IF(doc_id % 2 = 0, true, null), IF(doc_id % 3 = 0, false, null)), x -> x is not null)").alias("tests"), F.expr("doc_id % 7 <> 0").alias("grounded"),
    )


_RULES = {
    "has_name": f"length({STRIP('name')}) BETWEEN 2 AND 80",
    "has_description": rf"length({STRIP('description')}) >= 20 AND len(list_filter(string_split_regex({STRIP('description')}, '\s+'), lambda w: w <> '')) >= 5",
    "has_instructions": f"length({STRIP('instructions')}) >= 80",
    "has_steps": r"CASE WHEN n_steps > 0 THEN n_steps ELSE len(regexp_extract_all(instructions, '(?m)^\s*(?:\d+[.)]|[-*])\s+\S')) END >= 2",
    "has_triggers": "n_triggers >= 1", "has_anti_triggers": "n_anti >= 1", "declares_tools": "n_tools >= 1", "has_positive_and_negative_tests": "pos AND neg",
    "no_placeholders": rf"NOT regexp_matches({STRIP('description')} || chr(10) || {STRIP('instructions')}, '(?i)\b(TODO|TBD|FIXME|XXX|lorem ipsum|your (?:skill|task|tool) here|placeholder)\b|<[a-z_]{{3,}}>')",
    "grounded_in_context": "grounded", "within_budget": f"length({STRIP('instructions')}) <= 6000",
}
_FAIL = "list_filter([" + ", ".join(f"CASE WHEN NOT ({v}) THEN '{k}' END" for k, v in _RULES.items()) + "], lambda x: x IS NOT NULL)"
_CRIT = "len(list_filter(f, lambda x: x IN ('has_name', 'has_description', 'has_instructions', 'has_steps')))"
query("agg13", f"WITH {_SK}, r AS (SELECT doc_id, {_FAIL} AS f FROM sk) SELECT doc_id, (11 - len(f))::INT AS passed, round((11 - len(f)) / 11.0::DOUBLE, 3) AS ratio, array_to_string(f, ',') AS failures, {_CRIT}::INT AS critical FROM r")(
    lambda t: V.checks(_skills(t)).select("doc_id", "passed", "ratio", F.array_join("failures", ",").alias("failures"), F.size("critical").alias("critical"))
)
_RUB = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 10) / 10.0::DOUBLE END"
_GATE = f"CASE WHEN {_CRIT} > 0 OR round((11 - len(f)) / 11.0::DOUBLE, 3) < 0.8 THEN 'reject' WHEN {_RUB} IS NULL THEN 'review' WHEN {_RUB} >= 0.7 THEN 'accept' WHEN {_RUB} < 0.4 THEN 'reject' ELSE 'review' END"
_RUBRIC = lambda: F.when(F.expr("doc_id % 5 <> 0"), F.expr("doc_id % 10 / 10.0D"))
query("skl03", f"WITH {_SK}, r AS (SELECT doc_id, {_FAIL} AS f FROM sk) SELECT doc_id, {_GATE} AS gate FROM r")(lambda t: V.checks(_skills(t)).select("doc_id", V.gate(F.col("ratio"), F.size("critical"), _RUBRIC()).alias("gate")))
query("skl04", f"WITH {_SK}, r AS (SELECT doc_id, {_FAIL} AS f FROM sk) SELECT doc_id, (11 - len(f))::INT AS passed, 11 AS total, round((11 - len(f)) / 11.0::DOUBLE, 3) AS ratio, array_to_string(f, ',') AS failures, {_GATE} AS gate FROM r")(lambda t: V.checks(_skills(t)).select("doc_id", "passed", "total", "ratio", F.array_join("failures", ",").alias("failures"), V.gate(F.col("ratio"), F.size("critical"), _RUBRIC()).alias("gate")))
query("evl01", "WITH k AS (SELECT DISTINCT 'u' || (vec_id % 50) AS u FROM embeddings), a AS (SELECT DISTINCT item_id, unnest(['u' || (item_id % 60), 'u' || (item_id % 7)]) AS u FROM benchmark) SELECT b.item_id, count(k.u)::INT AS known FROM benchmark b LEFT JOIN a USING (item_id) LEFT JOIN k ON k.u = a.u GROUP BY b.item_id")(lambda t: _known(t))


def _known(t):
    urls = t.embeddings.select(F.concat(F.lit("u"), F.expr("vec_id % 50")).alias("u")).distinct()
    u = lambda e: F.concat(F.lit("u"), F.expr(e))
    asked = t.benchmark.select("item_id", F.explode(F.array_distinct(F.array(u("item_id % 60"), u("item_id % 7"), u("item_id % 60")))).alias("u"))
    return t.benchmark.select("item_id").join(asked.join(urls, "u").groupBy("item_id").agg(F.count("*").cast("int").alias("known")), "item_id", "left").select("item_id", F.coalesce("known", F.lit(0)).alias("known"))


query("evl03", "SELECT d.doc_id, l.doc_id IS NULL AS needs_review FROM documents d LEFT JOIN labels l USING (doc_id)")(lambda t: t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(True).alias("had")), "doc_id", "left").select("doc_id", F.col("had").isNull().alias("needs_review")))


@query("top16", f"""WITH {_ENTITY_SQL}, t AS (SELECT 'topic_' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey >= 5 THEN 'topic_' || n_regionkey END AS parent, CASE WHEN n_nationkey % 2 = 0 THEN 'about ' || n_name ELSE '' END AS summary FROM nation),
n AS (SELECT t.*, (SELECT count(*) FROM e WHERE e.topic = t.id) AS n FROM t), r AS (SELECT x.*, coalesce(x.parent, x.id) AS root, y.n AS root_n, y.name AS root_name, (x.parent IS NOT NULL)::INT AS depth FROM n x JOIN n y ON y.id = coalesce(x.parent, x.id)),
ent AS (SELECT *, '- ' || name || ' (' || coalesce(nullif(kind, ''), 'concept') || ')' AS line, row_number() OVER (PARTITION BY topic ORDER BY importance DESC, mentions DESC, ord) AS k, row_number() OVER (ORDER BY importance DESC, mentions DESC, ord) AS every FROM e),
l AS (SELECT root_n, root_name, root, depth, name, id, 0 AS e, '- **' || name || '** (' || n || ' entities)' || CASE WHEN summary <> '' THEN ' — ' || summary ELSE '' END AS line FROM r
 UNION ALL SELECT root_n, root_name, root, depth, r.name, r.id, k, ent.line FROM r JOIN ent ON ent.topic = r.id WHERE k <= 8),
o AS (SELECT *, row_number() OVER (ORDER BY every) AS place FROM ent WHERE every <= 200 AND topic IS NULL)
SELECT 'Topics' AS section, row_number() OVER (ORDER BY root_n DESC, root_name, root, depth, name, id, e)::INT AS place, (depth + (e > 0)::INT)::INT AS depth, line FROM l UNION ALL SELECT 'Unfiled entities', place::INT, 0, line FROM o WHERE place <= 25""")
def _top16(t):
    """Nations as topics, five of them roots, and customers as entities."""
    topics = t.nation.select(
        F.concat(F.lit("topic_"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") >= 5, F.concat(F.lit("topic_"), "n_regionkey")).alias("parent"),
        F.when(F.expr("n_nationkey % 2 = 0"), F.concat(F.lit("about "), "n_name")).otherwise("").alias("summary"),
    )
    return G.catalog(topics, _entities(t))
