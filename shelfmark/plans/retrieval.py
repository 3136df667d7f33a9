"""Queries for retrieval: rankings, fusion, diversity, budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph as G
from ..operators import lexical as L
from ..operators import neighbours as A
from ..operators import retrieval as R
from ..operators import vectors as X
from . import bind
from .bind import CHUNK_SQL, QUERY_SQL, SECTION_SQL
from .registry import query
from .scalars import DOT, STRIP, TOKENS

C, S, Q = bind.chunks, bind.sections, bind.questions
WITH = f"WITH RECURSIVE {CHUNK_SQL}, {QUERY_SQL}, {SECTION_SQL}"
SIM_SQL = f"sim AS (SELECT query_id, c.ord, c.id, c.url, c.section_id, {DOT('c.embedding', 'q.qv')} AS sim FROM chunk c, q)"


def nn_sql(m: int) -> str:
    return f"nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ord) AS nn FROM sim) WHERE nn <= {m})"


def hier_sql(k: int, m: int) -> str:
    return f"""{SIM_SQL}, {nn_sql(m)}, ss AS (SELECT query_id, s.id AS section_id, {DOT('s.embedding', 'q.qv')} AS s FROM section s, q),
blend AS (SELECT n.*, round(sim, 4) AS chunk_score, round(coalesce(s, 0.0), 4) AS section_score, round(sim + 0.35::DOUBLE * coalesce(s, 0.0::DOUBLE), 4) AS score FROM nn n LEFT JOIN ss USING (query_id, section_id)),
hier AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, nn)::INT AS rank FROM blend) WHERE rank <= {k})"""


def bm25_sql(m: int) -> str:
    return f"""tok AS (SELECT ord, unnest({TOKENS('text')}) AS term FROM chunk), len AS (SELECT ord, len({TOKENS('text')}) AS l FROM chunk), st AS (SELECT count(*) AS n, avg(l) AS avgdl FROM len),
tf AS (SELECT term, ord, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qt AS (SELECT DISTINCT query_id, unnest({TOKENS('qt')}) AS term FROM q),
w AS (SELECT query_id, ord, round(sum(greatest(0.0::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avgdl)))), 6) AS bm25
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (ord), st GROUP BY query_id, ord),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, ord)::INT AS rank FROM w WHERE bm25 > 0) WHERE rank <= {m})"""


RRF_SQL = """rrf AS (SELECT query_id, ord, round(coalesce(1.0::DOUBLE / (60 + h.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + l.rank), 0.0::DOUBLE), 9) AS rrf, h.rank AS r1, l.rank AS r2 FROM hier h FULL JOIN lex l USING (query_id, ord)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, r1 NULLS LAST, r2 NULLS LAST)::INT AS rank FROM rrf))"""

query("jon09", f"{WITH}, {SIM_SQL} SELECT query_id, ord, round(sim, 5) AS sim FROM sim")(
    lambda t: X.similarities(C(t).select("ord", "embedding"), Q(t)).select("query_id", "ord", F.round("sim", 5).alias("sim"))
)
query("top01", f"{WITH}, {SIM_SQL}, {nn_sql(10)} SELECT query_id, ord, nn::INT AS rank, round(sim, 5) AS sim FROM nn")(
    lambda t: R.dense(C(t), Q(t), 10).select("query_id", "ord", F.col("nn").alias("rank"), F.round("sim", 5).alias("sim"))
)
query("win08", f"{WITH}, {SIM_SQL}, {nn_sql(5)} SELECT query_id, ord, nn::INT AS rank FROM nn")(lambda t: R.dense(C(t), Q(t), 5).select("query_id", "ord", F.col("nn").alias("rank")))


def _near(t, most=500):
    """The chunks' neighbour graphs, of ``most`` vectors each, and what a search of all cells finds."""
    return A.NeighbourIndex(t.spark, G.shared_path(t.spark, "neighbours")).build(C(t).select("ord", "embedding"), most).search(Q(t), 10)


query("top01_ann")(_near)
# what it finds of the exact ten: at least 19 of 20
query("top01_recall", f"{WITH}, {SIM_SQL}, {nn_sql(10)} SELECT count(*) AS exact, true AS enough FROM nn")(
    lambda t: X.nearest(C(t).select("ord", "embedding"), Q(t), 10).join(_near(t).select("query_id", "ord", F.lit(1).alias("hit")), ["query_id", "ord"], "left").agg(F.count("*").alias("exact"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.95 * F.count("*")).alias("enough"))
)
_HIER = "SELECT query_id, rank, ord, chunk_score, section_score, score FROM hier"
query("rag03", f"{WITH}, {hier_sql(8, 48)} {_HIER}")(lambda t: R.hierarchical(C(t), S(t), Q(t), 8).select("query_id", "rank", "ord", "chunk_score", "section_score", "score"))
query("top02", f"{WITH}, {hier_sql(5, 30)} {_HIER}")(lambda t: R.hierarchical(C(t), S(t), Q(t), 5).select("query_id", "rank", "ord", "chunk_score", "section_score", "score"))
query("jon05", f"{WITH}, {hier_sql(1000000, 30)} SELECT query_id, ord, section_score FROM hier")(lambda t: R.hierarchical(C(t), S(t), Q(t), 1000000, 30).select("query_id", "ord", "section_score"))
_BM = "SELECT query_id, rank, ord, bm25 FROM lex"
query("top03", f"{WITH}, {bm25_sql(30)} {_BM}")(lambda t: R.bm25(C(t), Q(t), 30).select("query_id", "rank", "ord", "bm25"))


def _index(t):
    """Two segments, merged to one."""
    path = G.shared_path(t.spark, "index")
    two = L.Index(t.spark, path, 64)
    two.add(C(t).where("ord % 2 = 0").select("ord", "text"), "even")
    two.add(C(t).where("ord % 2 = 1").select("ord", "text"), "odd")
    return two.merge(["even", "odd"], "all")


query("top03_index", f"{WITH}, {bm25_sql(30)} {_BM}")(lambda t: _index(t).search(Q(t), 30, G.cut).select("query_id", "rank", "ord", "bm25"))
query("agg14_index", f"""WITH {CHUNK_SQL} SELECT term, count(DISTINCT ord) AS df FROM (SELECT ord, unnest({TOKENS('text')}) AS term FROM chunk) GROUP BY term""")(lambda t: _index(t).frequencies())
query("mth06", f"{WITH}, {bm25_sql(1000000)} SELECT query_id, ord, bm25 FROM lex")(lambda t: R.bm25_unranked(C(t), Q(t), 1000000))
query("agg14", f"""WITH {CHUNK_SQL}, tok AS (SELECT ord, unnest({TOKENS('text')}) AS term FROM chunk), tf AS (SELECT term, ord, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM chunk)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(any_value(ln((n - df_ + 0.5::DOUBLE) / (df_ + 0.5::DOUBLE) + 1.0::DOUBLE)), 6) AS idf FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df_ FROM tf), n GROUP BY term""")(
    lambda t: R.postings(C(t)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).join(F.broadcast(C(t).agg(F.count("*").alias("n")))).select("term", "df", "cf", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0), 6).alias("idf"))
)
_FUSED = "SELECT query_id, rank, ord, round(rrf, 5) AS rrf_score FROM fused WHERE rank <= {k}"
for _name, _k in (("rag04", 8), ("top04", 5), ("jon08", 48)):
    query(_name, f"{WITH}, {hier_sql(48 if _k != 5 else 30, 288 if _k != 5 else 180)}, {bm25_sql(48 if _k != 5 else 30)}, {RRF_SQL} {_FUSED.format(k=_k)}")(
        lambda t, k=_k: R.fuse(R.hierarchical(C(t), S(t), Q(t), 48 if k != 5 else 30), R.bm25(C(t), Q(t), 48 if k != 5 else 30), k)
    )
query("win01", f"{WITH}, {hier_sql(8, 48)}, {bm25_sql(8)} SELECT query_id, ord, 'dense' AS list, (rank - 1)::INT AS position FROM hier UNION ALL SELECT query_id, ord, 'lexical', (rank - 1)::INT FROM lex")(
    lambda t: R.hierarchical(C(t), S(t), Q(t), 8).select("query_id", "ord", F.lit("dense").alias("list"), (F.col("rank") - 1).alias("position")).unionByName(R.bm25(C(t), Q(t), 8).select("query_id", "ord", F.lit("lexical").alias("list"), (F.col("rank") - 1).alias("position")))
)


def mmr_sql(k: int) -> str:
    return f"""pair AS (SELECT a.query_id, a.ord AS o1, b.ord AS o2, {DOT('c1.embedding', 'c2.embedding')} AS d FROM hier a JOIN hier b USING (query_id) JOIN chunk c1 ON c1.ord = a.ord JOIN chunk c2 ON c2.ord = b.ord),
step AS (SELECT query_id, 0 AS n, []::BIGINT[] AS picks, []::VARCHAR[] AS urls, NULL::BIGINT AS ord, NULL::DOUBLE AS v FROM q
UNION ALL SELECT query_id, n, list_append(picks, ord), list_append(urls, url), ord, v FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, rank) AS best FROM (
  SELECT s.query_id, s.n + 1 AS n, s.picks, s.urls, h.ord, h.url, h.rank,
   round(0.5::DOUBLE * h.score - 0.5::DOUBLE * (coalesce(list_max(list_transform(list_filter(p.near, lambda z: list_contains(s.picks, z.o)), lambda z: z.d)), 0.0::DOUBLE) + CASE WHEN list_contains(s.urls, h.url) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END), 9) AS v
  FROM step s JOIN hier h ON h.query_id = s.query_id JOIN (SELECT query_id, o1, list({{'o': o2, 'd': d}}) AS near FROM pair GROUP BY ALL) p ON p.query_id = h.query_id AND p.o1 = h.ord WHERE s.n < {k} AND NOT list_contains(s.picks, h.ord))) WHERE best = 1)"""


@query("top05", f"{WITH}, {hier_sql(48, 48)}, {mmr_sql(6)} SELECT query_id, n::INT AS rank, ord, round(v, 4) AS mmr_score FROM step WHERE n > 0")
def _top05(t):
    hits = R.hierarchical(C(t), S(t), Q(t), 48, 48).select("query_id", "ord", "url", "score", "rank")
    return R.diversify(hits, C(t), 6).select("query_id", "rank", "ord", "mmr_score")


query("top06", f"{WITH}, ss AS (SELECT query_id, s.id, {DOT('s.embedding', 'q.qv')} AS s, s.ord FROM section s, q) SELECT * FROM (SELECT query_id, id, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ord)::INT AS rank FROM ss) WHERE rank <= 50")(
    lambda t: X.nearest(S(t).select("id", "ord", "embedding"), Q(t), 50, rank="rank").select("query_id", "id", F.round("sim", 4).alias("score"), "rank")
)
query("flt13", f"{WITH}, ss AS (SELECT query_id, s.id, {DOT('s.embedding', 'q.qv')} AS s, s.ord FROM section s, q WHERE s.url IN ('u0', 'u1', 'u2', 'u3', 'u4', 'u5')) SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ord)::INT AS rank FROM ss) WHERE rank <= 3")(
    lambda t: X.nearest(S(t).where(F.col("url").isin(*[f"u{i}" for i in range(6)])).select("id", "ord", "embedding"), Q(t), 3, rank="rank").select("query_id", "id", "rank")
)


@query("flt14", f"{WITH}, {hier_sql(1000000, 48)}, ts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, section_id) AS r FROM ss) WHERE r <= 3) SELECT query_id, h.ord, h.score FROM hier h SEMI JOIN ts ON ts.query_id = h.query_id AND ts.section_id = h.section_id")
def _flt14(t):
    best = X.nearest(S(t).select(F.col("id").alias("section_id"), "embedding"), Q(t), 3, tie="section_id")
    return R.hierarchical(C(t), S(t), Q(t), 1000000, 48).join(best.select("query_id", "section_id"), ["query_id", "section_id"], "left_semi").select("query_id", "ord", "score")


@query("top08", f"""{WITH}, {hier_sql(8, 48)}, o AS (SELECT query_id, unnest([(query_id * 3) % 9, 2, 2, 99, 0]) AS position, unnest(range(0, 5)) AS place FROM q), m AS (SELECT query_id, position, min(place) AS place FROM o GROUP BY ALL)
SELECT * FROM (SELECT h.query_id, ord, round(coalesce(1.0::DOUBLE / (place + 1), 0.0::DOUBLE), 4) AS rerank_score, row_number() OVER (PARTITION BY h.query_id ORDER BY place NULLS LAST, h.rank)::INT AS rank FROM hier h LEFT JOIN m ON m.query_id = h.query_id AND m.position = h.rank - 1) WHERE rank <= 6""")
def _top08(t):
    rankings = Q(t).select("query_id", F.array(F.expr("cast(query_id * 3 % 9 as int)"), *map(F.lit, (2, 2, 99, 0))).alias("ranking"))
    return R.rerank(R.hierarchical(C(t), S(t), Q(t), 8).select("query_id", "ord", "rank"), rankings, 6).select("query_id", "ord", "rerank_score", "rank")


_TOK = "greatest(1, length(text) // 4)"


def budget_sql(budget: int) -> str:
    return f"""it AS (SELECT *, {_TOK} AS tokens FROM item WHERE text <> ''), run AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used, row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1 AS head FROM it),
ok AS (SELECT *, min(CASE WHEN head OR (used <= {budget} AND used - tokens < {budget}) THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS whole FROM run)"""


def _items(t):
    return R.hierarchical(C(t), S(t), Q(t), 20, 48).join(C(t).select("ord", "text"), "ord").select("query_id", "ord", "rank", "text")


query("win02", f"{WITH}, {hier_sql(20, 48)}, item AS (SELECT query_id, ord, rank, text FROM hier JOIN chunk USING (ord)), {budget_sql(3000)} SELECT query_id, ord, tokens::BIGINT AS tokens, used::BIGINT AS used FROM ok WHERE whole = 1")(
    lambda t: R.within_budget(_items(t), 3000).select("query_id", "ord", "tokens", "used")
)


@query("win03", f"{WITH}, {hier_sql(20, 48)}, item AS (SELECT query_id, ord, rank, text FROM hier JOIN chunk USING (ord)), {budget_sql(3000)}, u AS (SELECT query_id, max(used) AS used FROM ok WHERE whole = 1 GROUP BY query_id) SELECT query_id, ord, length(substr(text, 1, (greatest(0, 3000 - used) * 4)::INT)) AS kept FROM item JOIN u USING (query_id) WHERE rank = 20")
def _win03(t):
    items = _items(t)
    used = R.within_budget(items, 3000).groupBy("query_id").agg(F.max("used").alias("used"))
    room = F.greatest(F.lit(0), 3000 - F.col("used")) * 4
    return items.where("rank = 20").join(used, "query_id").select("query_id", "ord", F.length(F.substr("text", F.lit(1), room.cast("int"))).cast("long").alias("kept"))


query("agg17", f"WITH {CHUNK_SQL} SELECT section_id, sha256(string_agg(text, chr(10) ORDER BY position, ord)) AS full_text, count(*) AS n FROM chunk GROUP BY section_id")(
    lambda t: C(t).groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("position", "ord", "text"))).alias("c"), F.count("*").alias("n")).select("section_id", F.sha2(F.array_join(F.transform("c", lambda x: x["text"]), "\n"), 256).alias("full_text"), "n")
)
query("jon12", f"WITH {CHUNK_SQL}, {SECTION_SQL} SELECT s.id, s.url, count(c.id) AS n_chunks, coalesce(string_agg(c.id, ' ' ORDER BY c.position, c.ord), '') AS ids FROM section s LEFT JOIN chunk c ON c.section_id = s.id GROUP BY s.id, s.url")(
    lambda t: S(t).select("id", "url").join(C(t).groupBy(F.col("section_id").alias("sid")).agg(F.array_sort(F.collect_list(F.struct("position", "ord", F.col("id").alias("cid")))).alias("c")), F.col("id") == F.col("sid"), "left").select("id", "url", F.coalesce(F.size("c"), F.lit(0)).cast("long").alias("n_chunks"), F.coalesce(F.array_join(F.transform("c", lambda x: x["cid"]), " "), F.lit("")).alias("ids"))
)
query("agg02", f"WITH {CHUNK_SQL} SELECT count(DISTINCT url) AS documents, count(*) AS chunks, max(len(embedding))::INT AS dim, count(DISTINCT section_id) AS sections FROM chunk WHERE url <> ''")(
    lambda t: C(t).where("url <> ''").agg(F.countDistinct("url").alias("documents"), F.count("*").alias("chunks"), F.max(F.size("embedding")).alias("dim"), F.countDistinct("section_id").alias("sections"))
)


@query("agg18", f"""WITH {CHUNK_SQL}, {SECTION_SQL}, o AS (SELECT url, arg_min(overview, ord) FILTER (overview <> '') AS overview FROM section GROUP BY url), s AS (SELECT url, string_agg(substr(text, 1, 300), ' … ' ORDER BY ord) AS s FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS k FROM chunk) WHERE k <= 2 GROUP BY url)
SELECT url, substr(concat_ws(' … ', overview, s), 1, 900) AS digest FROM s LEFT JOIN o USING (url)""")
def _agg18(t):
    overview = S(t).where("overview <> ''").groupBy("url").agg(F.min_by("overview", "ord").alias("overview"))
    two = R.top(C(t), 2, F.col("ord"), by="url").groupBy("url").agg(F.array_sort(F.collect_list(F.struct("ord", F.substring("text", 1, 300).alias("s")))).alias("x"))
    return two.join(overview, "url", "left").select("url", F.substring(F.concat_ws(" … ", "overview", F.array_join(F.transform("x", lambda z: z["s"]), " … ")), 1, 900).alias("digest"))


query("agg19", f"WITH {CHUNK_SQL}, {SECTION_SQL} SELECT url, arg_min(overview, ord) AS overview, arg_min(id, ord) AS id FROM section GROUP BY url")(lambda t: S(t).groupBy("url").agg(F.min_by("overview", "ord").alias("overview"), F.min_by("id", "ord").alias("id")))
query("agg21", "SELECT source, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents GROUP BY source")(lambda t: t.documents.groupBy("source").agg(F.sum(text.estimated_tokens(F.col("text"))).alias("tokens")))
query("win05", f"WITH {CHUNK_SQL} SELECT url, id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY length(text) DESC, ord) AS k FROM chunk) WHERE k = 1")(lambda t: R.top(C(t), 1, F.desc(F.length("text")), F.col("ord"), by="url").select("url", "id"))
query("win04", "SELECT conv_id, turn, '[' || row_number() OVER w || '/' || count(*) OVER (PARTITION BY conv_id) || ']' AS part, 'part:' || row_number() OVER w || '/' || count(*) OVER (PARTITION BY conv_id) AS tag FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")(
    lambda t: t.conversations.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).select("conv_id", "turn", F.format_string("[%d/%d]", "i", "n").alias("part"), F.format_string("part:%d/%d", "i", "n").alias("tag"))
)
query("win09", "SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role)")(
    lambda t: R.first_seen(t.conversations, "conv_id", "role", "turn").select("conv_id", "role", "turn", "place")
)


# the router: every question in each of its modes; as the order that a model would give, places by a rule
_RANKED_SQL = """cand AS (SELECT query_id, ord, rank FROM fused WHERE rank <= 24), o AS (SELECT query_id, unnest([(query_id * 5) % 24, 3, 3, 77, 0]) AS position, unnest(range(0, 5)) AS place FROM q),
m AS (SELECT query_id, position, min(place) AS place FROM o GROUP BY ALL), reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, r)::INT AS rank FROM (SELECT c.query_id, c.ord, c.rank AS r, place FROM cand c LEFT JOIN m ON m.query_id = c.query_id AND m.position = c.rank - 1))"""
_MODES = {
    "hybrid": ({}, f"{WITH}, {hier_sql(36, 216)}, {bm25_sql(36)}, {RRF_SQL} SELECT query_id, rank, ord FROM fused WHERE rank <= 6"),
    "dense": ({"hybrid_": False}, f"{WITH}, {hier_sql(6, 36)} SELECT query_id, rank, ord FROM hier"),
    "diverse": ({"mmr": True}, f"{WITH}, {hier_sql(48, 48)}, {mmr_sql(6)} SELECT query_id, n::INT AS rank, ord FROM step WHERE n > 0"),
    "reranked": ({}, f"{WITH}, {hier_sql(144, 864)}, {bm25_sql(144)}, {RRF_SQL}, {_RANKED_SQL} SELECT query_id, rank, ord FROM reranked WHERE rank <= 6"),
}
query("rag01", " UNION ALL ".join(f"(SELECT '{mode}' AS mode, query_id, rank, ord FROM ({sql}))" for mode, (_, sql) in _MODES.items()))(lambda t: _rag01(t))


def _rag01(t):
    order = Q(t).select("query_id", F.array(F.expr("cast(query_id * 5 % 24 as int)"), *map(F.lit, (3, 3, 77, 0))).alias("ranking"))
    modes = {mode: options | ({"rankings": lambda hits: order} if mode == "reranked" else {}) for mode, (options, _) in _MODES.items()}
    # what all modes choose from, found once: the most that any of them asks for
    near, words = G.cut(R.dense(C(t), Q(t), R.overfetch(R.overfetch(24)))), G.cut(R.bm25(C(t), Q(t), R.overfetch(24)))
    parts = [R.retrieve(C(t), S(t), Q(t), 6, **options, near=near, words=words).select(F.lit(mode).alias("mode"), "query_id", "rank", "ord") for mode, options in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# answers: every cached text is in the focus of one question in eleven; the last of these has none
_FOCUS_SQL = f"""WITH {bind.CACHE_SQL}, asked AS (SELECT unnest(range(0, 11)) AS query_id), f AS (SELECT (ord % 10) AS query_id, ord AS rank, id, raw_text AS text, vectorized AND vector_projected_hash = content_hash AS fresh FROM cache WHERE kind = 'text')"""


def _focus(t):
    fresh = (F.col("vectorized") & (F.col("vector_projected_hash") == F.col("content_hash"))).alias("fresh")
    return bind.cache_items(t).where("kind = 'text'").select((F.col("ord") % 10).alias("query_id"), F.col("ord").alias("rank"), "id", F.col("raw_text").alias("text"), fresh)


def _regimes(t):
    return R.regimes(t.spark.range(11).select(F.col("id").alias("query_id")), _focus(t), 100_000)


query("rag02", f"{_FOCUS_SQL} SELECT a.query_id, CASE WHEN count(f.id) = 0 THEN 'rag' WHEN sum({_TOK}) <= 100000 THEN 'icl-documents' ELSE 'icl-sections' END AS mode, coalesce(sum(CASE WHEN f.id IS NOT NULL THEN {_TOK} END), 0)::BIGINT AS tokens, count(*) FILTER (NOT fresh) AS stale_fallback FROM asked a LEFT JOIN f USING (query_id) GROUP BY a.query_id")(_regimes)
query("jon11", f"{_FOCUS_SQL} SELECT id, 'stale' AS side FROM f WHERE NOT fresh UNION ALL SELECT id, 'fresh' FROM f WHERE fresh")(
    lambda t: _focus(t).select("id", F.when(F.col("fresh"), "fresh").otherwise("stale").alias("side"))
)
query("rag05", f"WITH {CHUNK_SQL} SELECT id FROM chunk WHERE url NOT IN ('u1', 'u7')")(lambda t: C(t).join(C(t).where("url in ('u1', 'u7')").select("url").distinct(), "url", "left_anti").select("id"))
