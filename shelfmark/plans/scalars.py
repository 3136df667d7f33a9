"""Queries for the scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, jsons, text, vector
from .registry import query

# pieces of SQL
STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
SUB = lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')"
TOKENS = lambda x, p="[a-z0-9]+": f"regexp_extract_all(lower(coalesce({x}, '')), '{p}')"
KEYWORDS = lambda x: f"list_distinct({TOKENS(x, '[a-z0-9]{3,}')})"
KEYWORD_SIM = lambda q, t: f"(CASE WHEN len({KEYWORDS(q)}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({KEYWORDS(q)}, {KEYWORDS(t)}))::DOUBLE / len({KEYWORDS(q)}) END)"
SLUG = lambda x: f"substr({SUB(SUB(SUB(STRIP(f'lower(coalesce({x}, {chr(39)*2}))'), '[^a-z0-9\\s]', ''), '\\s+', '-'), '^-+|-+$', '')}, 1, 60)"
SKILL_SLUG = lambda x: f"substr({SUB(SUB(SUB(STRIP(f'lower({x})'), '[^a-z0-9\\s-]', ''), '[\\s-]+', '-'), '^-+|-+$', '')}, 1, 60)"
URL_SLUG = lambda x: f"coalesce(nullif(substr({SUB(SUB(SUB(f'lower({x})', '^https?://', ''), '[^a-z0-9]+', '-'), '^-+|-+$', '')}, 1, 80), ''), 'doc')"
NORMAL = lambda x: STRIP(SUB(SUB(SUB(x, r"\r\n?", r"\n").replace(r"'\n'", "chr(10)"), r"\n{3,}", r"\n\n").replace(r"'\n\n'", "chr(10) || chr(10)"), r"[ \t]+", " "))
SENTENCES = lambda x: rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {STRIP('s')}), lambda s: s <> '')"
DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
COSINE = lambda a, b: f"({DOT(a, b)} / (sqrt({DOT(a, a)}) * sqrt({DOT(b, b)})))"


def of(table: str, key: str, columns):
    """A projection of one table: the key and some columns, which are made when there is a session."""
    return lambda t: getattr(t, table).select(key, *(c.alias(n) for n, c in columns().items()))


def plain(name: str, table: str, key: str, columns, sql: dict) -> None:
    query(name, f"SELECT {key}, " + ", ".join(f"{x} AS {n}" for n, x in sql.items()) + f" FROM {table}")(of(table, key, columns))


T = lambda: F.col("text")
plain("str01", "documents", "doc_id", lambda: {"slug": text.slug(T())}, {"slug": SLUG('text')})
query("str02", f"SELECT page_id, {SKILL_SLUG('url')} AS skill_slug, {URL_SLUG('url')} AS url_slug FROM pages")(
    of("pages", "page_id", lambda: {"skill_slug": text.skill_slug(F.col("url")), "url_slug": text.url_slug(F.col("url"))})
)
plain(
    "str03", "documents", "doc_id", lambda: {"long_preview": text.preview(T(), 240, trimmed=False), "preview": text.preview(T(), 200)},
    {"long_preview": "CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '…' ELSE text END", "preview": f"CASE WHEN length({STRIP('text')}) > 200 THEN substr({STRIP('text')}, 1, 200) || '…' ELSE {STRIP('text')} END"},
)
_LEAD = STRIP("substr(text, 1, 280)")
plain("str04", "documents", "doc_id", lambda: {"snippet": text.snippet(T())}, {"snippet": rf"CASE WHEN length(text) > length({_LEAD}) THEN CASE WHEN contains({_LEAD}, ' ') THEN regexp_extract({_LEAD}, '(?s)^(.*) ', 1) ELSE {_LEAD} END || '…' ELSE {_LEAD} END"})
plain("str05", "pages", "page_id", lambda: {"normal": text.normalize(F.col("html"))}, {"normal": NORMAL("html")})
plain("str06", "documents", "doc_id", lambda: {"n_tokens": F.size(text.tokens(T())).cast("long"), "n_keywords": F.size(text.keywords(T())).cast("long"), "first_tokens": F.array_join(F.slice(text.tokens(T()), 1, 12), " ")},
      {"n_tokens": f"len({TOKENS('text')})", "n_keywords": f"len({KEYWORDS('text')})", "first_tokens": f"array_to_string(({TOKENS('text')})[1:12], ' ')"})


@query("str07", f"""WITH k AS (SELECT item_id, unnest({KEYWORDS('text')}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM k GROUP BY item_id), d AS (SELECT doc_id, unnest({KEYWORDS('text')}) AS w FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS c FROM k JOIN d USING (w) GROUP BY ALL), r AS (SELECT item_id, doc_id, c::DOUBLE / n AS s, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS k FROM s JOIN n USING (item_id))
SELECT item_id, doc_id, round(s, 9) AS similarity FROM r WHERE k <= 5""")
def _str07(t):
    """For each item the five documents that hold most of its keywords, by the words they share."""
    from ..operators.retrieval import top

    items = t.benchmark.select("item_id", text.keywords(T()).alias("ks")).select("item_id", F.size("ks").alias("n"), F.explode("ks").alias("w"))
    docs = t.documents.select("doc_id", text.keywords(T()).alias("ks")).select("doc_id", F.explode("ks").alias("w"))
    shared = items.join(docs, "w").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("c"))
    return top(shared, 5, F.desc("c"), F.col("doc_id"), by="item_id").select("item_id", "doc_id", F.round(F.col("c") / F.col("n"), 9).alias("similarity"))


plain("str09", "documents", "doc_id", lambda: {"name_key": text.name_key(T())}, {"name_key": "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"})
plain("str10", "conversations", "conv_id", lambda: {"turn_no": F.col("turn"), "normal": text.collapse(T())}, {"turn_no": "turn", "normal": SUB(STRIP("lower(coalesce(text, ''))"), r"\s+", " ")})
_ANSWER = lambda: F.concat(F.lit("# Answer\n"), T(), F.lit("\n\n  ## Part\nmore "), F.lit("\n## Key sources\n- [1] x"))
_ANSWER_SQL = "('# Answer' || chr(10) || text || chr(10) || chr(10) || '  ## Part' || chr(10) || 'more ' || chr(10) || '## Key sources' || chr(10) || '- [1] x')"
plain("str11", "benchmark", "item_id", lambda: {"gist": text.gist(_ANSWER())},
      {"gist": STRIP(rf"substr(array_to_string(list_filter(list_transform(string_split(regexp_extract({_ANSWER_SQL}, '(?is)^(.*?)\n#{{1,6}}\s*(?:Key sources|Citations|Sources)\b', 1), chr(10)), lambda s: {STRIP('s')}), lambda s: s <> '' AND NOT starts_with(s, '#')), ' '), 1, 400)")})
plain("str12", "documents", "doc_id", lambda: {"lines": F.to_json(text.lines_of(T())), "parts": F.size(F.filter(F.transform(F.split(T(), "[\n,]"), text.strip), lambda s: s != "")).cast("long")},
      {"lines": f"to_json(list_filter(list_transform(string_split(text, chr(10)), lambda s: {STRIP('s')}), lambda s: s <> ''))::VARCHAR", "parts": rf"len(list_filter(list_transform(string_split_regex(text, '[\n,]'), lambda s: {STRIP('s')}), lambda s: s <> ''))"})


@query("str13", """SELECT label, string_agg(printf('[%d] doc %d (%s) - %s', n, doc_id, lang, source), chr(10) || chr(10) ORDER BY n) AS context FROM (
SELECT label, doc_id, lang, source, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings JOIN documents ON doc_id = vec_id) WHERE n <= 6 GROUP BY label""")
def _str13(t):
    from pyspark.sql import Window

    hits = t.embeddings.join(t.documents, F.col("doc_id") == F.col("vec_id")).withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 6")
    return hits.withColumn("line", F.format_string("[%d] doc %d (%s) - %s", "n", "doc_id", "lang", "source")).groupBy("label").agg(F.expr("listagg(line, '\n\n') WITHIN GROUP (ORDER BY n)").alias("context"))


plain("str14", "documents", "doc_id", lambda: {"embed_text": F.concat_ws("\n", F.concat(F.lit("Document: "), F.col("source")), F.concat(F.lit("Language: "), F.col("lang")), F.lit(""), F.substring("text", 1, 200))},
      {"embed_text": "concat_ws(chr(10), 'Document: ' || source, 'Language: ' || lang, '', substr(text, 1, 200))"})
plain("str15", "documents", "doc_id", lambda: {"placeholder": text.has_placeholder(F.concat(T(), F.when(F.col("doc_id") % 7 == 0, " todo ").otherwise(""))), "steps": text.numbered_steps(F.regexp_replace(T(), r"\n", "\n- ")).cast("long")},
      {"placeholder": r"regexp_matches(text || CASE WHEN doc_id % 7 = 0 THEN ' todo ' ELSE '' END, '(?i)\b(TODO|TBD|FIXME|XXX|lorem ipsum|your (?:skill|task|tool) here|placeholder)\b|<[a-z_]{3,}>')",
       "steps": r"len(regexp_extract_all(replace(text, chr(10), chr(10) || '- '), '(?m)^\s*(?:\d+[.)]|[-*])\s+\S'))"})
plain("str16", "documents", "doc_id", lambda: {"sha256": F.sha2("text", 256)}, {"sha256": "sha256(text)"})
plain("str17", "documents", "doc_id", lambda: {"n_sentences": F.size(text.sentences(T())).cast("long"), "first": F.get(text.sentences(T()), F.lit(0))}, {"n_sentences": f"len({SENTENCES('text')})", "first": f"({SENTENCES('text')})[1]"})
plain("str18", "documents", "doc_id", lambda: {"metric": text.metric_key(T())}, {"metric": SUB(SUB("lower(text)", "[^a-z0-9]+", "_"), "^_+|_+$", "")})
plain("str19", "documents", "doc_id", lambda: {"identifier": text.identifier(T())}, {"identifier": "regexp_replace(text, '[^A-Za-z0-9_]', '', 'g')"})
plain("str20", "pages", "page_id", lambda: {"domain": text.domain(F.col("url"))}, {"domain": r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"})


@query("str21", """WITH g AS (SELECT conv_id, string_agg(substr(text, 1, 40), '; ' ORDER BY turn) FILTER (turn < 8) AS titles, min(text) FILTER (role = 'system') AS digest FROM conversations GROUP BY conv_id)
SELECT conv_id, substr(coalesce(nullif(digest, ''), 'Sources: ' || titles), 1, 1600) AS digest FROM g""")
def _str21(t):
    g = t.conversations.groupBy("conv_id").agg(
        F.expr("listagg(substr(text, 1, 40), '; ') WITHIN GROUP (ORDER BY turn) FILTER (WHERE turn < 8)").alias("titles"),
        F.min(F.when(F.col("role") == "system", T())).alias("digest"),
    )
    return g.select("conv_id", F.substring(F.coalesce(F.nullif("digest", F.lit("")), F.concat(F.lit("Sources: "), "titles")), 1, 1600).alias("digest"))


plain("str22", "documents", "doc_id", lambda: {"revision": F.when(text.strip(T()) != "", F.format_string("Revise with this note: %s", text.strip(T()))).otherwise("")}, {"revision": f"CASE WHEN {STRIP('text')} <> '' THEN 'Revise with this note: ' || {STRIP('text')} ELSE '' END"})

# dates
_STAMP = lambda: F.concat(F.lit("published "), F.date_format("ts", "yyyy/M/d"), F.lit(" at noon"))
_STAMP_SQL = "'published ' || strftime(ts, '%Y/%-m/%-d') || ' at noon'"
plain("dat01", "events", "event_id", lambda: {"day": dates.iso_date(_STAMP())}, {"day": rf"regexp_extract({_STAMP_SQL}, '(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})', 1) || '-' || lpad(regexp_extract({_STAMP_SQL}, '(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})', 2), 2, '0') || '-' || lpad(regexp_extract({_STAMP_SQL}, '(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})', 3), 2, '0')"})
plain("dat03", "events", "event_id", lambda: {"byline": dates.byline_date(F.concat(F.lit("By us, "), F.date_format("ts", "MMM d, yyyy"), F.lit(" in print")))}, {"byline": r"regexp_extract('By us, ' || strftime(ts, '%b %-d, %Y') || ' in print', '\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+[0-9]{1,2},?\s+[0-9]{4}\b')"})
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
plain("dat04", "events", "event_id", lambda: {"recency": F.round(dates.recency(F.col("ts"), F.expr(_NOW)), 9)}, {"recency": f"round(greatest(0.0::DOUBLE, 1.0 - (epoch_us({_NOW}) - epoch_us(ts)) / (86400e6 * 30)), 9)"})
plain("dat05", "events", "event_id", lambda: {"start_us": F.unix_micros(F.col("ts").cast("timestamp")) - F.round(F.abs("value") * 1000).cast("long")}, {"start_us": "epoch_us(ts)::BIGINT - round(abs(value) * 1000)::BIGINT"})

# vectors
E = lambda: F.col("embedding")
query("mth01", f"WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt({DOT('e', 'e')}) AS l FROM s), v AS (SELECT vec_id, list_transform(e, lambda x: x / l) AS u FROM n) SELECT vec_id, round(sqrt({DOT('u', 'u')}), 6) AS norm, round(u[1], 6) AS first FROM v")(
    lambda t: t.embeddings.select("vec_id", vector.unit(F.transform(E(), lambda x: x.cast("double") * 3)).alias("u")).select("vec_id", F.round(vector.norm(F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))
)


def _pairs(t, of=lambda x: x):
    """Products of every vector with each whose number is divisible by 20."""
    from ..operators import vectors

    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), of(E()).alias("qv"))
    return vectors.similarities(t.embeddings.select("vec_id", of(E()).alias("embedding")), queries).where("vec_id <> query_id")


query("mth02", f"SELECT q.vec_id AS query_id, v.vec_id, round({DOT('v.embedding', 'q.embedding')} / (sqrt({DOT('v.embedding', 'v.embedding')}) * sqrt({DOT('q.embedding', 'q.embedding')})), 4) + 0.0::DOUBLE AS cosine FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id")(
    lambda t: _pairs(t, vector.unit).select("query_id", "vec_id", (F.round("sim", 4) + 0.0).alias("cosine"))
)
query("mth03", f"SELECT q.vec_id AS query_id, v.vec_id, round({DOT('v.embedding', 'q.embedding')}, 5) + 0.0::DOUBLE AS product FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id")(
    lambda t: _pairs(t).select("query_id", "vec_id", (F.round("sim", 5) + 0.0).alias("product"))
)
plain("mth04", "events", "event_id", lambda: {"r3": F.round("value", 3), "r4": F.round("value", 4)}, {"r3": "round(value, 3)", "r4": "round(value, 4)"})
plain("mth05", "events", "event_id", lambda: {"clamped": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 50))}, {"clamped": "greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 50))"})
plain("mth07", "events", "event_id", lambda: {"size": F.greatest(F.lit(200), F.least(F.lit(4000), F.floor(F.col("value") * 100))).cast("long")}, {"size": "greatest(200, least(4000, floor(value * 100)))::BIGINT"})
RANKS = {"AMBIGUOUS": 0, "INFERRED": 1, "EXTRACTED": 2, "CONFIRMED": 3, "USER": 4}
_NAMES = "AMBIGUOUS INFERRED EXTRACTED CONFIRMED USER ODD".split()


def confidence_rank(c):
    """Ranks of confidence; unknown ones count as INFERRED."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv)), F.upper(F.coalesce(c, F.lit("")))), F.lit(1))


plain("mth08", "events", "event_id", lambda: {"rank": confidence_rank(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 6 + 1).cast("int")))}, {"rank": "([0, 1, 2, 3, 4, 1])[event_id % 6 + 1]::INT"})
plain("mth10", "events", "event_id", lambda: {"score": F.round(F.col("value") / 100 + 0.04 * (F.col("user_id") % 5 + 1 - 3) + 0.02 * dates.recency(F.col("ts"), F.expr(_NOW)), 6)}, {"score": f"round(value / 100 + 0.04 * (user_id % 5 + 1 - 3) + 0.02 * greatest(0.0::DOUBLE, 1.0 - (epoch_us({_NOW}) - epoch_us(ts)) / (86400e6 * 30)), 6)"})

# arrays
_L = lambda: text.lines_of(T())
_L_SQL = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {STRIP('s')}), lambda s: s <> '')"
_TOK = lambda: text.tokens(T())
plain("arr01", "documents", "doc_id", lambda: {"first_the": F.array_position(_TOK(), "the").cast("long"), "reciprocal": F.round(F.when(F.array_position(_TOK(), "the") > 0, 1 / F.array_position(_TOK(), "the")).otherwise(0.0), 6)},
      {"first_the": f"coalesce(list_position({TOKENS('text')}, 'the'), 0)::BIGINT", "reciprocal": f"round(CASE WHEN coalesce(list_position({TOKENS('text')}, 'the'), 0) > 0 THEN 1.0::DOUBLE / list_position({TOKENS('text')}, 'the') ELSE 0.0 END, 6)"})
plain("mth09", "documents", "doc_id", lambda: {"rr": F.round(F.when(F.array_position(_TOK(), "de") > 0, 1 / F.array_position(_TOK(), "de")).otherwise(0.0), 6)}, {"rr": f"round(CASE WHEN coalesce(list_position({TOKENS('text')}, 'de'), 0) > 0 THEN 1.0::DOUBLE / list_position({TOKENS('text')}, 'de') ELSE 0.0 END, 6)"})
plain("arr02", "documents", "doc_id", lambda: {"head": F.array_join(F.slice(_TOK(), 1, 5), " ")}, {"head": f"array_to_string(({TOKENS('text')})[1:5], ' ')"})
query("arr03", f"WITH w AS (SELECT doc_id, {TOKENS('text')} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w), m AS (SELECT doc_id, x, min(i) AS i FROM p GROUP BY doc_id, x), j AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM m GROUP BY doc_id) SELECT d.doc_id, coalesce(s, '') AS distinct_tokens FROM documents d LEFT JOIN j USING (doc_id)")(lambda t: t.documents.select("doc_id", F.array_join(F.array_distinct(_TOK()), " ").alias("distinct_tokens")))
plain("arr04", "documents", "doc_id", lambda: {"any_long": F.exists(_TOK(), lambda x: F.length(x) > 15), "all_short": F.forall(_TOK(), lambda x: F.length(x) < 25)}, {"any_long": f"len(list_filter({TOKENS('text')}, lambda x: length(x) > 15)) > 0", "all_short": f"len(list_filter({TOKENS('text')}, lambda x: length(x) >= 25)) = 0"})
query("arr05", f"SELECT conv_id, len(flatten(list({TOKENS('text')})))::BIGINT AS n_tokens FROM conversations GROUP BY conv_id")(lambda t: t.conversations.groupBy("conv_id").agg(F.size(F.flatten(F.collect_list(text.tokens(T())))).cast("long").alias("n_tokens")))
query("arr06", "SELECT source, string_agg(doc_id || ' (' || lang || ')', '; ' ORDER BY doc_id) AS listed FROM documents GROUP BY source")(
    lambda t: t.documents.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", "lang"))).alias("x")).select("source", F.array_join(F.transform(F.arrays_zip(F.col("x.doc_id").alias("d"), F.col("x.lang").alias("l")), lambda z: F.concat(z["d"].cast("string"), F.lit(" ("), z["l"], F.lit(")"))), "; ").alias("listed"))
)
query("arr07", "SELECT source, list(doc_id ORDER BY doc_id)::VARCHAR AS docs FROM documents GROUP BY source")(lambda t: t.documents.groupBy("source").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("doc_id")), ", "), F.lit("]")).alias("docs")))
plain("arr08", "documents", "doc_id", lambda: {"title": F.coalesce(F.try_element_at(F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German")), F.col("lang")), F.lit("other"))}, {"title": "CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END"})
query("arr09", "SELECT event_type, arg_max(event_id, (value, -event_id)) AS best, arg_min(event_id, (value, event_id)) AS worst FROM events GROUP BY event_type")(lambda t: t.events.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.min_by("event_id", F.struct("value", "event_id")).alias("worst")))
plain("arr10", "documents", "doc_id", lambda: {"sorted_tokens": F.array_join(F.array_sort(F.array_distinct(_TOK())), " ")}, {"sorted_tokens": f"array_to_string(list_sort(list_distinct({TOKENS('text')})), ' ')"})
plain("arr11", "documents", "doc_id", lambda: {"n_lines": F.size(_L()).cast("long"), "longest": F.array_max(F.transform(_L(), F.length))}, {"n_lines": f"len({_L_SQL})", "longest": f"list_max(list_transform({_L_SQL}, lambda s: length(s)))::INT"})

# answers of models, as texts around the events' properties
_FENCED = lambda: F.concat(F.lit("```json\nHere: "), F.when(F.col("event_id") % 5 == 0, "no object").otherwise(F.col("props")), F.lit(" bye\n```"))
_OBJ_SQL = r"regexp_extract('Here: ' || CASE WHEN event_id % 5 = 0 THEN 'no object' ELSE props END || ' bye', '(?s)\{.*\}')"
plain("jsn01", "events", "event_id", lambda: {"object": jsons.object_text(_FENCED()), "k": jsons.field(_FENCED(), "$.k")}, {"object": _OBJ_SQL, "k": f"CASE WHEN json_valid({_OBJ_SQL}) THEN json_extract_string({_OBJ_SQL}, '$.k') END"})
_JUDGE = lambda: F.when(F.col("event_id") % 3 == 0, F.format_string('{"score": %s, "reason": "x"}', F.round(F.col("value") / 1000, 3).cast("string"))).when(F.col("event_id") % 3 == 1, F.format_string("I give it 0.%d overall", (F.col("event_id") % 90 + 10).cast("int"))).otherwise("unclear")
plain("jsn02", "events", "event_id", lambda: {"score": jsons.judge_score(_JUDGE())}, {"score": "CASE event_id % 3 WHEN 0 THEN round(value / 1000, 3) WHEN 1 THEN ('0.' || (event_id % 90 + 10))::DOUBLE END"})


def clamped(c, key):
    """A rubric score held to [0, 1]; null where it is missing or no number."""
    x = jsons.field(c, f"$.{key}").try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


_RUBRIC = lambda: F.format_string('{"clarity": %s, "safety": "%s"}', F.round(F.col("value") / 50, 3).cast("string"), F.when(F.col("event_id") % 2 == 0, "0.25").otherwise("high"))
plain("jsn03", "events", "event_id", lambda: {"clarity": clamped(_RUBRIC(), "clarity"), "safety": clamped(_RUBRIC(), "safety"), "scope": clamped(_RUBRIC(), "scope")}, {"clarity": "greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(value / 50, 3)))", "safety": "CASE WHEN event_id % 2 = 0 THEN 0.25::DOUBLE END", "scope": "NULL::DOUBLE"})
query("dat06", "SELECT event_id, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")(of("events", "event_id", lambda: {"stamp": dates.utc_stamp(F.col("ts"))}))
_ENVELOPE = lambda: F.when(F.expr("event_id % 3 = 0"), F.format_string('{"type": "result", "result": "r%s"}', F.col("event_id").cast("string"))).otherwise(F.col("props"))
query("jsn04", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'r' || event_id ELSE props END AS result FROM events")(lambda t: t.events.select("event_id", F.coalesce(jsons.field(_ENVELOPE(), "$.result"), _ENVELOPE()).alias("result")))


@query("jsn05", """WITH s AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS i FROM conversations)
SELECT conv_id, i, CASE WHEN i % 2 = 0 THEN 'about ' || conv_id WHEN conv_id % 2 = 0 THEN 'overview' ELSE substr(text, 1, 160) END AS summary FROM s""")
def _jsn05(t):
    """Summaries by index; where one is missing the overview, else the section's start."""
    from pyspark.sql import Window

    sections = t.conversations.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    answer = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id",
        F.to_json(F.struct(
            F.when(F.col("conv_id") % 2 == 0, "overview").otherwise("").alias("overview"),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("n").cast("int")), lambda i: i % 2 == 0), lambda i: F.struct(i.alias("index"), F.concat(F.lit("about "), F.col("conv_id").cast("string")).alias("summary"))).alias("sections"),
        )).alias("raw"),
    )
    read = answer.withColumn("o", F.from_json(jsons.object_text(F.col("raw")), "overview string, sections array<struct<index:int, summary:string>>"))
    given = read.select("conv_id", F.explode("o.sections").alias("s")).select("conv_id", F.col("s.index").alias("i"), text.strip(F.col("s.summary")).alias("given"))
    joined = sections.join(read.select("conv_id", text.strip(F.col("o.overview")).alias("overview")), "conv_id").join(given, ["conv_id", "i"], "left")
    return joined.select("conv_id", "i", F.coalesce(F.nullif("given", F.lit("")), F.nullif("overview", F.lit("")), F.substring("text", 1, 160)).alias("summary"))


@query("jsn06", "SELECT event_id, 'e' || (event_id % 9) AS name, CASE WHEN event_id % 2 = 0 THEN 'person' ELSE 'concept' END AS kind FROM events WHERE event_id % 3 < 2")
def _jsn06(t):
    """Entities from an object, a list, or anything else (none)."""
    name = F.concat(F.lit("e"), (F.col("event_id") % 9).cast("string"))
    raw = F.when(F.col("event_id") % 3 == 0, F.format_string('{"entities": [{"name": "%s", "kind": "%s"}]}', name, F.when(F.col("event_id") % 2 == 0, "person").otherwise("concept")))
    raw = raw.when(F.col("event_id") % 3 == 1, F.format_string('[{"name": "%s", "kind": "%s"}]', name, F.when(F.col("event_id") % 2 == 0, "person").otherwise("concept"))).otherwise("none")
    kind = "array<struct<name:string, kind:string>>"
    both = t.events.select("event_id", raw.alias("raw")).withColumn("found", F.coalesce(F.from_json("raw", f"entities {kind}")["entities"], F.when(F.col("raw").startswith("["), F.from_json("raw", kind))))
    return both.select("event_id", F.explode("found").alias("x")).select("event_id", "x.name", "x.kind")


# artifacts: what a model answers by four, with a spec behind it
_SPEC = lambda: F.format_string('{"name": " spec %s ", "description": " sd ", "tools": ["none", "write"], "triggers": [" s "], "success_criteria": {"style": "plain"}}', F.col("event_id").cast("string"))


def _artifact_answer():
    k, i = F.expr("event_id % 4"), F.col("event_id").cast("string")
    first = F.format_string('```json\n{"name": " N%s ", "description": "D", "instructions": " Do it ", "tools": ["search", " NONE ", " read "], "tests": [{"prompt": "p%s", "should_trigger": true}, {"expect": "x"}, {"prompt": ""}, 7]}\n```', i, i)
    third = F.lit('so: {"steps": [" a ", "", "b"], "triggers": ["t", 5], "anti_triggers": [], "success_criteria": {"outcome": "o", "other": "z"}}')
    return F.when(k == 0, first).when(k == 1, F.lit('{"name": "", "tools": []}')).when(k == 2, third).otherwise("no object")


@query("jsn07", """WITH k AS (SELECT event_id, event_id % 4 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'N' || event_id ELSE 'spec ' || event_id END AS name, CASE k WHEN 0 THEN 'D' ELSE 'sd' END AS description, CASE k WHEN 0 THEN 'Do it' ELSE '' END AS instructions, CASE k WHEN 2 THEN 'a|b' ELSE '' END AS steps,
CASE k WHEN 2 THEN 't|5' ELSE 's' END AS triggers, '' AS anti_triggers, CASE k WHEN 0 THEN 'search|read' ELSE 'write' END AS tools, CASE k WHEN 2 THEN 'o' ELSE '' END AS outcome, CASE k WHEN 2 THEN '' ELSE 'plain' END AS style, CASE k WHEN 0 THEN 'p' || event_id ELSE '' END AS prompts FROM k""")
def _jsn07(t):
    a = t.events.select("event_id", jsons.artifact(_artifact_answer(), _SPEC()).alias("a"))
    join = lambda c: F.array_join(F.col(c), "|")
    return a.select(
        "event_id", "a.name", "a.description", "a.instructions", join("a.steps").alias("steps"), join("a.triggers").alias("triggers"), join("a.anti_triggers").alias("anti_triggers"), join("a.tools").alias("tools"),
        "a.success_criteria.outcome", "a.success_criteria.style", F.array_join(F.transform("a.tests", lambda x: F.get_json_object(x, "$.prompt")), "|").alias("prompts"),
    )


plain("jsn08", "events", "event_id", lambda: {"ranking": F.array_join(jsons.ranking(F.format_string('ok {"ranking": [%s, "x", 2, null, 0.0]}', (F.col("event_id") % 7).cast("string"))), ",")}, {"ranking": "(event_id % 7) || ',2,0'"})
plain("jsn09", "events", "event_id", lambda: {"k": F.get_json_object("props", "$.k").cast("long")}, {"k": "json_extract_string(props, '$.k')::BIGINT"})
query("src03", "SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(embedding)::DOUBLE, 3) + 0.0::DOUBLE AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)")(
    lambda t: t.embeddings.select("vec_id", F.size("embedding").alias("dim"), (F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 3) + F.lit(0.0)).alias("total"))
)
query("flt16", r"SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#\s]+') AS valid FROM pages")(of("pages", "page_id", lambda: {"valid": text.is_url(F.col("url"))}))
