"""Rules that the tables of the driver don't exercise: fixtures with known answers, and plain Python as the other side."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark import config, plugins, tools
from shelfmark.functions import dates, html, jsons, text
from shelfmark.operators import chunking as K
from shelfmark.operators import evaluation as V
from shelfmark.operators import graph as G
from shelfmark.operators import retrieval as R
from shelfmark.operators import stores as S
from shelfmark.sources import files
from shelfmark.sources.tables import VersionedTable, open_table
from shelfmark.streaming import ingest, lifecycle


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr).first()[0]


def plain_chunks(t, size, overlap):
    """The chunker as plain Python."""
    t = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", t.replace("\r\n", "\n").replace("\r", "\n"))).strip()
    if len(t) <= size:
        return [t] if t else []
    parts = []
    for p in filter(None, (x.strip() for x in re.split(r"\n{2,}", t))):
        if len(p) <= size:
            parts.append(p)
            continue
        held = ""
        for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", p))):
            if len(f"{held} {s}".strip()) <= size:
                held = f"{held} {s}".strip()
                continue
            parts += [held] if held else []
            held = s if len(s) <= size else ""
            parts += [s[i : i + size] for i in range(0, len(s), size)] if len(s) > size else []
        parts += [held] if held else []
    out, now = [], ""
    for p in parts:
        joined = f"{now}\n\n{p}".strip() if now else p
        if len(joined) <= size:
            now = joined
            continue
        tail = ""
        if now:
            out.append(now)
            tail = now if len(now) <= overlap else now[-overlap:] if overlap else ""
            gap = tail.find(" ")
            if len(now) > overlap and 0 < gap < overlap // 2:
                tail = tail[gap + 1 :]
            tail = tail if len(now) <= overlap else tail.strip()
        now = f"{tail}\n\n{p}".strip() if tail else p
    return out + ([now] if now else [])


@pytest.mark.parametrize(("size", "overlap"), [(40, 0), (40, 12), (25, 10), (200, 30)])
def test_chunks(spark, size, overlap):
    texts = ["", " \n ", "short", "One two three. Four five six! Seven eight nine? Ten.", "a" * 130, "P one is here.\n\nP two is a much longer paragraph. It has sentences. Many of them.\n\n\n\nEnd.", "x y " * 60, "w" * 39 + ". " + "v" * 41 + ". z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.c for r in df.select("id", K.chunk_array(F.col("text"), size, overlap).alias("c")).collect()}
    assert got == {i: plain_chunks(t, size, overlap) for i, t in enumerate(texts)}


def test_summary_of_short_sentences(spark):
    df = spark.createDataFrame([(1, "Too short. No."), (2, "The library keeps many useful documents here. Another sentence about library documents follows now. Bye.")], "doc_id int, text string")
    got = {r.doc_id: r.summary for r in K.summarize(df, most=1).collect()}
    assert got[1] == "Too short. No." and got[2].startswith("The library")


def test_entities(spark):
    t = "The Acme Corp met Ada Lovelace. Ada Lovelace spoke. Berlin was cold. In Berlin they met; Berlin again. Paris? No, Paris. This Figure."
    got = [r.name for r in G.heuristic_entities(spark.createDataFrame([(1, t)], "doc_id int, text string")).orderBy("place").collect()]
    assert got[:2] == ["Ada Lovelace", "Acme Corp"] and "Berlin" in got and "Figure" not in got


def test_html():
    page = '<html><body><nav>menu</nav><article><p>Hello <b>you</b><p>World<div class="related-posts">x</div><div id="cookie">y</div><span aria-hidden="true">z</span></article><footer>f</footer></body></html>'
    assert html.main_text(page).split("\n") == ["Hello", "you", "World"]
    assert html.page_date('<meta property="article:published_time" content="2026-03-14T10:00">') == "2026-03-14"
    assert html.page_date('<meta name="citation_date" content="2025/9/2">') == "2025-09-02"
    assert html.page_date('<script type="application/ld+json">{"datePublished": "2026-06-16"}</script>') == "2026-06-16"
    assert html.page_date('<time datetime="2025-12-01">x</time>') == "2025-12-01"
    assert html.page_date("<p>none</p>") == html.page_date("") == ""


def test_small_functions(spark):
    assert one(spark, text.slug(F.col("x")), x="  Ünder-score  A b!") == "nderscore-a-b"
    assert one(spark, text.skill_slug(F.col("x")), x="My - Skill  x") == "my-skill-x"
    assert one(spark, text.url_slug(F.col("x")), x="https://a.b/c?d") == "a-b-c-d"
    assert one(spark, text.url_slug(F.col("x")), x="---") == "doc"
    assert one(spark, dates.byline_date(F.col("x")), x="on Sept. 4, 2024 we") == "Sept. 4, 2024"
    assert one(spark, jsons.judge_score(F.col("x")), x='```json\n{"score": 0.4}\n```') == 0.4
    assert one(spark, jsons.judge_score(F.col("x")), x="about 0.7 I think") == 0.7
    assert one(spark, jsons.judge_score(F.col("x")), x="no 2.5") is None
    assert one(spark, text.gist(F.col("x")), x="# T\nA b.\n\nC.\n## Sources\n- z") == "A b. C."


def test_pdf_sniff(spark):
    rows = [("http://x/a", "application/pdf; q", b"x"), ("http://x/a.PDF?z", "", b"x"), ("http://x/a", "", b"%PDF-1.7"), ("http://x/a", "text/html", b"<html")]
    df = spark.createDataFrame(rows, "u string, t string, h binary").select(files.looks_like_pdf(F.col("u"), F.col("t"), F.col("h")).alias("p"))
    assert [r.p for r in df.collect()] == [True, True, True, False]


@pytest.fixture
def toy(spark):
    e = lambda i: [1.0 if k == i else 0.0 for k in range(8)]
    chunks = spark.createDataFrame([(0, "c0", "u1", "s0", 0, "alpha beta", e(0)), (1, "c1", "u1", "s0", 1, "gamma RAREWORD", e(1)), (2, "c2", "u2", "s1", 0, "delta epsilon", e(2))], "ord long, id string, url string, section_id string, position int, text string, embedding array<float>")
    sections = spark.createDataFrame([("s0", "u1", e(0)), ("s1", "u2", e(1))], "id string, url string, embedding array<float>")
    return chunks, sections, e


def test_hybrid(spark, toy):
    chunks, sections, e = toy
    q = spark.createDataFrame([(1, e(0), "RAREWORD"), (2, e(0), "nothing")], "query_id int, qv array<float>, qt string")
    got = R.hybrid(chunks, sections, q, 3).orderBy("query_id", "rank").collect()
    assert 1 in [r.ord for r in got if r.query_id == 1]
    assert [r.ord for r in got if r.query_id == 2][0] == 0


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "the cat sat on the mat"), (1, "transformer attention is all"), (2, "dogs bark")], "ord long, text string")
    got = R.bm25(docs, spark.createDataFrame([(1, "transformer attention")], "query_id int, qt string"), 5).collect()
    assert [r.ord for r in got] == [1]


def test_diversity_and_ties(spark, toy):
    chunks, _, _ = toy
    hits = spark.createDataFrame([(1, 0, "u1", 0.9, 1), (1, 1, "u1", 0.9, 2), (1, 2, "u2", 0.9, 3)], "query_id int, ord long, url string, score double, rank int")
    assert [r.ord for r in R.diversify(hits, chunks, 3).orderBy("rank").collect()] == [0, 2, 1]
    assert [r.ord for r in R.diversify(hits, chunks, 3, lam=1.0, penalty=0.0).orderBy("rank").collect()] == [0, 1, 2]


def test_budget(spark):
    items = spark.createDataFrame([(1, 1, "a" * 400), (1, 2, "b" * 40), (1, 3, "c" * 4), (2, 1, ""), (2, 2, "x" * 8), (2, 3, "y" * 400), (2, 4, "z")], "query_id int, rank int, text string")
    got = [(r.query_id, r.rank) for r in R.within_budget(items, 50).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (2, 2)]


def test_graph_steps(spark):
    edges = spark.createDataFrame([("a", "b", "relation"), ("b", "c", "relation"), ("c", "d", "relation")], "src string, dst string, kind string")
    for depth, want in ((1, {"a", "b"}), (2, {"a", "b", "c"})):
        assert {r.id for r in G.neighbourhood(edges, ["a"], depth)[0].collect()} == want
    people = spark.createDataFrame([(0, "e1", "GPT-4", 1), (1, "e2", "GPT 4", 5), (2, "e3", "Other", 2)], "ord int, id string, name string, mentions int")
    merged, rest = G.merge_duplicates(people, spark.createDataFrame([("e1", "e2", "relation"), ("e1", "e3", "relation"), ("e2", "e3", "relation")], "src string, dst string, kind string"))
    assert {(r.id, r.mentions, tuple(r.aliases)) for r in merged.collect()} == {("e2", 6, ("GPT-4",)), ("e3", 2, ())}
    assert [(r.src, r.dst) for r in rest.collect()] == [("e2", "e3")]


def test_gate(spark):
    rows = [(0.5, 1, 0.95), (1.0, 0, None), (1.0, 0, 0.85), (1.0, 0, 0.3), (1.0, 0, 0.55), (0.7, 0, 0.9)]
    df = spark.createDataFrame(rows, "ratio double, critical int, rubric double").select(V.gate(F.col("ratio"), F.col("critical"), F.col("rubric")).alias("g"))
    assert [r.g for r in df.collect()] == ["reject", "review", "accept", "reject", "review", "reject"]


def test_trigger_scores(spark):
    df = spark.createDataFrame([(True, True), (False, False)], "want boolean, got boolean")
    assert V.confusion(df, "want", "got").first().asDict() == {"tp": 1, "fp": 0, "fn": 0, "tn": 1, "precision": 1.0, "recall": 1.0, "f1": 1.0}


def test_versions(spark, tmp_path):
    kind = spark.createDataFrame([], "id string, n int").schema
    t = VersionedTable(spark, str(tmp_path / "t"), kind)
    assert t.version() is None and t.read().count() == 0
    t.write(spark.createDataFrame([("a", 1), ("b", 2)], kind))
    held, first = t.read(), t.version()
    t.write(S.upsert(t.read(), spark.createDataFrame([("b", 3)], kind)))  # from itself
    assert held.count() == 2 and {tuple(r) for r in t.read().collect()} == {("a", 1), ("b", 3)}
    assert ingest.changed_since(t, first) == (True, t.version())
    t.clear()
    assert t.read().count() == 0

    def broken(*_):
        raise OSError("no store")

    assert isinstance(open_table(spark, str(tmp_path / "u"), kind, broken), VersionedTable)


def test_ingest_and_streams(spark, tmp_path):
    kind = "id string, content_hash string, raw_text string, in_kg boolean, vectorized boolean, kg_projected_hash string, vector_projected_hash string"
    table = VersionedTable(spark, str(tmp_path / "cache"), spark.createDataFrame([], kind).schema)
    source = tmp_path / "in"
    source.mkdir()
    for n, rows in enumerate(([("a", "h1", "x"), ("b", "h1", "y")], [("a", "h2", "x2"), ("b", "h1", "y")])):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("id", "content_hash", "raw_text"), r))) for r in rows))
        stream = spark.readStream.schema("id string, content_hash string, raw_text string").json(str(source))
        ingest.ingest_documents(stream, table, str(tmp_path / "ck")).awaitTermination(60)
    assert {(r.id, r.content_hash, r.raw_text) for r in table.read().collect()} == {("a", "h2", "x2"), ("b", "h1", "y")}
    staging, overall = (VersionedTable(spark, str(tmp_path / p), spark.createDataFrame([], "id string").schema) for p in "so")
    staging.write(spark.createDataFrame([("1",), ("2",)], "id string"))
    overall.write(spark.createDataFrame([("1",)], "id string"))
    assert ingest.drain(staging, overall) == 2 and overall.read().count() == 2 and ingest.drain(staging, overall) == 0


def test_builds(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "b"), lifecycle.STATE)
    builds = lifecycle.Builds(table, {"evaluate": lambda s: s | {"gate": "review"}})
    thread, step, _ = builds.run(state={"context": "x"})
    assert step == "review"
    again = lifecycle.Builds(table, builds.actions)  # another process
    assert again.run(thread, decision="revise")[1] == "review"
    assert again.run(thread, decision="accept")[1] == "accepted"
    assert builds.run(state={})[1] == "failed"
    jobs = lifecycle.Jobs()
    name = jobs.start(lambda: 7)
    jobs.pool.shutdown()
    assert jobs.status(name) == {"state": "done", "result": 7} and jobs.status("?")["state"] == "unknown"


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"caf\xc3\xa9")
    (tmp_path / "d" / "b.html").write_text("<body><nav>n</nav><p>Hi</p></body>")
    (tmp_path / "d" / "c.bin").write_bytes(b"z")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.decoded(files.walk(spark, str(tmp_path / "d"))).collect()}
    assert got == {"a.txt": "café", "b.html": "Hi"}
    np.save(tmp_path / "m.npy", np.eye(3, dtype=np.float32))
    assert [r.embedding for r in files.vectors(spark, str(tmp_path / "m.npy")).orderBy("row").collect()][1] == [0.0, 1.0, 0.0]
    (tmp_path / "u.txt").write_text("# x\nhttp://a\n\nhttp://a\n https://b\n")
    assert {r.url for r in files.addresses(spark, str(tmp_path / "u.txt")).collect()} == {"http://a", "https://b"}
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "n", "type": "entity", "name": "N"}], "edges": [{"id": "e", "from": "n", "to": "m", "kind": "relation"}]}))
    nodes, edges = files.graph(spark, str(tmp_path / "g.json"))
    assert nodes.first().layer == 3 and nodes.first().importance == 3 and edges.first().src == "n"
    (tmp_path / "bad.json").write_text("{not json")
    assert files.graph(spark, str(tmp_path / "bad.json"))[0].count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"examples": [{"question": "q", "expected_urls": ["u", "v", "u"], "titles": ["t"]}, {"question": "r", "expected_url": "w"}]}))
    assert [r.expected_urls for r in files.examples(spark, str(tmp_path / "e.json")).orderBy("question").collect()] == [["u", "v"], ["w"]]
    (tmp_path / "l.json").write_text(json.dumps({"labels": {"q": {"human_score": 0.5}}}))
    assert files.labels(spark, str(tmp_path / "l.json")).first().human_score == 0.5
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert files.json_lines(spark, str(tmp_path / "x.jsonl"), "id string").count() == 2


def test_plugins(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "")], "doc_id int, text string")
    got = {r.doc_id: r.embedding for r in plugins.embed(rows, "doc_id", "text", plugins.HashingEmbedder(8)).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5 and sum(map(abs, got[2])) == 0

    def broken(t):
        raise ValueError("model")

    out = plugins.extract(spark.createDataFrame([(1, "Ada Lovelace met Ada Lovelace")], "doc_id int, text string"), "doc_id", "text", broken).collect()
    assert [(r.name, r.error) for r in out] == [("Ada Lovelace", "ValueError: model")]


def test_settings_and_tools():
    assert config.read_env("# c\nexport A='1'\nB=2\n") == {"A": "1", "B": "2"}
    assert config.resolve({"u": "${X:-d}/${Y}"}, {"Y": "y"}) == {"u": "d/y"}
    s = config.Server("s", url="http://h?read_only=${RO}", requires=["K"])
    assert s.can_write({"RO": "false"}) and not s.can_write({"RO": "true"}) and s.missing({}) == ["K"]
    ps = [config.Provider("a", "x", "A", "m"), config.Provider("b", "x", "B", "m"), config.Provider("c", "y", "C", "m")]
    assert [p.name for p in config.judge_panel(ps, "a", {"A": "1", "B": "1", "C": "1"})] == ["c"] and config.first_configured(ps, {"B": "1"}).name == "b"
    assert config.chunk_options(10, 999) == (200, 100) and R.overfetch(8) == 48 and R.overfetch(8, mmr=True) == 64
    run = lambda n, a: "done"
    assert tools.call("list_tables", {}, run, writable=True)["status"] == "ok"
    assert tools.call("delete_row", {}, run, writable=False)["status"] == "error"
    assert tools.call("delete_row", {}, run, writable=True)["status"] == "error"
    assert tools.call("delete_row", {"x": 1}, run, writable=True, writes_on=True)["status"] == "approval_required"
    assert tools.call("delete_row", {}, run, writable=True, writes_on=True, approved=True)["status"] == "ok"


def test_tools_over_a_graph(spark):
    nodes = spark.createDataFrame([("a", "entity", 3, "Ada", 0, 5, ""), ("b", "chunk", 2, "", 1, 1, "about Ada")], "id string, type string, layer int, name string, ord int, mentions int, preview string")
    library = tools.Library(nodes, spark.createDataFrame([("b", "a", "mentions")], "src string, dst string, kind string"))
    assert [r["id"] for r in library.search("ada")] == ["a", "b"] and library.neighbours("zzz")["node"] is None
    assert {n["id"] for n in library.neighbours("a", 9)["nodes"]} == {"a", "b"} and library.counts() == {"entity": 1, "chunk": 1, "edges": 1}


def test_streaming_windows(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:01:00", "click", 1.0), (1, "2024-01-01 00:02:00", "click", 2.0), (1, "2024-01-01 02:00:00", "view", 3.0)], "user_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.event_type, r.n) for r in ingest.windowed_counts(events).collect()} == {("click", 2), ("view", 1)}
    assert sorted(r.n for r in ingest.sessions(events).collect()) == [1, 2]


def test_memory_rules(spark):
    m = spark.createDataFrame([("a", 0, "fact", "solar panels make power", 3, "INFERRED", "", None), ("b", 1, "fact", "old", 3, "INFERRED", "a", None)], "id string, ord int, kind string, text string, salience int, confidence string, superseded_by string, updated_at timestamp")
    now = F.lit("2024-01-01").cast("timestamp")
    assert [r.id for r in S.recall(m, "solar power", 5, now).collect()] == ["a"]
    up = S.feedback(m, F.lit("up"))
    assert up.first().salience == 4 and S.feedback(up, F.lit("down")).first().salience == 3
    assert [r.superseded_by for r in S.forget(m, spark.createDataFrame([("a",)], "id string")).collect()] == [""]
    new = spark.createDataFrame([("n", "fact", "power: solar panels make")], "id string, kind string, text string")
    assert [(r.new_id, r.id) for r in S.near_duplicates(new, m).collect()] == [("n", "a")]


def test_common_words_alone_do_not_meet(spark):
    """Of new texts that share only the most common words with others, none is held against these."""
    old = spark.createDataFrame([(f"m{i}", "k", ["the", "and", *(f"w{i}x{j}" for j in range(18))]) for i in range(60)], "id string, kind string, w array<string>")
    own = spark.createDataFrame([(f"n{i}", "k", ["the", "and", *(f"v{i}x{j}" for j in range(18))]) for i in range(60)] + [("like", "k", ["the", "and", *(f"w7x{j}" for j in range(17)), "other"]), ("few", "k", ["the"])], "new_id string, kind string, q array<string>")
    assert [(r.new_id, r.id) for r in S.meeting(own, old, 0.9).collect()] == [("like", "m7")]
