"""Integration against a fold over chunks in order, pointers, and merges in chains."""

import random

import pytest

from shelfmark.operators import graph as G
from shelfmark.operators import integration as N
from shelfmark.sources.tables import VersionedTable

NODES = "id string, type string, layer int, name string, kind string, aliases array<string>, importance int, mentions long, summary string, title string, url string, ord long"
EDGES = "src string, dst string, kind string, label string, confidence string, chunk_id string"
STAGED = "id string, source_title string, source_url string, ord long, text string"
FOUND = "chunk_id string, pos long, name string, kind string, aliases array<string>, importance int, summary string, confidence string"
RELATED = "chunk_id string, pos long, source string, target string, predicate string, confidence string"


def slug(x):
    return "-".join("".join(c for c in x.lower() if c.isascii() and c.isalnum() or c.isspace()).split())


def fold(staged, found, related, nodes, edges):
    """One chunk after another, with a dictionary of what each name stands for."""
    stands, entities, sources, lines = {}, {}, [], set()
    for n in nodes:
        if n[1] == "entity":
            entities[n[0]] = {"name": n[3], "kind": n[4], "aliases": set(n[5]), "importance": n[6], "mentions": n[7], "summary": n[8]}
            stands[n[0].lower()] = stands[n[3].lower()] = n[0]
        elif n[1] == "source":
            sources.append((n[0], n[10], n[9]))
    for n in nodes:
        for alias in (n[5] or []) if n[1] == "entity" else []:
            stands.setdefault(alias.lower(), n[0])

    def met(name, kind, aliases, importance, summary):
        name = name.strip()
        if not slug(name):
            return None
        if name.lower() not in stands:
            plain = f"entity_{slug(name)}"
            new = plain if plain not in entities else f"{plain}-"
            while new in entities:
                new += "+"
            entities[new] = {"name": name, "kind": kind if kind in N.KINDS else "concept", "aliases": set(), "importance": importance if importance in range(1, 6) else 3, "mentions": 0, "summary": ""}
            stands[name.lower()] = new
        e = entities[stands[name.lower()]]
        e["mentions"] += 1
        e["kind"] = kind if e["kind"] == "concept" and kind in N.KINDS else e["kind"]
        e["importance"] = max(e["importance"], importance if importance in range(1, 6) else 0)
        e["summary"] = summary if len(summary) > len(e["summary"]) else e["summary"]
        for a in aliases:
            if a.strip() and a.strip().lower() != e["name"].lower():
                e["aliases"].add(a.strip())
                stands.setdefault(a.strip().lower(), stands[name.lower()])
        return stands[name.lower()]

    had = {n[0] for n in nodes if n[1] == "chunk"}
    triples = {(s, d, k, label) for s, d, k, label, *_ in edges}
    for cid, title, url, _, _ in sorted(staged, key=lambda c: c[3]):
        if cid in had:
            continue
        had.add(cid)
        if title or url:
            hit = next((i for i, u, t in sources if (url and u == url) or (title and t == title)), None)
            if hit is None:
                hit = f"source_{slug(url or title)}"
                sources.append((hit, url, title or url))
            triples.add((cid, hit, "from_source", "from source"))
        here = {}
        for _, _, name, kind, aliases, importance, summary, _ in sorted((f for f in found if f[0] == cid), key=lambda f: f[1]):
            if e := met(name, kind, aliases or [], importance, summary or ""):
                here[name.strip().lower()] = e
                triples.add((cid, e, "mentions", "mentions"))
        for _, _, s, t, label, _ in sorted((r for r in related if r[0] == cid), key=lambda r: r[1]):
            if not s.strip() or not t.strip():
                continue
            ends = []
            for name in (s, t):
                key = name.strip().lower()
                here[key] = here[key] if key in here else met(name, "concept", [], None, "")
                ends.append(here[key])
            if all(ends) and ends[0] != ends[1]:
                triples.add((*ends, "relation", (label or "related to").strip()))
    return entities, triples, {s[0] for s in sources}


def made_up(seed):
    r = random.Random(seed)
    names = ["Ada", "ada", "Ada L", "Bob", "Bob!", "B.", "Cy", "Dee", "cy Young", "???", "Eve", "Old", "elder"]
    staged = [(f"c{i}", r.choice(["t1", "t2", "t3", ""]), r.choice(["u1", "u2", "u3", ""]), i, "") for i in range(14)]
    found = [(c[0], p, r.choice(names), r.choice(["person", "concept", "thing", None]), r.sample(names, r.randint(0, 2)) or None, r.choice([None, 1, 5, 7]), "s" * r.randint(0, 4), "") for c in staged for p in range(r.randint(0, 4))]
    related = [(c[0], p, r.choice(names), r.choice([*names, " "]), r.choice(["knows", "", None]), "") for c in staged for p in range(r.randint(0, 2))]
    nodes = [("entity_old", "entity", 3, "Old", "concept", ["elder", "Cy"], 2, 4, "ss", "", "", 0), ("entity_bob", "entity", 3, "Robert", "person", [], 1, 1, "", "", "", 1), ("source_t2", "source", 0, None, None, None, None, None, None, "t2", "", 2), ("c3", "chunk", 2, None, None, None, None, None, None, "", "", 3)]
    return staged, found, related, nodes, [("c3", "entity_old", "mentions", "mentions", "EXTRACTED", "c3")]


@pytest.mark.parametrize("seed", range(3))
def test_names_stand_for_what_had_them_first(spark, seed):
    staged, found, related, nodes, edges = made_up(seed)
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((staged, STAGED), (found, FOUND), (related, RELATED), (nodes, NODES), (edges, EDGES))]
    held = N.Graph(*frames[3:])
    for _ in range(2):  # the second time nothing changes
        held = N.integrate(*frames[:3], held)
        got = {r.name: r for r in held.nodes.where("type = 'entity'").collect()}
        entities, triples, sources = fold(staged, found, related, nodes, edges)
        want = {e["name"]: (e["kind"], e["importance"], e["mentions"], e["summary"], sorted(e["aliases"])) for e in entities.values()}
        assert {n: (r.kind, r.importance, r.mentions, r.summary, sorted(r.aliases)) for n, r in got.items()} == want
        name = {i: e["name"] for i, e in entities.items()}
        back = {r.id: n for n, r in got.items()}
        assert {(back.get(r.src, r.src), back.get(r.dst, r.dst), r.kind, r.label) for r in held.edges.collect()} == {(name.get(s, s), name.get(d, d), k, label) for s, d, k, label in triples}
        assert held.edges.count() == len(triples) and len(back) == len(got)
        assert {r.id for r in held.nodes.where("type = 'source'").collect()} == sources


def test_staging_is_drained(spark, tmp_path):
    text = "Red Panda met Blue Whale. Red Panda slept. " * 3
    rows = {"staging": ([("c1", "t", "", 1, text), ("c1", "t", "", 2, text), ("c2", "", "", 3, "nothing here")], STAGED), "nodes": ([], NODES), "edges": ([], EDGES)}
    tables = {k: VersionedTable(spark, str(tmp_path / k), spark.createDataFrame([], kind).schema) for k, (_, kind) in rows.items()}
    for k, (own, kind) in rows.items():
        tables[k].write(spark.createDataFrame(own, kind))
    N.drain(*tables.values())
    nodes = {r.id: r.mentions for r in tables["nodes"].read().collect()}
    assert set(nodes) == {"c1", "c2", "source_t", "entity_red-panda", "entity_blue-whale"} and tables["staging"].read().count() == 0
    edges = sorted((r.src, r.dst) for r in tables["edges"].read().collect())
    assert edges == [("c1", "entity_blue-whale"), ("c1", "entity_red-panda"), ("c1", "source_t")]
    tables["staging"].write(spark.createDataFrame(*rows["staging"]))  # as after a failure before the staging table was emptied
    N.drain(*tables.values())
    assert {r.id: r.mentions for r in tables["nodes"].read().collect()} == nodes and sorted((r.src, r.dst) for r in tables["edges"].read().collect()) == edges


def test_pointers_and_merges_in_chains(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(37)] + [("x", "n5"), ("y", "z")]
    got = {r.x: r.end for r in G.follow(spark.createDataFrame(links, "x string, up string")).collect()}
    assert got == {x: "z" if x == "y" else "n37" for x, _ in links}
    with pytest.raises(ValueError):
        G.follow(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "x string, up string"))
    entities = spark.createDataFrame([(i, c, c.upper(), i + 1, "s" * i, []) for i, c in enumerate("abcd")], "ord long, id string, name string, mentions long, summary string, aliases array<string>")
    edges = spark.createDataFrame([("c", "d", "relation"), ("k", "c", "mentions"), ("b", "c", "relation")], "src string, dst string, kind string")
    merged, kept = G.merge_entities(entities, edges, spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c")], "keep string, drop string"))
    assert {r.id: (r.name, r.mentions, r.aliases) for r in merged.collect()} == {"a": ("A", 6, ["B", "C"]), "d": ("D", 4, [])}
    assert sorted(kept.collect()) == [("a", "d", "relation"), ("k", "a", "mentions")]


def test_neighbourhoods_of_many_starts(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("e", "a", "y")], "src string, dst string, kind string")
    nodes, touched = G.neighbourhoods(edges, spark.createDataFrame([(1, "a"), (2, "d"), (3, "zz")], "start int, id string"), 2)
    assert sorted(map(tuple, nodes.collect())) == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "e", 1), (2, "b", 2), (2, "c", 1), (2, "d", 0), (3, "zz", 0)]
    assert sorted((r.start, r.src, r.dst) for r in touched.collect()) == [(1, "a", "b"), (1, "b", "c"), (1, "e", "a"), (2, "b", "c"), (2, "c", "d")]


def test_neighbourhoods_around_a_hub_in_waves(spark, monkeypatch):
    """The pairs of a result are made where they stay: none is shuffled, however many meet at one node."""
    own = [(f"c{i}", "hub") for i in range(60)] + [(f"c{i}", f"e{i * i % 11}") for i in range(0, 60, 3)] + [("e1", "e1"), ("e2", "e3"), ("z", None)]
    near = {}
    for a, b in own:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    starts = [f"c{i}" for i in range(0, 60, 7)] + ["hub", "e1", "z", "none"]
    want = set()
    for s in starts:
        seen, front = {s: 0}, [s]
        for d in (1, 2, 3):
            front = {y for x in front if x is not None for y in near.get(x, ())} - set(seen)
            seen |= dict.fromkeys(front, d)
        want |= {(s, x, d) for x, d in seen.items()}
    edges = spark.createDataFrame([(a, b, "k") for a, b in own], "src string, dst string, kind string")
    first = spark.createDataFrame([(s, s) for s in starts], "start string, id string")
    for most in (2_000_000, 150):
        monkeypatch.setattr(G, "WAVE", most)
        monkeypatch.setattr(G, "BATCH", 50)
        nodes, _ = G.neighbourhoods(edges, first, 3)
        assert sorted(map(repr, map(tuple, nodes.collect()))) == sorted(map(repr, want))
    assert "hashpartitioning(start" not in nodes._jdf.queryExecution().executedPlan().toString()
