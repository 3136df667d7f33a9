"""Every operator against brute force, on rows made to be awkward."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import common, decontaminate, language, lines, neardup, packing, passages, queries, shingles, sstable, substrings, tokens, topk, warc

KIND = "doc_id long, text string, lang string, source string, n_chars long, k long, n long, h string, g long, a long, b long, row long, component string, __doc string"
rng = np.random.default_rng(1)
WORDS = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(900)]


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    own = r.choice(WORDS, n)
    return "".join(w + (".\n" if r.random() < 0.1 else " ") for w in own)


def docs(spark, rows, kind=KIND):
    """Rows (doc_id, text) with further columns whose names clash with those inside operators."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "h", 3, 4, 5, 6, "c", None) for i, t in rows], kind)


BASE = prose(7, 160)
AWKWARD = [
    (1, BASE), (2, BASE), (3, BASE.replace("a", "b", 3)), (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (8, "TWO  Words"), (9, "x"), (None, "no key"), (11, "Ünï çödé ß İ 中文 🙂 " * 8),
    (12, prose(8, 6000)), (13, prose(9, 80) + BASE + prose(10, 70)), (14, "same line\n" * 40), (15, "same line\n" * 40), (16, "a" * 300), (17, "a" * 120), (-5, prose(9, 80)), (2**62, BASE[:200]), (20, "1234 !?"), (21, "\x00\x01 nul"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


KEYED = [(i, t or "") for i, t in AWKWARD if i is not None]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- tokens, packing, tables -----------------------------------------------------------------------------------------


def reference_ids(text: str) -> np.ndarray:
    enc = tokens.encoder(queries.vocabulary())
    return np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids + [tokens.END_ID], "<u4")


@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), st.sampled_from(list("ab' \n<|endoftext|>İΣς中"))), max_size=60), max_size=5))
@settings(max_examples=60, deadline=None)
def test_ids_are_the_librarys(texts):
    enc = tokens.encoder(queries.vocabulary())
    got = enc.encode(pa.array(texts, pa.string()))
    assert [list(x) for x in got] == [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 20)
    enc = tokens.Encoder(queries.vocabulary())
    for seed in range(5):
        text = prose(seed, 100)
        assert list(enc.encode(pa.array([text]))[0]) == list(reference_ids(text)[:-1])


def test_sequences_hold_every_id_once(awkward, nothing):
    vocab = queries.vocabulary()
    pieces = packing.pack(awkward, vocab, length=256)
    got = rows_of(pieces)
    by_seq, total = {}, 0
    for p in got:
        by_seq.setdefault(p["sequence_id"], []).append(p)
    want = Counter((i, tuple(reference_ids(t or ""))) for i, t in AWKWARD)
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in got if p["start"] == 0) == Counter((i, len(x)) for i, x in want.elements())
    for n, own in sorted(by_seq.items()):
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at and p["length"] == len(p["ids"]) and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
            at += p["length"]
        total += at
        assert at == 256 or n == max(by_seq)
    assert total == sum(len(x) for _, x in want.elements())
    for i, t in KEYED:
        own = sorted((p for p in got if p["doc_id"] == i), key=lambda p: p["start"])
        assert list(itertools.chain(*(p["ids"] for p in own))) == list(reference_ids(t))
    padded = rows_of(packing.sequences(packing.pack(awkward, vocab, length=256), 256))
    assert all(len(s["ids"]) == 256 or s["n"] & (s["n"] - 1) == 0 for s in padded)
    assert rows_of(packing.op1_curve_packing(nothing, vocab)) == []


def test_hilbert_curve_is_one_path():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    path = grid[np.argsort(packing.hilbert_keys(grid, 3))]
    assert sorted(packing.hilbert_keys(grid, 3)) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_like_documents_are_neighbours():
    d = packing._directions(49408)
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1000, 400), r.integers(20000, 21000, 400)
    near = [np.concatenate([x[:390], r.integers(0, 49408, 10)]) for x in (a, a, b, b)]
    keys = packing.curve_keys(near, d)
    order = np.argsort(keys)
    assert {frozenset(order[:2]), frozenset(order[2:])} == {frozenset((0, 1)), frozenset((2, 3))}


def test_shards(spark, awkward, nothing, tmp_path):
    vocab = queries.vocabulary()
    twice = awkward.union(docs(spark, [(7, "again")]))
    manifest = sstable.write(twice, vocab, f"file://{tmp_path}/sst", shard_bytes=2000)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(sstable.read(spark, manifest)))
    at, want = 0, []
    for i, t in sorted([*KEYED, (7, "again")]):
        ids = reference_ids(t)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    files = [sstable.Shard(r.path) for r in manifest.collect()]
    for i, t in KEYED:
        found = [v for v in (f.get(i) for f in files) if v is not None]
        assert i == 7 or [np.frombuffer(v, "<u2").astype("<u4").tobytes() for v in found] == [reference_ids(t).tobytes()]
    assert all(f.get(987654) is None for f in files)
    assert rows_of(sstable.op6_sstable(nothing, vocab)) == []


def test_many_blocks_and_prefixes(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 300)
    w = sstable.Writer(2)
    keys = sorted({int(x) for x in np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 500)} | set(range(-50, 50)))
    for k in keys:
        w.add(sstable.pack_key(k), bytes(2 * (k % 5)))
    import tempfile

    with tempfile.NamedTemporaryFile(delete=False) as f:
        f.write(b"".join(w.finish()))
    shard = sstable.Shard(f.name)
    assert len(shard.index) > 20 and [sstable.unpack_key(k) for k, _ in shard] == keys
    assert all(shard.get(k) == bytes(2 * (k % 5)) for k in keys) and shard.get(51) is None
    with open(f.name, "r+b") as damaged:
        damaged.seek(-60, 2)
        damaged.write(b"\xff\xff")
    with pytest.raises(ValueError):
        sstable.Shard(f.name)


# --- lines -----------------------------------------------------------------------------------------------------------


def plain_lines(rows):
    seen, out = {}, {}
    for i, t in sorted(set(rows)):
        own = t.split("\n")
        gone = set()
        for p in range(len(own) - 2):
            w = tuple(own[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.setdefault(w, (i, p))
        out[i, t] = [x for p, x in enumerate(own) if p not in gone], len(gone), sum(p - 1 not in gone for p in gone)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lines(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(int(i), "\n".join(r.choice(list("abcd"), r.integers(0, 14)))) for i in r.permutation(25)] + [(40, "\n\n\n\n"), (41, "a\nb"), (42, "")]
    want = plain_lines(rows)
    for g in rows_of(lines.dedup_lines(docs(spark, [*rows, (50, None), rows[0], (None, "a\nb\nc")]))):
        if g["doc_id"] in (None, 50):
            assert g["n_removed"] == 0 and g["text"] == (None if g["doc_id"] else "a\nb\nc")
            continue
        source = next(t for i, t in rows if i == g["doc_id"])
        kept, n, spans = want[g["doc_id"], source]
        assert (g["text"], g["n_removed"], len(g["spans"]), g["n_lines"]) == ("\n".join(kept), n, spans, len(source.split("\n")))


def test_lines_keep_other_columns(awkward, nothing):
    out = lines.dedup_lines(awkward)
    assert set(awkward.columns) < set(out.columns) and out.count() == len(AWKWARD) and lines.op2_line_windows(nothing).count() == 0


def test_lines_run_no_python(awkward):
    plan = lines.op2_line_windows(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- top-k -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("scale", "dims"), [(1.0, 64), (1.0, 7), (0.01, 20), (1e9, 5)])
def test_topk(spark, scale, dims):
    r = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in r.standard_normal(dims) * scale]) for i in range(140)]
    rows += [(i, rows[3][1]) for i in (200, 201, 202, 300)] + [(400, None), (450, [None] * dims), (500, [float("nan")] * dims), (550, [float("inf")] + [0.0] * (dims - 1)), (600, []), (650, [1.0] * (dims + 1)), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, query_id string").repartition(6)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op3_segment_topk(df).collect())
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in fine:
        if q % 50 == 0:
            s = sorted((-max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(x, y)))), i) for i, y in fine if i != q and len(y) == len(x))
            want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(s[:5])]
    assert got == sorted(want)


def test_topk_in_waves(spark):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in r.standard_normal(8)]) for i in range(300)], "vec_id long, embedding array<double>")
    v = topk.usable(df, "vec_id", "embedding")
    q = v.where("vec_id % 7 = 0")
    some = lambda d: sorted(map(tuple, d.collect()))
    assert some(topk.search(v, q, 3, wave_bytes=500)) == some(topk.search(v, q, 3))
    assert topk.op3_segment_topk(df.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(2)
    q, v = topk.quantized(r.standard_normal(50 * 30), 30), topk.quantized(r.standard_normal(80 * 30), 30)
    assert topk.levels(30) == [1, 4, 15, 22, 26] and topk.levels(64) == [1, 4, 16, 32, 48, 56] and topk.levels(1) == [1]
    for s in topk.levels(30):
        assert (topk.statistics(q, s) @ topk.statistics(v, s).T >= q @ v.T - 1e-6).all()


@pytest.mark.parametrize(("clusters", "most"), [(50, 0.02), (1, 0.1)])
def test_bounds_leave_few_pairs(clusters, most):
    """Even of vectors without any structure few pairs get an exact product."""
    r = np.random.default_rng(3)
    x = np.floor(256 * (r.standard_normal((clusters, 64)) * (clusters > 1))[r.integers(0, clusters, 12_000)] + 256 * r.standard_normal((12_000, 64)) * (0.2 if clusters > 1 else 1))
    ids = np.arange(12_000)
    search = topk.Search(ids[::200], x[::200], 5)
    for at in range(0, len(ids), topk.BLOCK):
        search.add(ids[at : at + topk.BLOCK], x[at : at + topk.BLOCK])
    score = x[::200] @ x.T
    score[np.arange(60), ids[::200]] = -np.inf
    assert (search.best == -np.sort(-score, axis=1)[:, :5]).all() and search.exact_pairs < most * score.size


# --- near-duplicates -------------------------------------------------------------------------------------------------


def plain_components(rows):
    sets = [(i, set(shingles.shingle_set(t).tolist())) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(s), find(i)) for i, s in sets}


def edited(text: str, share: float, seed: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(str(r.choice(WORDS)) if r.random() < share else w for w in text.split())


@pytest.mark.parametrize("share", [0.01, 0.03, 0.05])
def test_near_duplicates(spark, share):
    base = [prose(100 + i, 120) for i in range(12)]
    rows = [(i * 20 + j, b if not j else edited(b, share, i * 50 + j)) for i, b in enumerate(base) for j in range(8)] + [(1000, base[0]), (1001, base[0].upper())]
    want = plain_components(rows)
    got = {r["doc_id"]: r for r in rows_of(neardup.op4_lsh_forest(docs(spark, rows).repartition(7)))}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_awkward_rows(spark, awkward, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(neardup.op4_lsh_forest(awkward))}
    assert got == plain_components(KEYED)
    assert got[8] == (1, 7) and got[5] == (0, 5) and got[6] == (0, 6)
    assert neardup.op4_lsh_forest(nothing).count() == 0
    again = rows_of(neardup.op4_lsh_forest(docs(spark, [(1, BASE), (1, prose(3, 50)), (2, prose(3, 50)), (3, BASE)])))
    assert len(again) == 4 and {r["component_id"] for r in again} == {1}


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP_BYTES", 20_000)
    base = prose(55, 150)
    rows = [(i, edited(base, 0.02, i)) for i in range(120)]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(neardup.op4_lsh_forest(docs(spark, rows)))} == plain_components(rows)


def templated(rows: int, links: int, shared: int, own: int, common: int, seed: int):
    """Texts of a template with words of their own, and pairs of them with more words in common."""
    r = np.random.default_rng(seed)
    word = lambda n: ["".join(x) for x in r.choice(list("abcdefghijklmnopqrstuvwxyz"), (n, 9))]
    template = word(shared)
    out = [(i, " ".join(template + word(own))) for i in range(rows)]
    for k in range(links):
        more = word(common)
        for side in (0, 1):
            out[2 * k + side] = (2 * k + side, " ".join(template + more + word(own - common)))
    order = r.permutation(rows).tolist()
    return [(i, out[n][1]) for n, i in enumerate(order)], [tuple(sorted(order[2 * k : 2 * k + 2])) for k in range(links)]


def test_rows_at_the_edge_of_a_task_are_joined_exactly():
    """A region of two that an edge parts has a row alone on each side: neither side can propose the pair."""
    keys = np.repeat(np.arange(6, dtype=np.uint16)[:, None], neardup.LEVELS, axis=1)
    r = np.random.default_rng(0)
    sketches = r.integers(0, 1 << 62, (6, 5)).astype(np.uint64)
    i, j, _ = neardup.propose(np.zeros(6, np.int64), keys, np.full(6, 50), sketches)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (5, 5)]
    i, j, _ = neardup.propose(np.zeros(1, np.int64), keys[:1], np.full(1, 50), sketches[:1])
    assert (i.tolist(), j.tolist()) == ([0], [0])


@pytest.mark.parametrize(("own", "common"), [(72, 20), (72, 16)])
def test_links_within_a_crowd_of_one_template(spark, own, common):
    """All texts are alike by about 0.7, and a few pairs by 0.75 or little more: none of these is missed, and no other linked."""
    rows, links = templated(1500, 60, 332, own, common, 5)
    want = plain_components(rows[:0]) | {i: i for i, _ in rows}
    sets = dict(rows)
    for a, b in links:
        x, y = (set(shingles.shingle_set(sets[i]).tolist()) for i in (a, b))
        if 100 * len(x & y) >= 75 * len(x | y):
            want[b] = a
    got = {r["doc_id"]: r["component_id"] for r in rows_of(neardup.op4_lsh_forest(docs(spark, rows).repartition(7)))}
    assert got == want and sum(i != c for i, c in want.items()) == 60


@pytest.mark.parametrize("most", [10**6, 50, 8])
def test_components(spark, most):
    r = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(int(a), int(b)) for a, b in r.integers(100, 400, (200, 2))] + [(500, 500 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a long, b long").repartition(16)
    got = {x.node: x.component for x in common.components(df, "t", most).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert common.components(df.limit(0), "t").count() == 0


# --- language --------------------------------------------------------------------------------------------------------


def test_forward_backward_by_enumeration():
    r = np.random.default_rng(0)
    e, a, s = r.standard_normal((1, 4, 3)), r.standard_normal((3, 3)), r.standard_normal(3)
    post, moves, log_z = language.forward_backward(e, a, s)
    want, want_moves, z = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(s[path[0]] + sum(e[0, t, k] for t, k in enumerate(path)) + sum(a[x, y] for x, y in itertools.pairwise(path)))
        z += w
        for t, k in enumerate(path):
            want[t, k] += w
        for x, y in itertools.pairwise(path):
            want_moves[x, y] += w
    assert np.allclose(post[0], want / z) and np.allclose(moves, want_moves / z) and np.isclose(log_z, np.log(z))


@pytest.mark.parametrize("chunk", [3, 64])
def test_chunks_give_the_same_posteriors(monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    r = np.random.default_rng(1)
    sizes = [0, 1, 3, 200, 7, 64, 65, 0, 6]
    e, a, s = r.standard_normal((sum(sizes), 4)).astype(np.float32), r.standard_normal((4, 4)), r.standard_normal(4)
    offsets = np.cumsum([0, *sizes])
    got = language.shares(e, offsets, a, s)
    for i, n in enumerate(sizes):
        want = language.forward_backward(e[None, offsets[i] : offsets[i + 1]].astype(float), a, s)[0][0].mean(axis=0) if n else np.zeros(4)
        assert np.allclose(got[i], want, atol=1e-4)


def spoken(spark, n=240):
    kinds = {"xx": "ka ki ku lo la pa", "yy": "str ent ing eth ous ion", "zz": "çã éo ñu ío áq úr"}
    r = np.random.default_rng(0)
    rows = []
    for i in range(n):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join("".join(r.choice(kinds[lang].split(), r.integers(1, 4))) for _ in range(40)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), kinds


def naive_posteriors(model, words):
    e = model.emissions(words).astype(float)
    return language.forward_backward(e[None], model.transitions, model.start)[0][0]


def test_languages_by_brute_force(spark):
    """Every prediction against forward-backward over the whole text, word by word; and the labels of words."""
    df = spoken(spark, 120)[0]
    long = " ".join(r.text for r in df.limit(30).collect())
    df = df.unionByName(spark.createDataFrame([(10_000, long, None), (10_001, "", None), (10_002, None, None), (10_003, "12 !", None)], "doc_id long, text string, lang string"))
    model = language.fit(df)
    got = {r["doc_id"]: r for r in rows_of(language.op5_crf_language(df))}
    labels = {r["doc_id"]: r["runs"] for r in rows_of(language.label_words(df, model))}
    texts = {r.doc_id: r.text for r in df.collect()}
    assert set(got) == set(labels) == set(texts) and len(texts[10_000].split()) > 500
    for i, text in texts.items():
        words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).split()
        if not words:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and labels[i] == []
            continue
        post = naive_posteriors(model, words)
        mean = post.mean(axis=0)
        assert abs(got[i]["score"] - mean.max()) < 1e-3 and mean[model.languages.index(got[i]["lang_pred"])] > mean.max() - 1e-3
        flat = [(r["lang"], r["score"]) for r in labels[i] for _ in range(r["words"])]
        assert [r["first"] for r in labels[i]] == np.cumsum([0, *(r["words"] for r in labels[i][:-1])]).tolist() and len(flat) == len(words)
        assert all(a["lang"] != b["lang"] for a, b in itertools.pairwise(labels[i]))
        assert all(p[model.languages.index(x)] > p.max() - 1e-2 for (x, _), p in zip(flat, post))


def test_held_out_accuracy(spark):
    df, _ = spoken(spark)
    got = rows_of(language.op5_crf_language(df).join(df.select("doc_id", "lang"), "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_training_takes_whole_texts_of_few_rows(spark, monkeypatch):
    """The rows of smallest hash, their texts to the last letter, one of a doc_id that many rows have; and no more languages
    than a model may have."""
    seen = {}
    monkeypatch.setattr(language, "train", lambda samples: seen.update(samples) or language.Model([], None, None, None))
    rows = [(i, f"word {i} " * 3000 + "end", "xy"[i % 2]) for i in range(90)] + [(900, "again " * 10 + "end", "x")] * 40 + [(901, None, "x"), (902, "no", None), (None, "no", "x")]
    language.fit(docs(spark, [r[:2] for r in rows]).drop("lang").join(spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] is not None], "doc_id long, lang string").distinct(), "doc_id"), sample=7)
    assert {k: len(v) for k, v in seen.items()} == {"x": 7, "y": 7} and all(t.endswith("end") for v in seen.values() for t in v) and max(len(t) for t in seen["y"]) > 20_000
    assert all(len(set(v)) == 7 for v in seen.values())
    many = spark.createDataFrame([(i, "text", f"l{i % 300}") for i in range(2000)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.fit(many)


def test_language_of_awkward_and_mixed_rows(spark, nothing):
    df, kinds = spoken(spark)
    rows = [(1000, None), (1001, ""), (1002, "123 !?"), (None, "kaki kulo lapa"), (1003, "strent ingeth " * 30 + "kaki lolapa " * 10), (1004, "kaki " * 20000)]
    model = language.fit(df)
    got = {r["doc_id"]: r for r in rows_of(language.identify(spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, score string"), model))}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == "xx" and got[1004]["lang_pred"] == "xx"
    assert got[1003]["lang_pred"] == "yy" and 0.6 < got[1003]["score"] < 0.9
    assert language.op5_crf_language(nothing).count() == 0
    unlabelled = rows_of(language.op5_crf_language(spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")))
    assert unlabelled[0]["lang_pred"] == "und" and unlabelled[0]["score"] == 0


def test_labels_are_no_input(spark):
    df, _ = spoken(spark, 60)
    model = language.fit(df)
    some = lambda d: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows_of(language.identify(d, model))}
    assert some(df) == some(df.withColumn("lang", F.lit("xx")))


# --- substrings ------------------------------------------------------------------------------------------------------


def plain_removed(rows):
    first = {}
    for i, t in rows:
        b = t.encode()
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(i, first.get(b[j : j + 50], i))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removed(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(substrings.op7_bucket_refinement(df)))


@pytest.mark.parametrize(("hot", "chunk"), [(1000, 1 << 18), (0, 1 << 18), (1000, 700)])
def test_substrings(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "_CHUNK", chunk)
    r = np.random.default_rng(hot + chunk)
    text = "".join(r.choice(list("abcde "), 3000))
    rows = []
    for i in r.permutation(60).tolist():
        parts = []
        for _ in range(r.integers(1, 5)):
            a = r.integers(0, 2900)
            parts += [text[a : a + r.integers(20, 300)], "".join(r.choice(list("vwxyz"), r.integers(0, 30)))]
        rows.append((i, "".join(parts)))
    assert removed(docs(spark, rows).repartition(6)) == plain_removed(rows)


def test_substrings_of_awkward_rows(spark, awkward, nothing):
    assert removed(awkward) == plain_removed(KEYED)
    again = [(1, BASE), (1, BASE), (1, "z" * 70), (2, BASE[10:300]), (0, BASE[100:180])]
    assert removed(docs(spark, again)) == plain_removed(again)
    assert removed(nothing) == []


@given(st.text(alphabet="ab", min_size=50, max_size=400))
@settings(max_examples=40, deadline=None)
def test_refinement_sorts_to_depth(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(len(data) - 49)
    rank = substrings.refine(data, starts)
    own = [text[i : i + 50] for i in starts]
    count = Counter(own)
    assert [x < 0 for x in rank] == [count[w] == 1 for w in own]
    for i, j in itertools.combinations(range(min(len(own), 60)), 2):
        if rank[i] >= 0 and rank[j] >= 0:
            assert (rank[i] == rank[j]) == (own[i] == own[j])


# --- passages --------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 12), min_size=1, max_size=120))
@settings(max_examples=40, deadline=None)
def test_windows_cover_every_run_once(values):
    own = np.array(values, np.uint64)
    seed = passages._SEEDS[0]
    value = shingles.mix(own ^ seed)
    n, short = len(own), passages.SHORTEST
    cover = {}
    for l, c, r, v in zip(*(x.tolist() for x in passages.compact_windows(own, np.array([0, n]), seed))):
        assert v == value[c] and r - l + 1 >= short
        for i in range(l, c + 1):
            for j in range(max(c, i + short - 1), r + 1):
                assert (i, j) not in cover
                cover[i, j] = v
    key = (value >> np.uint64(26)).tolist()
    for i in range(n):
        for j in range(i + short - 1, n):
            assert int(cover[i, j]) >> 26 == min(key[i : j + 1])


def test_passages(spark, awkward, nothing):
    passage = prose(70, 120)
    own = passage.split()
    rows = [(i, prose(200 + i, 90) + (passage if i % 3 == 0 else "") + prose(300 + i, 60)) for i in range(30)]
    rows += [(100, prose(400, 50) + " ".join([*own[:60], "zzz", *own[61:]]) + " " + prose(401, 40)), (101, passage), (102, prose(402, 49))]
    got = {r["doc_id"]: r for r in rows_of(passages.op8_compact_windows(docs(spark, rows)))}
    shared = {i for i in range(0, 30, 3)} | {100, 101}
    assert {i for i, r in got.items() if r["n_passages"]} == shared
    assert {r["class_id"] for i, r in got.items() if i in shared} == {0}
    assert all(r["class_id"] == i and r["n_words"] == 0 for i, r in got.items() if i not in shared)
    assert all(95 <= got[i]["n_words"] <= 145 for i in shared)
    odd = {r["doc_id"]: r for r in rows_of(passages.op8_compact_windows(awkward))}
    assert len(odd) == len(KEYED) and odd[2]["class_id"] == odd[13]["class_id"] == odd[1]["class_id"] and odd[4]["n_passages"] == 0
    again = rows_of(passages.op8_compact_windows(docs(spark, [(1, passage), (2, passage), (2, ""), (2, "few words"), (3, passage + " x")])))
    assert len(again) == 5 and {r["class_id"] for r in again} == {1}
    assert passages.op8_compact_windows(nothing).count() == 0


def like_runs(p, q):
    """Whether any two runs are alike, from all pairs of runs of both."""
    x, y, short = p.tolist(), q.tolist(), passages.SHORTEST
    for s in range(len(x) - short + 1):
        for n in range(short, len(x) - s + 1):
            u = set(x[s : s + n])
            for t in range(len(y) - short + 1):
                for k in range(short, len(y) - t + 1):
                    v = set(y[t : t + k])
                    if len(u & v) >= 0.75 * len(u | v):
                        return True
    return False


@pytest.mark.parametrize("edit", [2, 3, 5])
def test_edited_passages(edit):
    r = np.random.default_rng(edit)
    missed = wrong = 0
    for k in range(60):
        own = prose(1000 + k, int(r.integers(72, 100))).split()
        at = int(r.integers(25, len(own) - 25 - edit))
        other = own[:at] + [f"new{i}" for i in range(edit)] + own[at + edit :]
        x, y = shingles.shingle_set(" ".join(own)), shingles.shingle_set(" ".join(other))
        like = shingles.common(x, y) / len(np.union1d(x, y))
        p, q = (" ".join([prose(2000 + k + z, 80), *t, prose(3000 + k + z, 80)]) for z, t in ((0, own), (500, other)))
        a, b = (passages.Side(shingles.shingles(x)) for x in (p, q))
        got = passages.common_runs(a, b)
        if like >= 0.75:
            missed += not any(s <= 80 and e >= 80 + len(own) - 5 for s, e, _, _, _ in got)  # from its first shingle to its last
        wrong += any(passages._alike(a.shingles[s : e + 1], b.shingles[t : g + 1]) < 0.75 or min(e - s, g - t) + 1 < passages.SHORTEST for s, e, t, g, _ in got)
    assert (missed, wrong) == (0, 0)


@pytest.mark.parametrize("letters", [40, 5000])
def test_like_runs_against_all_pairs(letters):
    """Two sequences of shingles, one with more and more of the other's changed: runs are found where all pairs of runs have
    some, and none where they have none."""
    r = np.random.default_rng(letters)
    like, size = [], passages.SHORTEST + 6
    for k in range(24):
        x = r.integers(0, letters, size).astype(np.uint64)
        y = x.copy()
        at = r.permutation(size)[: k] if k % 2 else np.arange(k) + int(r.integers(0, size - k))
        y[at] = r.integers(10_000, 20_000, len(at))
        got = bool(passages.common_runs(passages.Side(x), passages.Side(y)))
        like.append(like_runs(x, y))
        assert got == like[-1], (k, got)
    assert 5 < sum(like) < 20


def test_like_passages_against_all_pairs(spark):
    """Classes and covered words of the whole query against every pair of texts: passages with a few changed words, alone and
    behind a line that all of a crowd have in common, in a text twice, and long repetitions of a word or a line."""
    r = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    some = lambda n: ["".join(r.choice(letters, 7)) for _ in range(n)]
    line, loop, rows, planted = some(30), some(9), [], []
    for k in range(40):
        n = int(r.integers(60, 110))
        own, e, at = some(n), int(r.integers(2, 6)), int(r.integers(10, n - 15))
        for side, text in enumerate((own, [*own[:at], *some(e), *own[at + e :]])):
            extra = [line, loop * 30, ["again"] * 200, [*text, *some(9)]][k % 4] if k >= 20 else []
            rows.append((2 * k + side, " ".join([*some(int(r.integers(20, 60))), *extra, *text, *some(int(r.integers(20, 60)))])))
        planted.append((2 * k, 2 * k + 1))
    sides = {i: passages.Side(shingles.shingles(t)) for i, t in rows}
    cover, root = {i: np.zeros(len(t.split()) + 1, int) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sides, 2):
        p, q = sides[a], sides[b]
        p.new[:] = q.new[:] = True  # every pair by itself
        for s, e, t, g, _ in passages.common_runs(p, q):
            root[max(find(a), find(b))] = min(find(a), find(b))
            cover[a][int(p.place[s]) : int(p.place[e]) + 5] = 1
            cover[b][int(q.place[t]) : int(q.place[g]) + 5] = 1
    got = {x["doc_id"]: x for x in rows_of(passages.op8_compact_windows(docs(spark, rows).repartition(5)))}
    want = {i: (find(i), int((np.diff(c, prepend=0) == 1).sum()), int(c.sum())) for i, c in cover.items()}
    missed = [i for i in want if (got[i]["class_id"], got[i]["n_passages"], got[i]["n_words"]) != want[i]]
    assert len(missed) <= 4 and sum(find(a) == find(b) for a, b in planted) > 30  # the join by windows is probable, not certain
    assert all(got[a]["class_id"] == got[b]["class_id"] for a, b in planted[:20] if find(a) == find(b))


def test_passage_after_repeats_of_its_line():
    """The passage holds a line that recurs before it in one text and after it in the other."""
    for k in range(20):
        line, own = prose(50, 20).split(), prose(7000 + k, 70).split()
        passage = [*own[:25], *line, *own[25:]]
        x, y, z, u, v, w = (prose(9 * k + n, 40).split() for n in range(1, 7))
        p, q = " ".join([*x, *line, *y, *line, *z, *passage, *u]), " ".join([*v, *passage, *w, *line, *u])
        got = passages.common_runs(*(passages.Side(shingles.shingles(t)) for t in (p, q)))
        assert any(s <= 160 and e >= 160 + len(passage) - 5 and t <= 40 and g >= 40 + len(passage) - 5 for s, e, t, g, _ in got)


def test_short_equal_passages_in_a_crowd(spark):
    """Passages of 50 words in many documents of other text; no document may drop out of its group."""
    rows, group = [], {}
    for k in range(12):
        passage = prose(8000 + k, 50) if k else ("one two three four five six seven " * 8)[:270]
        for n in range(60):
            i = 1000 * k + n
            rows.append((i, " ".join([prose(20_000 + 2 * i, 30 + n % 7), *passage.split()[:50], prose(20_001 + 2 * i, 30)])))
            group[i] = 1000 * k
    got = {r["doc_id"]: r["class_id"] for r in rows_of(passages.op8_compact_windows(docs(spark, rows).repartition(9)))}
    assert got == group


def test_like_passages_in_a_crowd_of_their_line(spark):
    """Pairs of like passages round a line that all of a crowd have within theirs: what is next in order must not matter."""
    r = np.random.default_rng(11)
    some = lambda n: ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n)]
    rows, pairs = [], []
    for k in range(3):
        line = some(30)
        for n in range(60):
            i, before, after = 1000 * k + n, some(15), some(15)
            rows.append((i, " ".join([*some(25), *before, *line, *after, *some(25)])))
            if n % 3 == 1:  # another with the three words after the line changed
                rows.append((i + 500, " ".join([*some(25), *before, *line, *some(3), *after[3:], *some(25)])))
                pairs.append((i, i + 500))
    got = {x["doc_id"]: x for x in rows_of(passages.op8_compact_windows(docs(spark, rows).repartition(5)))}
    assert [p for p in pairs if got[p[0]]["class_id"] != got[p[1]]["class_id"]] == []
    assert {x["class_id"] for x in got.values()} == {i for i, _ in rows} - {b for _, b in pairs}
    assert {i for i, x in got.items() if x["n_passages"]} == {i for p in pairs for i in p}


@pytest.mark.parametrize("repeats", [False, True])
def test_like_runs_share_a_rare_shingle(repeats):
    """The smaller of two like runs has one of the rarest of its stretch in common with the other, in any order of rarity."""
    r, found = np.random.default_rng(5 + repeats), 0
    for _ in range(150):
        n = int(r.integers(46, 220))
        own = r.integers(0, 1 << 32, n, dtype=np.uint32)
        if repeats:
            at, size = int(r.integers(0, n - 40)), int(r.integers(2, 20))
            own = np.concatenate([own[: at + 40], np.tile(own[at : at + size], int(r.integers(1, 9))), own[at + 40 :]])
        other = own.copy()
        for at in r.integers(0, n - 5, int(r.integers(1, max(2, n // 25)))).tolist():
            other[at : at + 5] = r.integers(0, 1 << 32, 5, dtype=np.uint32)
        if passages._alike(own, other) < 0.75:
            continue
        small, large = sorted((own, other), key=lambda x: len(np.unique(x)))
        wide = np.concatenate([r.integers(0, 1 << 32, 30, dtype=np.uint32), small, r.integers(0, 1 << 32, 30, dtype=np.uint32)])
        level = np.where(np.isin(wide, large), wide % 5 + 1, wide % 2 * 3).astype(np.uint8)
        assert np.isin(wide[passages.rarest(wide, level)], large).any()
        before = [max([j for j in range(i) if wide[j] == wide[i]], default=-1) for i in range(len(wide))]
        every = [len(np.unique(wide[i : i + 46])) for i in range(len(wide) - 45)]
        assert passages.different(np.array(before)).tolist() == every
        assert passages.fewest(wide).tolist() == [min(every[max(0, i - 45) : i + 1]) for i in range(len(wide))]
        found += 1
    assert found > 40


def test_stretches_of_a_crowd_make_few_pairs():
    """Near copies of one text against one that lacks five of each twelve shingles: no pair; against all that hold a like run: a pair."""
    r = np.random.default_rng(3)
    base = np.arange(150)
    fresh = itertools.count(1000)

    def changed(at, own=base):
        own = own.copy()
        for i in at:
            own[i : i + 5] = [next(fresh) for _ in own[i : i + 5]]
        return own

    copies = [changed(r.choice(145, 2)) for _ in range(300)]
    far = changed(range(0, 150, 12))
    near = np.concatenate([[next(fresh) for _ in range(30)], changed([20], base[40:90]), [next(fresh) for _ in range(30)]])
    loops = np.tile(np.arange(140, 143), 30)
    them = passages.Stretches([*copies, loops], 10_000)
    assert not len(them.like(far)) and them.like(loops).tolist() == [300]
    alike = [k for k, x in enumerate(copies) if passages.common_runs(passages.Side(x.astype(np.uint64)), passages.Side(near.astype(np.uint64)))]
    assert len(alike) > 50 and set(alike) <= set(them.like(near).tolist())


def test_stretches_of_a_crowd_meet_by_what_is_rare():
    """Of stretches with a crowd's line in common those that share more are looked at, and found as when all are."""
    r = np.random.default_rng(4)
    line = np.arange(26)
    own = [np.concatenate([r.integers(30, 100_000, r.integers(20, 50)), line, r.integers(30, 100_000, 30)]) for _ in range(300)]
    own[100], own[200] = own[7].copy(), own[7][10:].copy()
    own[100][15:18] = r.integers(30, 100_000, 3)
    own += [np.tile(line[:3], 30), np.tile(line[:4], 20)]
    them = passages.Stretches(own, 100_000)
    assert len(them.sharing(own[7], np.unique(own[7]), np.arange(300))) < 30
    for x in (7, 8, 300, 301):
        for wanted in (np.arange(302), np.arange(1, 302, 3)):
            want = set(them.like(own[x]).tolist())
            assert them.like_of(own[x], wanted).tolist() == [k for k in wanted.tolist() if k in want]
    assert {7, 100} <= set(them.like_of(own[7], np.arange(302)).tolist())


# --- archives --------------------------------------------------------------------------------------------------------

PAGES = [(5, "http://www.a.example/x?y=1#z", "<p>" + "q" * 200), (3, "https://a.example:8080/x", "<p>" + "q" * 200), (9, None, None), (8, "", ""), (7, "http://[bad", "short"), (6, "http://b.example/ä b\n", "short"), (None, "u", "v"), (4, "HTTP://A.EXAMPLE", "x\r\n\r\ny" * 90), (10, "http://a.example/x", "ü" * 70), (11, "http://a.example/x", "ü" * 70), (11, "http://a.example/x", "ü" * 70)]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "c", 1) for p in PAGES], "page_id long, url string, html string, digest string, first long")
    folder = f"file://{tmp_path}/w"
    files = warc.index(warc.write(pages, folder, archive_bytes=300), folder, block_lines=2)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in rows_of(warc.read(spark, folder, files)))
    want = []
    for i, _, t in PAGES:
        if i is None:
            continue
        raw = (t or "").encode()
        first = min(j for j, _, u in PAGES if j is not None and (u or "").encode() == raw)
        again = len(raw) >= 100 and first < i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else -1))
    assert got == sorted(want)
    look = warc.Captures(folder, files)
    assert sorted(r["page_id"] for r in look.find("https://a.example/x")) == [10, 11, 11] and look.find("http://nowhere.example/") == []
    assert [r["page_id"] for r in look.find("http://user@a.example:8080/x#frag")] == [3]
    assert warc.op9_warc_index(pages.limit(0)).count() == 0


def test_url_keys():
    assert warc.url_key("http://Blog.Example.COM:80/a?b#c") == "com,example,blog)/a?b" and warc.url_key(None) == "" and warc.url_key("https://x.y") == "y,x)/"


# --- decontamination -------------------------------------------------------------------------------------------------


def test_decontamination(spark, awkward, nothing):
    items = [(1, prose(500, 30)), (2, prose(501, 200)), (3, "too few words"), (4, None), (5, prose(500, 30)), (None, prose(502, 30)), (6, "What is the answer to this question about things? It is forty two.")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    rows = [(i, prose(600 + i, 150)) for i in range(20)]
    rows += [(50, prose(700, 200) + items[0][1].upper() + prose(701, 90)), (51, prose(702, 40) + items[1][1]), (52, items[1][1][: len(items[1][1]) // 3]), (53, "so: " + items[6][1].lower()), (54, prose(703, 61) + items[0][1].replace(".", "")), (55, None), (None, items[0][1])]
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.op10_bm25_wand(docs(spark, rows).repartition(4), bench))}
    assert got >= {(50, 1), (50, 5), (51, 2), (53, 6)} and {d for d, _ in got} <= {50, 51, 53, 54}
    short = {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.matches(docs(spark, [(60, " Too FEW\nwords"), (61, "too few words more"), (62, "few words"), (63, prose(1, 70) + " too few words")]), bench))}
    assert short == {(60, 3), (61, 3), (63, 3)}  # the whole sequence of a short item, anywhere
    near = [(64, "too words few and " + prose(2, 40)), (65, "too few " + prose(3, 90) + " words"), (66, prose(4, 300) + " too few words " + prose(5, 300)), (67, " ".join([prose(6, 62), "too few words", prose(7, 62)])), (68, "too")]
    assert {(r["doc_id"], r["item_id"]) for r in rows_of(decontaminate.matches(docs(spark, near), bench))} == {(66, 3), (67, 3)}
    one = spark.createDataFrame([(7, "Xylophones"), (8, " \n"), (9, "xylophones are loud")], "item_id long, text string")
    found = decontaminate.matches(docs(spark, [(1, "many xylophones here"), (2, "xylophones, though"), (3, "XYLOPHONES are loud")]), one)
    assert {(r["doc_id"], r["item_id"]) for r in rows_of(found)} == {(1, 7), (3, 7), (3, 9)}
    left = decontaminate.clean(docs(spark, rows), bench)
    assert left.columns == KIND_NAMES and {r.doc_id for r in left.collect()} >= {*range(20), 52, 55, None}
    assert decontaminate.matches(nothing, bench).count() == 0 and decontaminate.matches(awkward, bench.limit(0)).count() == 0


def plain_matches(rows, items):
    """Every passage against every entry, in plain loops."""
    split = {i: [own[at : at + 64] for at in range(0, len(own), 64) if not at or len(own) - at >= 5] for i, own in ((i, t.lower().split()) for i, t in items)}
    every = [(i, e) for i, parts in split.items() for e in parts]
    df = Counter(w for _, e in every for w in set(e))
    mean = sum(len(e) for _, e in every) / len(every)

    def impacts(e):
        tf = Counter(e)
        own = {w: np.log((len(every) - df[w] + 0.5) / (df[w] + 0.5) + 1) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(e) / mean)) for w, n in tf.items()}
        return {w: x / sum(own.values()) for w, x in own.items()}

    gram = lambda w, n=5: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    weights = [(i, impacts(e)) for i, e in every]
    texts = dict(items)
    out = {}
    for doc, text in rows:
        own = text.lower().split()
        for at in range(0, max(1, len(own) - 64), 64):
            passage = set(own[at : at + 128])
            for i, weight in weights:
                if (score := sum(x for w, x in weight.items() if w in passage)) < 0.5 - 1e-9:
                    continue
                item = texts[i].lower().split()
                near = own[max(0, at - len(item)) : min(len(own), at + 128) + len(item)]
                n, s = min(5, len(item)), gram(near)
                parts = [len(gram(item, n) & gram(near, n)) / len(gram(item, n))]
                for part in decontaminate.question_and_answer(texts[i]):
                    w = part.lower().split()
                    parts.append(len(gram(w) & s) / len(gram(w)) if len(w) >= 5 else len(set(w) & set(near)) / len(set(w)) if w else 1.0)
                if parts[0] >= 0.75 and min(parts[1:]) >= 0.5 and (parts[0], round(score, 9)) > out.get((doc, i), (0, 0))[1::-1]:
                    out[doc, i] = (round(score, 9), *parts)
    return out


@pytest.mark.parametrize("wave_words", [40, 700, 10**6])
def test_matches_by_brute_force(spark, wave_words):
    """The whole query's rows, scores included, whatever a wave holds and in whatever order items come."""
    r = np.random.default_rng(9)
    items = [(i, prose(5000 + i, int(r.integers(1, 150) if i % 4 else r.integers(1, 5)))) for i in range(40)] + [(90, "Which of these is the oldest of all? The fourth one.")]
    rows = []
    for n in range(60):
        i, text = items[n % len(items)]
        own = text.split()
        kept = own if n % 3 == 0 else [w if r.random() > 0.03 * (n % 5) else "changed" for w in own] if n % 3 == 1 else own[: len(own) * 4 // 5]
        rows.append((n, " ".join([prose(6000 + n, int(r.integers(0, 200))), *kept, prose(7000 + n, int(r.integers(0, 90)))])))
    rows += [(70, items[0][1].upper()), (71, "")]
    bench = spark.createDataFrame(sorted(items, key=lambda x: (x[0] * 7919 + wave_words) % 101), "item_id long, text string").repartition(3)
    got = {(x["doc_id"], x["item_id"]): (x["score"], x["overlap"], x["question_overlap"], x["answer_overlap"]) for x in rows_of(decontaminate.matches(docs(spark, rows), bench, wave_words=wave_words))}
    want = plain_matches(rows, items)
    assert set(got) == set(want) and len(want) > 25
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


KIND_NAMES = [x.split(" ")[0] for x in KIND.split(", ")]


def test_retrieval_is_safe():
    items = [(i, prose(800 + i, 40)) for i in range(60)]
    index = decontaminate.Index(items)
    r = np.random.default_rng(4)
    v = len(index.terms)
    score = np.zeros((v, index.entries))
    score[index.posting // index.entries, index.entry] = index.impact
    rows = [np.unique(np.concatenate([r.integers(0, v, 60), [index.terms[w] for w in shingles.words(items[k % 60][1])[: k % 40]]]).astype(int)) for k in range(200)]
    passage, term = np.repeat(np.arange(200), [len(x) for x in rows]), np.concatenate(rows)
    got = {(int(p), int(e)): s for p, e, s in zip(*index.retrieve(passage, term))}
    full = np.stack([score[x].sum(axis=0) for x in rows])
    want = {(int(p), int(e)) for p, e in zip(*np.nonzero(full >= decontaminate.LEAST))}
    assert set(got) == want and len(want) > 20 and all(abs(s - full[k]) < 1e-9 for k, s in got.items())
