"""Repair, trie and rules against brute force, on rows made to be awkward."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import repair, rules, trie, turns

KIND = "conv_id long, turn long, role string, text string, ord long, h string, key string, k long, n long, words long"


def frame(spark, rows):
    """Rows with further columns whose names clash with those inside operators."""
    return spark.createDataFrame([(*r, 1, "h", "k", 2, 3, 4) for r in rows], KIND)


# --- repair --------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        damaged = (turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
        out += [damaged] * (2 if how == 3 else 1)
    return out


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_repair(rows, faults):
    """Whole strings, from the last turn to the first, by the role that came before: the rest decides, so the least rest is best."""

    def follows(before, new):  # may a turn of this role come after one of that (None: at the start)
        return new == "a" and before == "u" or new == "u" and before != "u" or new == "s" and before is None

    def with_inserts(states):
        for _ in range(3):
            for before in states:
                for new in ("user", "assistant"):
                    if follows(before, new[0]) and (rest := states[new[0]]):
                        offer = (rest[0] + 5, "I" + rest[1], [new + ":", *rest[2]])
                        states[before] = min(states[before] or offer, offer)
        return states

    states = with_inserts({None: (0, "", []), "s": None, "u": None, "a": (0, "", [])})
    for (_, role, text), fault in zip(reversed(rows), reversed(faults)):
        now = {}
        for before, rest in states.items():
            offers = [(rest[0] + 2, "D" + rest[1], rest[2])]
            if fault not in ("blank", "duplicate"):
                for code, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    if new[:1] and follows(before, new[0]):
                        rest = states[new[0]]
                        offers.append((rest[0] + (code == "R") + 5 * (fault == "truncated"), code + rest[1], [f"{new}:{text}", *rest[2]]))
            now[before] = min(offers)
        states = with_inserts(now)
    return states[None]


def every_repair(rows, faults):
    """The cheapest and least of all strings with up to two inserts in each place."""
    runs = [r for n in range(3) for r in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for edits in itertools.product("DKua", repeat=len(rows)):
        for gaps in itertools.product(runs, repeat=len(rows) + 1):
            cost, audit, turns_ = 0, "", []
            for (_, role, text), fault, edit, gap in zip([*rows, (None, "", "")], [*faults, ""], [*edits, ""], gaps):
                cost += 5 * len(gap)
                audit += "I" * len(gap)
                turns_ += [(g, "") for g in gap]
                if edit:
                    cost += {"D": 2, "K": 0}.get(edit, 1) + 5 * (edit != "D" and fault == "truncated")
                    cost += 10**6 * (edit != "D" and fault in ("blank", "duplicate"))
                    audit += edit if edit in "DK" else "R"
                    turns_ += [] if edit == "D" else [(role if edit == "K" else {"u": "user", "a": "assistant"}[edit], text)]
            if all(r for r, _ in turns_) and GRAMMAR.fullmatch("".join(r[0] for r, _ in turns_)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, [f"{r}:{x}" for r, x in turns_])
    return best


def repaired(rows):
    faults = fault_of(rows)
    given = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = best_repair(rows, faults)
    return {
        "gaps": max(given) - min(given) + 1 - len(set(given)) if given else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def conversations(seed, n=60, longest=7):
    r, rows = random.Random(seed), []
    texts = ["Fine.", "Fine.", "Really?", "No end", " \n", "", None, "Cut off, here", "Yes! ", "Ünï.\x0b", "a." * 40]
    for conv in range(n):
        turns_ = sorted(r.sample(range(-2, 12), r.randint(1, longest))) if r.random() < 0.8 else [None, 3]
        rows += [(conv * 7 - 20, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]), r.choice(texts)) for t in turns_]
    return rows


def by_conv(rows):
    out = defaultdict(list)
    for row in rows:
        out[row[0]].append(row)
    return {c: sorted(own, key=lambda x: (x[1] is not None, x[1] or 0)) for c, own in out.items()}


def repairs(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in repair.op11_structure_repair(df).collect()}


@pytest.mark.parametrize("segment", [64, 2])
def test_repairs_are_the_cheapest_and_least(spark, monkeypatch, segment):
    rows = [*conversations(1), (None, 1, "user", "No key."), (None, 2, "assistant", "None.")]
    if segment == 64:
        got = repairs(frame(spark, rows).repartition(5))
        want = {c: repaired(after_damage(own)) for c, own in by_conv(rows).items()}
        assert got == want
        short = [x for x in map(after_damage, by_conv(rows).values()) if len(x) <= 2]
        assert len(short) > 5 and all(best_repair(x, fault_of(x)) == every_repair(x, fault_of(x)) for x in short)
        return
    # segments of two turns are joined to the same strings
    for own in by_conv(rows).values():
        after = after_damage(own)
        faults = fault_of(after)
        cls = np.array([3 * ("sua".find(role[:1]) % 4 if role else 3) + (2 if f in ("blank", "duplicate") else f == "truncated") for (_, role, _), f in zip(after, faults)], np.int64)
        if not len(cls):
            continue
        starts = np.arange(0, len(cls), segment)
        lengths = np.minimum(segment, len(cls) - starts)
        cost, rank, pointers = repair.layers(cls, starts, lengths)
        joined = repair._joined([(i, cost[i].ravel().tolist(), rank[i].ravel().tolist()) for i in range(len(starts))])
        audit = ""
        for first, entry, state, last in joined:
            part, tail = "", "I" * (repair.LAST[state] if last else 0)
            for t in range(lengths[first] - 1, -1, -1):
                state, code = divmod(int(pointers[t][first, entry, state]), len(repair.CODES))
                part = repair.CODES[code] + part
            assert state == entry
            audit = part + tail + audit
        assert audit == best_repair(after, faults)[1]


def test_a_long_conversation_is_repaired_over_tasks(spark):
    r = random.Random(5)
    rows = [(3, t, r.choice(["user", "assistant"]), f"Turn {r.randrange(400)}" + r.choice([".", "", "!"])) for t in range(1500)]
    assert repairs(frame(spark, rows).repartition(6))[3] == repaired(after_damage(rows))


def test_very_long_texts_and_odd_tables(spark):
    rows = [(1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "y. " * 500_000), (2, None, "user", None)]
    got = repairs(frame(spark, rows))
    assert got == {c: repaired(after_damage(own)) for c, own in by_conv(rows).items()}
    assert repairs(frame(spark, [])) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert repairs(frame(spark, [(gone, 1, "user", "Hm.")]))[gone] == dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": "", "repaired_sha256": nothing}


def test_rows_of_one_turn_and_repeated_rows(spark):
    """Rows that share a turn are in one order, whatever their partitions; equal rows are duplicates."""
    rows = [(c, 1, role, text) for c in range(1, 30) for role, text in (("user", "One."), ("assistant", "Two."), ("user", "One."))]
    a, b = (repairs(frame(spark, list(x)).repartition(n)) for x, n in ((rows, 1), (reversed(rows), 7)))
    assert a == b and all(x["duplicate"] >= 1 for c, x in a.items() if zlib.crc32(f"{c}:1".encode()) % 20 not in (0, 1))


# --- trie ----------------------------------------------------------------------------------------------------------------


def nodes_by_brute_force(rows):
    own = {c: [(r or "", x or "") for _, _, r, x in turns_] for c, turns_ in by_conv(r for r in rows if r[0] is not None).items()}
    paths = {}
    for c, turns_ in own.items():
        h, head = zlib.crc32(str(c).encode()) % 4, own.get(c - int(np.fmod(c, 20)), [])
        paths[c] = tuple(head[:h] + turns_[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def trie_rows(df, most=trie.MOST):
    return sorted((tuple(r) for r in trie.op12_prefix_trie(df, most).collect()), key=lambda r: (r[0], r[1]))


def talk(seed):
    r, rows = random.Random(seed), []
    for c in [*range(-45, 90), 1000, 2000, 2001]:
        same = r.random() < 0.4
        for t in range(r.randint(1, 6)):
            rows.append((c, t if t or r.random() < 0.8 else None, r.choice(["user", "assistant", None]), f"{'same' if same else r.randint(0, 2)} text {t}" if r.random() < 0.9 else r.choice([None, "", "  "])))
    return [*rows, (None, 1, "user", "no key")]


@pytest.mark.parametrize("most", [trie.MOST, 40, 6])
def test_trie_is_that_of_all_prefixes(spark, most):
    """With few turns to a task, subtries are dealt again by later turns, down to copies."""
    rows = talk(2)
    assert trie_rows(frame(spark, rows).repartition(5), most) == nodes_by_brute_force(rows)


def test_trie_of_copies_long_conversations_and_nothing(spark):
    copies = [(c, t, "user", f"turn {t}") for c in range(300, 420) for t in range(5)]
    long_ = [(c, t, "user" if t % 2 else "assistant", f"word {t if t < 350 else (t, c)}") for c in (4000, 5000) for t in range(400)]
    for most in (trie.MOST, 100):
        assert trie_rows(frame(spark, copies + long_).repartition(4), most) == nodes_by_brute_force(copies + long_)
    assert trie_rows(frame(spark, [])) == []
    texts = [(20, 1, "user", "long " * 400_000), (21, 1, "user", None), (21, 1, "user", None)]
    assert trie_rows(frame(spark, texts)) == nodes_by_brute_force(texts)


def test_ids_of_a_group_are_hashed_in_order(spark):
    ids = [(1, 5 * i - 70_000) for i in range(30_000)] + [(-3, 9)]
    got = {r["rep"]: r["ends_sha256"] for r in turns.id_digests(spark.createDataFrame(ids, "rep long, conv_id long").repartition(7)).collect()}
    assert got == {rep: hashlib.sha256(",".join(str(i) for r, i in sorted(ids) if r == rep).encode()).hexdigest() for rep in (1, -3)}


def test_places_cross_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("conv_id"), (F.col("id") * 7 % 5000).alias("turn"), F.lit(1).alias("a"))
    got = turns.placed(turns.ordered(rows, "places", "a")).collect()
    for c in (0, 1):
        own = sorted((r["turn"], r["k"]) for r in got if r["conv_id"] == c)
        assert [k for _, k in own] == list(range(len(own)))


# --- rules ---------------------------------------------------------------------------------------------------------------

PHRASE = "one two three four five six seven eight nine ten"
TEXTS = [
    None, "", "  \n\x0b ", "few words", f"{PHRASE} " * 3, f"{PHRASE} eleven " + " ".join(f"w{i}" for i in range(90)) + f" {PHRASE}", "same line of text\n" * 30, "same same " * 40, "*** $$ " * 30, "LOUD WORDS " * 20 + "x y z",
    " ".join(f"mot{i}é" for i in range(60)), " ".join(f"w{i}" for i in range(40)), "Ünï no break " * 9 + "🙂 中文 " * 5, "a b\rc\x1cd " * 12, "line\r\nline\n line\nline\n" * 3, " ".join(f"long{'o' * 20}{i}" for i in range(30)), "1234 5678 " * 15, " ".join(f"word{i} text" for i in range(3000)),
]


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = [c for c in text if c.isalpha()]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_same_words": sum(a == b for a, b in zip(words, words[1:])), "n_letters": len(letters), "n_upper": sum("A" <= c <= "Z" for c in text),
    }


def fails(m):
    return {
        "few_words": m["n_words"] < 20, "repeated_windows": 100 * m["n_repeat_words"] > 30 * m["n_words"], "symbols": 10 * m["n_symbols"] > m["n_words"], "repeated_lines": m["n_lines"] > 3 and 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        "short_words": m["word_chars"] < 2 * m["n_words"], "long_words": m["word_chars"] > 15 * m["n_words"], "same_words": 100 * m["n_same_words"] > 20 * m["n_words"], "capitals": m["n_letters"] > 0 and 2 * m["n_upper"] > m["n_letters"], "few_letters": 2 * m["n_letters"] < m["word_chars"],
    }


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, 5, 6, True, 7) for i, t in enumerate(TEXTS)] + [(None, "no key here", 5, 6, True, 7), (4, "repeated id", 5, 6, True, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long, failed long, kept boolean, bit int").repartition(4)


def test_ledger_holds_every_rule(texts):
    want = []
    for i, t in [*enumerate(TEXTS), (None, "no key here"), (4, "repeated id")]:
        m = measured(t or "")
        want.append((i, *m.values(), sum(1 << rules.BIT[r] for r, bad in fails(m).items() if bad)))
    order = lambda rows: sorted(rows, key=str)
    rows = rules.ledger(texts)
    assert order(tuple(r[c] for c in ("doc_id", *rules.COUNTS, "failed")) for r in rows.collect()) == order(want)
    for version, names in rules.POLICIES.items():
        kept = {r["failed"]: r["kept"] for r in rules.apply_policy(rows, version).collect()}
        assert all(k == (bits & sum(1 << rules.BIT[n] for n in names) == 0) for bits, k in kept.items())
        got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept"]) for r in rules.ablations(rows, version).collect()}
        bad = [{n for n in names if bits >> rules.BIT[n] & 1} for *_, bits in want]
        assert got == {n: (sum(n in b for b in bad), sum(b == {n} for b in bad), sum(not b - {n} for b in bad)) for n in names}
    assert len(set(len(fails(measured(t or ""))) for t in TEXTS)) == 1 and set(itertools.chain(*([n for n, bad in fails(measured(t or "")).items() if bad] for t in TEXTS))) == set(rules.BIT)


def test_rules_of_no_rows_and_of_a_very_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rules.op13_rule_ledger(empty).collect() == []
    assert [(r["n_failed"], r["n_kept"]) for r in rules.op13_ablations(empty).collect()] == [(0, 0)] * len(rules.BIT)
    text = " ".join(f"w{i % 70_000}" for i in range(400_000))
    row = rules.op13_rule_ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_repeat_words"], row["base_failed"], row["kept"]) == (400_000, 400_000, True, False)
