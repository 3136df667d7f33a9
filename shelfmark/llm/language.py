"""Language identification by a linear-chain conditional random field over words (operator 5).

Words are runs of letters in lower case. A word's features are the word itself (lexicon), its prefixes of 1 to 3 and
suffixes of 1 to 4 letters (affixes) and its letter 2- to 4-grams, hashed to ``WIDTH`` rows of weights, a weight for
each language. Transition weights between neighbouring words' languages are learned with them by maximum conditional
likelihood. Forward-backward gives each word's distribution over languages; a document's is the mean over its words,
so a text that switches languages gets each one's share, and the prediction is the largest share. ``label_words`` has the
words' own labels, as runs of one language.

Training takes a bounded sample of rows: at most ``SAMPLE`` documents of each language, those of the smallest hash of doc_id among
the rows allowed, and their whole texts. ``SEQUENCES`` sequences are spliced from spans at any place of these, about half of
them from several languages, so that switches occur. A model has at most ``LANGUAGES`` languages, since its weights, and the
sample that the driver trains on, grow with them: a table with more is refused. Prediction uses the text alone and the
whole of it: chunks of 64 words are multiplied up as matrices, joined along each document, and filled in, so a long
text costs no more a word than short ones.

Rows: null text or text without a letter gives ``und`` with score 0; without any labelled row everything does. Rows
without doc_id are predicted but never trained on; repeated rows are predicted alike, and of those with one doc_id and
language training takes one. Ties go to the language first in
order. Other columns don't matter, and lang, source and doc_id are no inputs of a prediction. Empty tables give no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

WIDTH, SAMPLE, LANGUAGES = 1 << 17, 600, 256
LENGTH, SEQUENCES, EPOCHS, RATE, DECAY = 48, 6000, 5, 0.3, 1e-5
CHUNK, KEPT = 64, 200_000
UNKNOWN = "und"


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, which one stands at each place, and where each text's places start (and the last end)."""
    spaced = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"\P{L}+", " "))
    words = pc.split_pattern(spaced, " ")
    coded = words.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()


def features(word: str) -> list[int]:
    w = f"<{word}>".encode()
    crc = zlib.crc32
    out = [crc(w, 1)] + [crc(w[1 : 1 + k], 2 + k) for k in (1, 2, 3)] + [crc(w[-1 - k : -1], 6 + k) for k in (1, 2, 3, 4)]
    return [x % WIDTH for x in out + [crc(w[i : i + k], 11) for k in (2, 3, 4) for i in range(len(w) - k + 1)]]


def feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    own = [features(w) for w in words]
    return np.fromiter((x for f in own for x in f), np.int64, sum(map(len, own))), np.cumsum([0] + [len(f) for f in own])[:-1]


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.key, self.languages, self.weights, self.transitions, self.start = uuid.uuid4().hex, languages, weights, transitions, start

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        ids, starts = feature_rows(words)
        return np.add.reduceat(self.weights[ids], starts, axis=0)


def forward_backward(e: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For sequences of one length (n, t, k): word posteriors, expected transitions, and the log of the normaliser."""
    n, t, _ = e.shape
    shift = e.max(axis=2, keepdims=True)
    p, a, s = np.exp(e - shift), np.exp(transitions), np.exp(start)
    f, scale = np.empty_like(p), np.empty((n, t))
    for i in range(t):
        f[:, i] = (s if i == 0 else f[:, i - 1] @ a) * p[:, i]
        scale[:, i] = f[:, i].sum(axis=1)
        f[:, i] /= scale[:, i, None]
    b, moves = np.ones_like(p), np.zeros_like(a)
    for i in range(t - 2, -1, -1):
        after = p[:, i + 1] * b[:, i + 1] / scale[:, i + 1, None]
        b[:, i] = after @ a.T
        moves += f[:, i].T @ after
    return f * b, moves * a, float((np.log(scale) + shift[..., 0]).sum())


def train(samples: dict[str, list[str]], seed: int = 5) -> Model:
    languages = sorted(samples)
    k, r = len(languages), np.random.default_rng(seed)
    own = []  # for each language its documents' words, as numbers
    distinct: dict[str, int] = {}
    for lang in languages:
        docs = []
        for text in samples[lang]:
            words, at, _ = split_words(pa.array([text]))
            ids = np.array([distinct.setdefault(w, len(distinct)) for w in words])[at] if words and words != [""] else []
            if len(ids) >= 2:
                docs.append(ids)
        own.append(docs)
    can = [i for i in range(k) if own[i]]
    model = Model(languages, np.zeros((WIDTH, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if not can:
        return model
    x, y = np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH), np.int64)
    for n in range(SEQUENCES):
        at, mixed = 0, r.random() < 0.5
        lang = can[r.integers(len(can))]
        while at < LENGTH:
            doc = own[lang][r.integers(len(own[lang]))]
            size = min(LENGTH - at, int(r.integers(6, 25)) if mixed else LENGTH, len(doc))
            begin = r.integers(len(doc) - size + 1)
            x[n, at : at + size], y[n, at : at + size] = doc[begin : begin + size], lang
            at += size
            lang = can[r.integers(len(can))] if mixed else lang
    used, x = np.unique(x, return_inverse=True)  # features of the words that sequences hold
    names, x = list(distinct), x.reshape(y.shape)
    ids, starts = feature_rows([names[w] for w in used.tolist()])
    counts = np.diff(np.append(starts, len(ids)))
    squares, square_t, square_s = np.full((WIDTH, k), 1e-2, np.float32), np.full((k, k), 1e-2), np.full(k, 1e-2)
    for _ in range(EPOCHS):
        for rows in np.array_split(r.permutation(SEQUENCES), max(1, SEQUENCES // 250)):
            some, which = np.unique(x[rows], return_inverse=True)
            n = counts[some]
            at = np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            f = ids[at]
            e = np.add.reduceat(model.weights[f], np.cumsum(n) - n, axis=0)[which].reshape(len(rows), LENGTH, k)
            post, moves, _ = forward_backward(e.astype(np.float64), model.transitions, model.start)
            gold = np.eye(k)[y[rows]]
            by_word = np.stack([np.bincount(which.ravel(), (gold - post)[..., j].ravel(), len(some)) for j in range(k)], axis=1) / len(rows)
            touched, inside = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(inside, np.repeat(by_word[:, j], n), len(touched)) for j in range(k)], axis=1) - DECAY * model.weights[touched]
            squares[touched] += g * g
            model.weights[touched] += (RATE * g / np.sqrt(squares[touched])).astype(np.float32)
            g = (np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:]) - moves) / len(rows)
            square_t += g * g
            model.transitions += RATE * g / np.sqrt(square_t)
            g = (gold[:, 0] - post[:, 0]).sum(axis=0) / len(rows)
            square_s += g * g
            model.start += RATE * g / np.sqrt(square_s)
    return model


def shares(e: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, start: np.ndarray, each: np.ndarray | None = None) -> np.ndarray:
    """Mean posterior of each document; words [offsets[i], offsets[i + 1]) are document i's, e their emissions. Each word's
    goes to its row of ``each``, if that is given."""
    docs, k = len(offsets) - 1, e.shape[1]
    n = np.diff(offsets)
    out = np.zeros((docs, k))
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return out
    parts = -(-n[order] // CHUNK)
    first = np.cumsum(parts) - parts  # a document's first chunk
    m = int(parts.sum())
    inside = np.arange(m) - np.repeat(first, parts)
    begin = np.repeat(offsets[order], parts) + inside * CHUNK
    size = np.minimum(CHUNK, np.repeat(offsets[order] + n[order], parts) - begin)
    a, s = np.exp(transitions).astype(np.float32), np.exp(start).astype(np.float32)
    a, s = a / a.max(), s / s.max()
    at = np.minimum(begin[:, None] + np.arange(CHUNK), len(e) - 1)
    p = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)[at].transpose(1, 0, 2).copy()  # (place, chunk, language)
    live = np.arange(CHUNK)[:, None] < size
    heads = inside == 0
    whole = np.broadcast_to(np.eye(k, dtype=np.float32), (m, k, k)).copy()
    for t in range(CHUNK):
        moved = (whole.reshape(-1, k) @ a).reshape(m, k, k)
        if t == 0:
            moved[heads] = whole[heads]
        moved *= p[t][:, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        whole = np.where(live[t][:, None, None], moved, whole)
    before, after = np.empty((m, k), np.float32), np.ones((m, k), np.float32)
    before[first] = s
    for c in range(1, int(parts[0])):
        own = first[: np.searchsorted(-parts, -c, "left")] + c  # documents with more than c chunks come first
        x = np.einsum("ni,nij->nj", before[own - 1], whole[own - 1])
        before[own] = x / x.max(axis=1, keepdims=True)
    for c in range(int(parts[0]) - 2, -1, -1):
        own = first[: np.searchsorted(-parts, -(c + 1), "left")] + c
        x = np.einsum("nij,nj->ni", whole[own + 1], after[own + 1])
        after[own] = x / x.max(axis=1, keepdims=True)
    f = np.empty_like(p)
    x = before
    for t in range(CHUNK):
        moved = x @ a
        if t == 0:
            moved[heads] = x[heads]
        moved = moved * p[t]
        x = f[t] = moved / moved.sum(axis=1, keepdims=True)
    # a chunk's last word is followed by the next chunk's first: its matrix begins with the transition
    x, total = after, np.zeros((m, k))
    for t in range(CHUNK - 1, -1, -1):
        post = f[t] * x + np.float32(1e-30)
        post /= post.sum(axis=1, keepdims=True)
        total += np.where(live[t][:, None], post, 0)
        if each is not None:
            each[begin[live[t]] + t] = post[live[t]]
        back = (p[t] * x) @ a.T
        x = np.where(live[t][:, None], back / back.max(axis=1, keepdims=True), x)
    out[order] = np.add.reduceat(total, first, axis=0) / n[order][:, None]
    return out


class _Kept:
    """Emissions of words that a worker has seen: places in one array."""

    def __init__(self, model: Model):
        self.model, self.places = model, {}
        self.table = np.zeros((KEPT, len(model.languages)), np.float32)

    def get(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.places]
        if len(self.places) + len(new) > len(self.table):
            self.places.clear()
            new = words
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), self.table.shape[1]), np.float32)
        first = len(self.places)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.table[first + at : first + at + len(some)] = self.model.emissions(some)
        self.places.update(zip(new, range(first, first + len(new))))
        return self.table[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]


_WORDS: dict[str, _Kept] = {}


def _emissions(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of the texts' words, and where each text's words start (and the last end)."""
    words, at, offsets = split_words(pc.fill_null(texts, ""))
    if model.key not in _WORDS:
        _WORDS.clear()
        _WORDS[model.key] = _Kept(model)
    e = _WORDS[model.key].get(words)
    blank = words.index("") if "" in words else -1
    if blank >= 0:  # a text without letters is split into one empty word
        empty = np.concatenate([[0], np.cumsum(at == blank)])
        offsets = offsets - empty[offsets]
        at = at[at != blank]
    return e[at], offsets


def predict(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text; null counts as empty. Each worker keeps the emissions of ``KEPT`` words."""
    e, offsets = _emissions(model, texts)
    if not model.languages or not len(e):
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    mean = shares(e, offsets, model.transitions, model.start)
    best, score = mean.argmax(axis=1), mean.max(axis=1)
    return [model.languages[b] if s > 0 else UNKNOWN for b, s in zip(best, score)], [min(1.0, float(s)) for s in score]


def label(model: Model, texts: pa.Array) -> list[list[tuple[int, int, str, float]]]:
    """(first, words, language, probability) of each text's runs of words of one language: each word has its most probable one
    by forward-backward, and a run the mean of its words' probabilities."""
    e, offsets = _emissions(model, texts)
    if not model.languages or not len(e):
        return [[] for _ in range(len(texts))]
    each = np.empty_like(e, np.float64)
    shares(e, offsets, model.transitions, model.start, each)
    best, p = each.argmax(axis=1), each.max(axis=1)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    first = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])]))
    size = np.diff(np.append(first, len(best)))
    out: list[list] = [[] for _ in range(len(texts))]
    for at, n, mean in zip(first.tolist(), size.tolist(), (np.add.reduceat(p, first) / size).tolist()):
        out[text[at]].append((at - int(offsets[text[at]]), n, model.languages[best[at]], mean))
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of rows that are not held out."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if not counts:
        return train({})
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    share = {x: min(1.0, (sample + 6 * sample**0.5 + 20) / n) for x, n in counts.items()}
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    most = lambda limits: F.create_map(*(F.lit(v) for pair in limits.items() for v in pair))[F.col("lang")]
    below = lambda limits: drawn.where(F.col("draw") <= most(limits))
    draws: dict[str, list[int]] = {}
    for x in below({x: int(p * (1 << 30)) for x, p in share.items()}).select("lang", "draw").distinct().toLocalIterator():
        draws.setdefault(x.lang, []).append(x.draw)
    got: dict[str, list] = {}
    for x in below({x: sorted(d)[:sample][-1] for x, d in draws.items()}).groupBy("lang", "draw", "doc_id").agg(F.min("text").alias("text")).toLocalIterator():
        got.setdefault(x.lang, []).append((x.draw, x.doc_id, x.text))
    return train({x: [t for *_, t in sorted(v)[:sample]] for x, v in got.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of those names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)
    place = names.index("text")

    def run(batches):
        for b in batches:
            b = b.set_column(place, b.schema.field(place).with_type(pa.string()), b.column(place).cast(pa.string()))
            for rows in slices(b, "text"):
                langs, scores = predict(shared.value, rows.column(place))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, runs): the languages of each text's words, as runs (first, words, lang, score) in order; none without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            for rows in slices(b, "text"):
                found = [[dict(zip(("first", "words", "lang", "score"), r)) for r in own] for own in label(shared.value, rows.column("text"))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, kind)], names=["doc_id", "runs"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, runs array<struct<first: long, words: long, lang: string, score: double>>")


def op5_crf_language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    own = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs))
    return own.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
