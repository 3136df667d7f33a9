"""Chunks and summaries of whole texts: as column expressions, and for tables of texts in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

SIZE, OVERLAP, SECTION = 800, 120, 2500
_STATE = "struct<buf:string,out:array<string>>"


def _start() -> Column:
    return F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out")).cast(_STATE)


def _cut(c: Column, size: int) -> Column:
    """Pieces of ``size`` characters."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / size).cast("int")), lambda i: F.substr(c, i * size + 1, F.lit(size)))


def _pack(parts: Column, size: int, glue: str, carry=None, cut: bool = False) -> Column:
    """Greedy packing: parts are joined while they fit; ``carry`` makes the next one's start out of a full one."""

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["buf"] == "", p).otherwise(text.strip(F.concat(s["buf"], F.lit(glue), p)))
        full = F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"])))
        after = p
        if carry is not None:
            tail = F.when(s["buf"] == "", F.lit("")).otherwise(carry(s["buf"]))
            after = F.when(tail == "", p).otherwise(text.strip(F.concat(tail, F.lit(glue), p)))
        fresh = F.struct(after.alias("buf"), full.alias("out"))
        if cut:
            fresh = F.when(F.length(p) > size, F.struct(F.lit("").alias("buf"), F.concat(full, _cut(p, size)).alias("out"))).otherwise(fresh)
        return F.when(F.length(joined) <= size, F.struct(joined.alias("buf"), s["out"].alias("out"))).otherwise(fresh).cast(_STATE)

    return F.aggregate(parts, _start(), step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n{2,}"), text.strip), lambda p: p != "")


def pieces(c: Column, size: int = SIZE) -> Column:
    """Paragraphs; long ones as packed sentences; longer sentences cut."""
    return F.flatten(F.transform(paragraphs(c), lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_pack(text.sentences(p), size, " ", cut=True))))


def chunk_array(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of a text: none of an empty one, one of a short one; the end of each is carried into the next, which can
    make that longer than ``size``."""
    c = text.normalize(F.coalesce(c, F.lit("")))
    carry = (lambda b: text.overlap_tail(b, overlap)) if overlap > 0 else None
    packed = _pack(pieces(c, size), size, "\n\n", carry)
    return F.when(c == "", F.array().cast("array<string>")).when(F.length(c) <= size, F.array(c)).otherwise(packed)


def sub_chunks(c: Column, size: int = SECTION) -> Column:
    """Paragraphs packed to sections without overlap; longer ones cut; a short text is itself."""

    def step(s: Column, p: Column) -> Column:
        joined = F.when(s["buf"] == "", p).otherwise(text.strip(F.concat(s["buf"], F.lit("\n\n"), p)))
        full = F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"])))
        fresh = F.when(F.length(p) > size, F.struct(F.lit("").alias("buf"), F.concat(full, _cut(p, size)).alias("out"))).otherwise(F.struct(p.alias("buf"), full.alias("out")))
        return F.when(F.length(joined) <= size, F.struct(joined.alias("buf"), s["out"].alias("out"))).otherwise(fresh).cast(_STATE)

    packed = F.aggregate(paragraphs(c), _start(), step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))))
    return F.when(F.length(c) <= size, F.array(c)).when(F.size(packed) == 0, F.array(c)).otherwise(packed)


_STRIP, _END, _BREAK = " \t\n\x0b\f\r", re.compile(r"(?<=[.!?])\s+", re.ASCII), re.compile(r"\n{2,}")


def _joined(parts: Iterable[str], size: int, glue: str, overlap: int = 0) -> Iterator[str]:
    """Parts joined while they fit; a part longer than ``size`` is cut. With ``overlap``, the end of a full chunk begins the next."""
    held = ""
    for part in parts:
        if held and len(both := (held + glue + part).strip(_STRIP)) <= size:
            held = both
            continue
        if not held and len(part) <= size:
            held = part
            continue
        if held:
            yield held
        tail, held = _tail(held, overlap), ""
        if len(part) > size:
            yield from (part[i : i + size] for i in range(0, len(part), size))
        else:
            held = (tail + glue + part).strip(_STRIP) if tail else part
    if held:
        yield held


def _tail(full: str, n: int) -> str:
    if n <= 0 or len(full) <= n:
        return full if n > 0 else ""
    end = full[-n:]
    space = end.find(" ")
    return (end[space + 1 :] if 0 < space < n // 2 else end).strip(_STRIP)


def chunks_of(whole: str | None, size: int = SIZE, overlap: int = OVERLAP, breaks: bool = True) -> list[str]:
    """``chunk_array`` for one text, in time linear in its length: every part is looked at once, and what is held is a chunk.
    Without ``breaks`` blank lines end no paragraph: the text is one."""
    plain = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", whole or ""))).strip(_STRIP)
    if len(plain) <= size:
        return [plain] if plain else []
    some = lambda parts: (x for p in parts if (x := p.strip(_STRIP)))
    pieces = (x for p in some(_BREAK.split(plain) if breaks else [plain]) for x in ([p] if len(p) <= size else _joined(some(_END.split(p)), size, " ")))
    return list(_joined(pieces, size, "\n\n", overlap))


def chunk(docs: DataFrame, key: str, column: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, position, text): a row for each chunk, in Arrow batches of some MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, rows = [], [], []
            for i, whole in enumerate(batch.column(1).to_pylist()):
                own = chunks_of(whole, size, overlap)
                rows += [i] * len(own)
                at += range(len(own))
                texts += own
                if len(texts) > 5000 or i + 1 == batch.num_rows and texts:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(at, pa.int32()), pa.array(texts, pa.string())], names=[key, "position", "text"])
                    at, texts, rows = [], [], []

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(column).cast("string")).mapInArrow(run, f"`{key}` {kind}, position int, text string")


@F.udtf(returnType="position int, chunk string")
class Chunks:
    """The chunker as a table function: ``SELECT ... FROM docs, LATERAL chunks(text, size, overlap)``."""

    def eval(self, whole: str, size: int, overlap: int):
        yield from enumerate(chunks_of(whole, size, overlap))


def chunk_table(docs: DataFrame, key: str, column: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``chunk`` by the table function, as SQL would call it."""
    spark = docs.sparkSession
    spark.udtf.register("chunks", Chunks)
    docs.select(F.col(key).alias("k"), F.col(column).alias("t")).createOrReplaceTempView("__chunked")
    return spark.sql(f"SELECT k AS `{key}`, c.position, c.chunk AS text FROM __chunked, LATERAL chunks(t, {int(size)}, {int(overlap)}) c")


def scored_sentences(whole: str | None) -> list[tuple[int, str, float, int]]:
    """(p, sentence, score, rank) of a text's sentences of more than 30 characters, by mean frequency of their words in all of
    them; light words have no weight."""
    own = [x for part in _END.split(whole or "") if len(x := part.strip(_STRIP)) > 30]
    words = [re.findall("[a-z]{4,}", x.lower()) for x in own]
    count = Counter(w for some in words for w in some)
    for w in text.LIGHT_WORDS:
        count.pop(w, None)
    score = [sum(count[w] for w in some) / max(1, len(some)) for some in words]
    rank = {p: r for r, p in enumerate(sorted(range(len(own)), key=lambda p: (-score[p], p)), 1)}
    return [(p, own[p], score[p], rank[p]) for p in range(len(own))]


def ranked_sentences(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, p, s, score, r): ``scored_sentences`` of every text. All that is counted is within a text, so nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, whole in enumerate(batch.column(1).to_pylist()):
                own = scored_sentences(whole)
                at += [i] * len(own)
                rows += own
                if len(rows) > 2000 or i + 1 == batch.num_rows and rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.float64(), pa.int32())))], names=[key, "p", "s", "score", "r"])
                    at, rows = [], []

    return docs.select(key, F.col(column).cast("string")).mapInArrow(run, f"`{key}` {kind}, p int, s string, score double, r int")


def summarize(docs: DataFrame, key: str = "doc_id", column: str = "text", most: int = 6) -> DataFrame:
    """(key, summary): the best sentences in their order; the text's start where there is none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [" ".join(s for _, s, _, r in scored_sentences(whole) if r <= most) or (whole[:600] if whole is not None else None) for whole in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string())], names=[key, "summary"])

    return docs.select(key, F.col(column).cast("string")).mapInArrow(run, f"`{key}` {kind}, summary string")
