"""Line deduplication by overlapping three-line windows (operator 2), in DataFrame functions alone.

A text is split at line feeds. Every three consecutive lines are a window; a window whose three lines occur before, in
the order of (doc_id, line number), is a repeat, and all lines that repeats cover are removed. Windows are compared by
128 bits of hash. First occurrences come from a grouped minimum, which executors combine before the shuffle, and meet
the windows in an equi-join that adaptive execution can split, so a window in a third of all documents is no hot spot.

Rows: null text has no lines and stays null; an empty text is one empty line; texts of fewer than three lines have no
window and stay whole. Rows without doc_id take no part and stay. Rows equal in doc_id and text count as one document
and get the same result. Long texts are handled by spans, in time linear in their lines. Other columns pass through;
``n_lines``, ``n_removed`` and ``spans`` replace columns of those names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LINES = 3
_ID, _K = "__line_doc", "__line_text"


def _hashes(lines: Column) -> Column:
    """A struct of two independent 64-bit hashes for each window."""
    one = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b")))
    return F.when(
        F.size(lines) >= LINES,
        F.transform(
            F.sequence(F.lit(0), F.size(lines) - LINES),
            lambda i: F.struct(
                F.xxhash64(*(F.col("__h")[i + k]["a"] for k in range(LINES))).alias("a"),
                F.xxhash64(*(F.col("__h")[i + k]["b"] for k in reversed(range(LINES)))).alias("b"),
            ),
        ),
    ), one


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, text hash, spans): the maximal runs of lines to remove, [first, last] from 0, of documents that have any."""
    lines = F.split("text", "\n", -1)
    windows, one = _hashes(lines)
    windows = (
        docs.where("doc_id is not null and text is not null")
        .select(F.col("doc_id").cast("long").alias(_ID), F.xxhash64("text").alias(_K), F.col("text").alias("text"))
        .withColumn("__h", one)
        .select(_ID, _K, F.posexplode(windows).alias("p", "h"))
        .select(_ID, _K, "p", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    )
    where = F.struct(_ID, _K, "p")
    first = windows.groupBy("a", "b").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = windows.join(materialize(first, "line-first"), ["a", "b"]).where(where != F.col("first"))
    at = F.col("at")
    starts = F.filter("at", lambda x, i: (i == 0) | (x > F.get(at, i - 1) + LINES))
    ends = F.transform(F.filter("at", lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + LINES)), lambda x: x + LINES - 1)
    return (
        later.groupBy(_ID, _K)
        .agg(F.array_sort(F.collect_set("p")).alias("at"))
        .select(_ID, _K, F.arrays_zip(starts.alias("first"), ends.alias("last")).alias("spans"))
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining lines as text, and n_lines, n_removed, spans."""
    keys = docs.drop("n_lines", "n_removed", "spans").withColumns({_ID: F.col("doc_id").cast("long"), _K: F.xxhash64("text")})
    joined = keys.join(repeated_spans(docs), [_ID, _K], "left").withColumn("__lines", F.split("text", "\n", -1))
    spans = F.col("spans")
    n = F.size("__lines")

    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["last"] + 1)
        end = F.when(i == F.size(spans), n).otherwise(F.get(spans, i)["first"])
        return F.slice("__lines", start + 1, end - start)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), between))
    removed = F.aggregate("spans", F.lit(0), lambda s, x: s + x["last"] - x["first"] + 1)
    return joined.withColumns({
        "n_lines": F.coalesce(n, F.lit(0)).cast("long"),
        "n_removed": F.coalesce(removed, F.lit(0)).cast("long"),
        "text": F.when(spans.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        "spans": F.coalesce(spans, F.array().cast("array<struct<first:int,last:int>>")),
    }).drop(_ID, _K, "__lines")


def op2_line_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_spans, kept_sha256) of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP2_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l),
w AS (SELECT doc_id, p, row_number() OVER (PARTITION BY ls[p], ls[p + 1], ls[p + 2] ORDER BY doc_id, p) AS k FROM p),
c AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS p FROM w WHERE k > 1),
e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM l),
j AS (SELECT e.doc_id, e.p, line, c.p IS NOT NULL AS gone FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM j),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
             coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
