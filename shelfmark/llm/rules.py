"""Quality rules as a ledger of bits (operator 13).

``measure`` reads every text once and counts; ``ledger`` adds a 64-bit integer to the counts, with one bit for each rule
that the document fails, and writes both as a table. Policies are masks over those bits, each under a version: applying
one, or another one later, reads the ledger alone and never a text. ``ablations`` says what each rule of a policy is worth:
the documents that it alone rejects, found from bits & mask by grouping equal bits first, so that at most as many rows as
there are patterns are left, whatever the number of documents.

Words are runs of bytes other than space and \\t to \\r; counts of characters are of code points. Windows of eight words are
compared as numbers of numbers of words, by doubling, so that nothing rests on a hash.

Rows: a null text has no words and is treated as an empty one; both fail the rule of few words. Rows without doc_id, and
rows that repeat one, are rows of the ledger like others. Long texts are handled whole: work is in slices of some MB, and
a longer text stands alone. Ties don't arise. Other columns are not carried; a column of ``docs`` named like one of the
ledger plays no part. Empty tables give empty ledgers, and ablations of zeros.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, slices

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_words", "n_letters", "n_upper")
MEASURES = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])

#: (name, SQL over the counts): a rule's place is its bit, so rules are added at the end and none is removed or moved.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_lines > 3 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("same_words", "100 * n_same_words > 20 * n_words"),
    ("capitals", "n_letters > 0 and 2 * n_upper > n_letters"),
    ("few_letters", "2 * n_letters < word_chars"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")
#: Policies by version; a document is kept if it fails none of a version's rules. Versions are never changed, only added.
POLICIES: dict[str, tuple[str, ...]] = {"1": BASE, "2": tuple(BIT)}
CURRENT = "2"


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(1 << BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeated(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, its words within windows that it has twice or more; ids and documents of all words in order."""
    many = np.zeros(n_docs, np.int64)
    if len(ids) < WINDOW:
        return many
    number, span = ids.astype(np.int64), 1
    while span < WINDOW:
        pair = number[:-span] * (number.max() + 1) + number[span:]
        number, span = pd.factorize(pair)[0].astype(np.int64), 2 * span
    inside = np.flatnonzero(doc[: len(number)] == doc[WINDOW - 1 :])
    own = pd.factorize(doc[inside] * (number.max() + 1) + number[inside])[0]
    again = inside[np.bincount(own)[own] > 1] if len(own) else inside
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    np.add.at(many, doc[np.cumsum(edge[:-1]) > 0], 1)
    return many


def _measured(batches):
    """(doc_id, counts) of each row."""
    for rows in batches:
        for part in slices(rows, "text"):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            split = [t.split() for t in texts]  # bytes are split at the six spaces of ASCII alone
            n = np.array([len(w) for w in split], np.int64)
            words = pa.array([w for own in split for w in own], pa.binary())
            ids = np.asarray(words.dictionary_encode().indices, np.int64) if len(words) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(texts)), n)
            same = np.zeros(len(texts), np.int64)
            if len(ids):
                np.add.at(same, doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])], 1)
            out = [n, [], [], [], _repeated(ids, doc, len(texts)), [], same, [], []]
            for t in texts:
                lines = [x for x in t.split(b"\n") if x.strip(SPACES)]
                bare = t.translate(None, SPACES)
                chars = len(bare.decode())
                upper, lower = (len(bare) - len(bare.translate(None, c)) for c in (UPPER, LOWER))
                out[1].append(chars)
                out[2].append(len(t) - len(t.translate(None, SYMBOLS)))
                out[3].append(len(lines) - len(set(lines)))
                out[5].append(len(lines))
                out[7].append(upper + lower if bare.isascii() else upper + lower + sum(c.isalpha() for c in bare.decode() if c > "\x7f"))
                out[8].append(upper)
            yield batch(_SCHEMA, part.column("doc_id"), *out)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, counts) of every row: all that rules need, from one reading of the texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measured, MEASURES)


def failures(rules: list[tuple[str, str]] = RULES) -> Column:
    """The bits of the rules that a row of counts fails."""
    bit = lambda i, sql: F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    out = F.lit(0).cast("long")
    for i, (_, sql) in enumerate(rules):
        out = out.bitwiseOR(bit(i, sql))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, failed) of every row, written to the shared folder: each rule is evaluated once, here."""
    return materialize(measure(docs).withColumn("failed", failures()), "rules-ledger")


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger's rows with policy, rejected_by (bits) and kept under a version."""
    by = F.col("failed").bitwiseAND(F.lit(mask(version)).cast("long"))
    return rows.withColumns({"policy": F.lit(version), "rejected_by": by, "kept": by == 0})


def patterns(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """(rejected_by, n): documents by the bits that they fail of a policy."""
    return rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(version)).cast("long")).alias("rejected_by")).agg(F.count("*").alias("n"))


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """(rule, bit, n_failed, n_only, n_kept): for each rule of a policy the documents that fail it, those that it alone
    rejects, and those that the policy would keep without it."""
    rules = POLICIES[version]
    listed = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit"), F.lit(1 << BIT[r]).cast("long").alias("own")) for r in rules))
    by, own = F.col("rejected_by"), F.col("own")
    counted = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    found = patterns(rows, version).select("rejected_by", "n", F.inline(listed))
    found = found.groupBy("rule").agg(counted(by.bitwiseAND(own) != 0).alias("n_failed"), counted(by == own).alias("n_only"), counted((by == 0) | (by == own)).alias("n_kept"))
    every = rows.sparkSession.createDataFrame([(r, BIT[r]) for r in rules], "rule string, bit int")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(found, "rule", "left").select("rule", "bit", zero("n_failed"), zero("n_only"), zero("n_kept"))


def op13_rule_ledger(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed, policy) of every document."""
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return apply_policy(ledger(docs), version).select("doc_id", *COUNTS[:5], base.alias("base_failed"), "kept", "failed", "policy")


def op13_ablations(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ablations of a policy over all documents."""
    return ablations(ledger(docs), version)


_COUNTS_SQL = r"""
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
s AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM w),
o AS (SELECT r, p, x, lag(x) OVER o = x AS same, string_agg(x, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win, lead(p, 7) OVER o IS NOT NULL AS whole FROM s WINDOW o AS (PARTITION BY r ORDER BY p)),
k AS (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS n FROM o WHERE whole), same AS (SELECT r, count(*) AS n FROM o WHERE same GROUP BY r),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, p + unnest(range(0, 8)) AS p FROM k WHERE n > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
 coalesce(same.n, 0) AS n_same_words,
 length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN c USING (r) LEFT JOIN same USING (r)),
"""
_FAILED_SQL = " + ".join(f"CASE WHEN {sql} THEN {1 << i} ELSE 0 END" for i, (_, sql) in enumerate(RULES))
_LEDGER_SQL = f"WITH {_COUNTS_SQL} f AS (SELECT *, ({_FAILED_SQL})::BIGINT AS failed FROM m)"
OP13_SQL = f"""{_LEDGER_SQL} SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
n_repeat_words::BIGINT AS n_repeat_words, (failed & {mask(BASE)}) <> 0 AS base_failed, (failed & {mask(CURRENT)}) = 0 AS kept, failed, '{CURRENT}' AS policy FROM f"""
ABLATIONS_SQL = f"""{_LEDGER_SQL}, r AS (SELECT unnest({list(POLICIES[CURRENT])}) AS rule, unnest({[BIT[r] for r in POLICIES[CURRENT]]}) AS bit)
SELECT rule, bit, count(*) FILTER ((failed >> bit) & 1 = 1) AS n_failed, count(*) FILTER (failed = 1 << bit) AS n_only, count(*) FILTER (failed & ~(1 << bit) = 0) AS n_kept FROM r, f GROUP BY ALL"""
