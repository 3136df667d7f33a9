"""A training corpus from ``documents``: language, repeated lines, near-duplicates, benchmark copies, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents:

1.  language_id: documents that have no letters, or in which no language holds at least half of the words, go.
2.  line_dedup: lines that repeated three-line windows cover go; ``text`` and ``n_chars`` are those of the rest. A
    document of which nothing is left goes too.
3.  near_dedup: of each group of near-duplicates the one with the smallest doc_id stays. Rows without doc_id, and those
    that repeat one with another text, are documents like others; in a group they come after all that have their own id.
4.  decontaminate: documents that hold a test item of ``benchmark`` go.
5.  pack: the rest as sequences of 4096 token ids along a space-filling curve; a row for each piece.

Nulls: a null text has no language and goes in the first stage; rows without doc_id stay until packing, whose pieces are
named by it. Texts of any length are handled whole by each stage. Ties: of rows equal in doc_id and text one stays in the
third stage, any of them if other columns differ. Columns of any name come back as they were: inside a stage all but
those it works on have private names (``guarded``). Empty tables pass through as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate as decontamination
from shelfmark.llm import language, lines, neardup, packing
from shelfmark.llm.common import materialize, table
from shelfmark.llm.queries import vocabulary

SHARE = 0.5


def guarded(docs: DataFrame, step: Callable[[DataFrame], DataFrame], *used: str) -> DataFrame:
    """``step`` of the documents with all columns but the ``used`` ones under private names, then the columns as they were."""
    inside = [c if c in used else f"__own_{i}" for i, c in enumerate(docs.columns)]
    return step(docs.toDF(*inside)).select(*inside).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    fine = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SHARE)
    return guarded(docs, lambda d: language.identify(d, model).where(fine), "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def step(d: DataFrame) -> DataFrame:
        left = lines.dedup_lines(d).where("n_lines = 0 or n_removed < n_lines")
        if "n_chars" not in d.columns:
            return left
        return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return guarded(docs, step, "doc_id", "text", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """(..., key): doc_id, but for rows without one, and for those that repeat one with another text than its first by hash,
    a hash of id and text above 2^62."""
    of_text = F.xxhash64("text")
    other = F.pmod(F.xxhash64("doc_id", "text", F.lit("key")), F.lit(1 << 62)) + F.lit(1 << 62)
    docs = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), other))
    again = docs.where("doc_id is not null").groupBy("key").agg(F.min(of_text).alias("__first"), F.max(of_text).alias("__last")).where("__first <> __last")
    again = materialize(again, "pipeline-repeated")
    if again.isEmpty():
        return docs
    both = docs.join(again.drop("__last"), "key", "left")
    return both.withColumn("key", F.when(F.coalesce(F.col("__first") != of_text, F.lit(False)), other).otherwise(F.col("key"))).drop("__first")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def step(d: DataFrame) -> DataFrame:
        rows = keyed(d)
        kept = neardup.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("key"))
        return rows.join(kept, "key", "left_semi").dropDuplicates(["key"])

    return guarded(docs, step, "doc_id", "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return guarded(docs, lambda d: decontamination.clean(d, table(spark, sf_dir, "benchmark")), "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: No SQL: the language model, the links on hashed sets and the token ids have none; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
