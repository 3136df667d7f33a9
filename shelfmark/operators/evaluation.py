"""Evaluation of retrieval, judges, skills and triggers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

ACCEPT, REJECT, DETERMINISTIC = 0.70, 0.40, 0.80
CRITICAL = ("has_name", "has_description", "has_instructions", "has_steps")


def first_hit(got: Column, expected: Column) -> Column:
    """Place from 1 of the first expected item in a list; 0 where there is none."""
    return F.coalesce(F.array_min(F.filter(F.transform(expected, lambda e: F.array_position(got, e)), lambda p: p > 0)), F.lit(0))


def reciprocal_rank(got: Column, expected: Column) -> Column:
    p = first_hit(got, expected)
    return F.when(p > 0, 1.0 / p).otherwise(F.lit(0.0))


def recall(got: Column, expected: Column) -> Column:
    """Share of the distinct expected items in the list; null without any expected."""
    return F.size(F.array_intersect(got, expected)) / F.nullif(F.size(F.array_distinct(expected)), F.lit(0))


def judge_alignment(scores: DataFrame) -> DataFrame:
    """Of (judge, score, human, answer, reviewed): n, mean absolute error, alignment and share within 0.2 for each judge.
    Rows whose answer changed since the review are stale; null scores don't count."""
    fresh = (F.coalesce("reviewed", F.lit("")) == "") | (text.collapse(F.col("answer")) == text.collapse(F.col("reviewed")))
    off = F.abs(F.col("score") - F.col("human"))
    return scores.where(fresh & F.col("score").isNotNull() & F.col("human").isNotNull()).groupBy("judge").agg(
        F.count("*").alias("n"), F.round(F.avg(off), 3).alias("mae"), F.round(1.0 - F.avg(off), 3).alias("alignment"), F.round(F.avg((off <= 0.2).cast("double")), 3).alias("within")
    )


def rubric_panel(scores: DataFrame) -> DataFrame:
    """Of (skill, judge, key, score): each judge's rounded mean and the mean of those."""
    each = scores.where("score is not null").groupBy("skill", "judge").agg(F.round(F.avg("score"), 3).alias("overall"))
    return each.groupBy("skill").agg(F.count("*").alias("judges"), F.round(F.avg("overall"), 3).alias("mean"))


def confusion(rows: DataFrame, want: str, got: str, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and their F1 out of the rounded two; null where nothing can be said."""
    w, g = F.col(want), F.col(got)
    c = rows.groupBy(*by).agg(F.count_if(w & g).alias("tp"), F.count_if(~w & g).alias("fp"), F.count_if(w & ~g).alias("fn"), F.count_if(~w & ~g).alias("tn"))
    c = c.withColumn("precision", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 3)).withColumn("recall", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 3))
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", F.when((p > 0) & (r > 0), F.round(2 * p * r / (p + r), 3)).when((p == 0) | (r == 0), 0.0))


def checks(skills: DataFrame) -> DataFrame:
    """Eleven structural checks of (name, description, instructions, steps, triggers, anti_triggers, tools, tests, grounded)."""
    s = lambda c: text.strip(F.coalesce(c, F.lit("")))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    steps = F.when(n("steps") > 0, n("steps")).otherwise(text.numbered_steps(F.col("instructions")))
    rules = {
        "has_name": F.length(s("name")).between(2, 80),
        "has_description": (F.length(s("description")) >= 20) & (F.size(F.filter(F.split(s("description"), r"\s+"), lambda w: w != "")) >= 5),
        "has_instructions": F.length(s("instructions")) >= 80,
        "has_steps": steps >= 2,
        "has_triggers": n("triggers") >= 1,
        "has_anti_triggers": n("anti_triggers") >= 1,
        "declares_tools": n("tools") >= 1,
        "has_positive_and_negative_tests": F.exists(F.coalesce("tests", F.array().cast("array<boolean>")), lambda x: x) & F.exists(F.coalesce("tests", F.array().cast("array<boolean>")), lambda x: ~x),
        "no_placeholders": ~text.has_placeholder(F.concat(s("description"), F.lit("\n"), s("instructions"))),
        "grounded_in_context": F.coalesce("grounded", F.lit(False)),
        "within_budget": F.length(s("instructions")) <= 6000,
    }
    failed = F.filter(F.array(*(F.when(~F.coalesce(v, F.lit(False)), k) for k, v in rules.items())), lambda x: x.isNotNull())
    out = skills.withColumn("failures", failed).withColumn("total", F.lit(len(rules))).withColumn("passed", F.col("total") - F.size("failures"))
    return out.withColumn("ratio", F.round(F.col("passed") / F.col("total"), 3)).withColumn("critical", F.array_intersect("failures", F.array(*map(F.lit, CRITICAL))))


def gate(ratio: Column, critical: Column, rubric: Column) -> Column:
    """critical: the number of failed critical checks; rubric: the panel's mean or null."""
    return (
        F.when((critical > 0) | (ratio < DETERMINISTIC), "reject").when(rubric.isNull(), "review").when(rubric >= ACCEPT, "accept").when(rubric < REJECT, "reject").otherwise("review")
    )


def mean_scores(examples: DataFrame, evaluators: dict[str, Callable[[dict], float | None]]) -> DataFrame:
    """(evaluator, n, mean, errors): every evaluator's mean over the examples that it scores. One that has no score for a row, or fails
    on it, leaves the row out, and failures are counted; the others go on. Each task adds up its own rows, so what is
    shuffled is a row for each evaluator and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, errors = Counter(), Counter(), Counter()
        for batch in batches:
            for row in batch.to_pylist():
                for name, call in evaluators.items():
                    try:
                        score = call(row)
                    except Exception:  # noqa: BLE001  an evaluator's failure is its own
                        errors[name] += 1
                        continue
                    if score is not None:
                        n[name] += 1
                        total[name] += float(score)
        names = list(evaluators)
        yield pa.RecordBatch.from_pydict({"evaluator": names, "n": [n[x] for x in names], "total": [float(total[x]) for x in names], "errors": [errors[x] for x in names]})

    parts = examples.mapInArrow(run, "evaluator string, n long, total double, errors long")
    summed = parts.groupBy("evaluator").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("errors").alias("errors"))
    return summed.select("evaluator", "n", F.round(F.try_divide("total", "n"), 6).alias("mean"), "errors")
