"""Tolerant readers of what models answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_text(c: Column) -> Column:
    """The text from the first { to the last }, without code fences; '' where there is none."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(object_text(c))).startswith("OBJECT"), F.lit(False))


def field(c: Column, path: str) -> Column:
    """A field as text; null where the answer is no valid object."""
    return F.when(is_object(c), F.get_json_object(object_text(c), path))


def judge_score(c: Column) -> Column:
    """The score of a judge's object (0 if it has none), else a bare number from 0 to 1, else null."""
    of_object = F.when(is_object(c), F.coalesce(F.get_json_object(object_text(c), "$.score"), F.lit("0.0")).try_cast("double"))
    bare = F.regexp_extract(c, r"(?<![\w.])(0(?:\.[0-9]+)?|1(?:\.0+)?)(?![\w.])", 1)
    return F.coalesce(of_object, bare.try_cast("double"))


def ranking(c: Column) -> Column:
    """The numbers of a re-ranker's list, in its order."""
    items = F.from_json(F.get_json_object(object_text(c), "$.ranking"), "array<string>")
    return F.coalesce(F.transform(F.filter(items, lambda x: x.rlike(r"^-?[0-9]+(\.[0-9]+)?$")), lambda x: x.cast("double").cast("int")), F.array().cast("array<int>"))


def artifact(answer: Column, spec: Column) -> Column:
    """A skill as a model answered it, its fields trimmed, with the spec's where it gave none: name, description, instructions,
    steps, triggers, anti_triggers, tools (without "none"), success_criteria of four keys, and tests that have a prompt (as JSON)."""
    own = lambda key: F.coalesce(field(answer, f"$.{key}"), F.lit(""))
    other = lambda key: F.coalesce(field(spec, f"$.{key}"), F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    read = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))

    def texts(key: str, fallback: bool = True) -> Column:
        mine = read(own(key))
        given = F.when(F.size(mine) > 0, mine).otherwise(read(other(key))) if fallback else mine
        return F.filter(F.transform(given, strip), lambda x: x != "")

    criteria = F.when(own("success_criteria").isin("", "{}"), other("success_criteria")).otherwise(own("success_criteria"))
    return F.struct(
        strip(F.when(own("name") == "", other("name")).otherwise(own("name"))).alias("name"), strip(F.when(own("description") == "", other("description")).otherwise(own("description"))).alias("description"),
        strip(own("instructions")).alias("instructions"), texts("steps", False).alias("steps"), texts("triggers").alias("triggers"), texts("anti_triggers").alias("anti_triggers"),
        F.filter(texts("tools"), lambda x: F.lower(x) != "none").alias("tools"),
        F.struct(*(F.coalesce(F.get_json_object(criteria, f"$.{k}"), F.lit("")).alias(k) for k in ("outcome", "process", "style", "efficiency"))).alias("success_criteria"),
        F.filter(read(own("tests")), lambda x: F.coalesce(F.get_json_object(x, "$.prompt"), F.lit("")) != "").alias("tests"),
    )
