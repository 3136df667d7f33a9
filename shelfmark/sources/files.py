"""Readers of files: graphs, lines of JSON, vectors, plain files, lists of addresses, evaluation sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html, text
from . import matrices, pages

SUFFIXES = ("txt", "md", "markdown", "rst", "html", "htm", "csv", "json", "log", "pdf")
#: Layers by type of node.
LAYERS = {"source": 0, "section": 1, "chunk": 2, "entity": 3, "topic": 4, "synthesis": 5}
NODE = "id string, type string, layer int, name string, title string, text string, preview string, summary string, kind string, aliases array<string>, importance int, mentions int, url string"
EDGE = "id string, `from` string, `to` string, kind string, label string, confidence string, chunk_id string"


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph files. What isn't JSON counts as empty; missing fields get their defaults."""
    raw = spark.read.option("wholetext", True).text(path)
    both = raw.select(F.from_json("value", f"nodes array<struct<{_struct(NODE)}>>, edges array<struct<{_struct(EDGE)}>>").alias("g"))
    nodes = both.select(F.explode("g.nodes").alias("n")).select("n.*").where("id is not null")
    layer = F.element_at(F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv)), F.col("type"))
    nodes = nodes.withColumns({"layer": F.coalesce("layer", layer), "aliases": F.coalesce("aliases", F.array().cast("array<string>")), "importance": F.coalesce("importance", F.lit(3)), "summary": F.coalesce("summary", F.lit("")), "mentions": F.coalesce("mentions", F.lit(1))})
    return nodes, both.select(F.explode("g.edges").alias("e")).select("e.*").withColumnsRenamed({"from": "src", "to": "dst"})


def _struct(fields: str) -> str:
    out = []
    for part in fields.split(", "):
        name, kind = part.strip().split(" ", 1)
        out.append(f"{name}:{kind}")
    return ",".join(out)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A row for each line of JSON; blank lines are none, broken ones go to ``_corrupt_record`` if the schema has it. A line without
    any of the schema's fields is a row of nulls."""
    lines = spark.read.text(path).where(text.strip(F.col("value")) != "")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("row")).select("row.*")


def vectors(spark: SparkSession, path: str, rows: int = 100_000, columns: tuple[str, ...] = matrices.COLUMNS) -> DataFrame:
    """(file, row, embedding) of the .npy files below a path, ``rows`` rows of a matrix at a time; without ``embedding`` among the
    columns only headers are read."""
    spark.dataSource.register(matrices.Matrices)
    return spark.read.format("npy").options(path=path, rows=rows, columns=",".join(columns)).load()


def walk(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, suffix, content) of all files below a folder that have one of the suffixes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", suffix.alias("suffix"), "content").where(F.col("suffix").isin(*suffixes))


def decoded(files: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text): HTML by its main text, PDF by a callable (left out without one), the rest as UTF-8 with marks for what isn't."""
    plain = files.where(~F.col("suffix").isin("html", "htm", "pdf")).select("path", F.decode("content", "UTF-8").alias("text"))
    pages = files.where(F.col("suffix").isin("html", "htm")).select("path", html.main_text_of(F.decode("content", "UTF-8")).alias("text"))
    both = plain.unionByName(pages)
    if pdf is not None:
        read = F.pandas_udf(lambda x: x.map(pdf), "string", F.PandasUDFType.SCALAR)
        both = both.unionByName(files.where(F.col("suffix") == "pdf").select("path", read("content").alias("text")))
    return both


def looks_like_pdf(url: Column, content_type: Column, head: Column) -> Column:
    """By declared type, by the address's end, or by the first bytes."""
    declared = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))
    named = F.coalesce(F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".pdf"), F.lit(False))
    return declared | named | F.coalesce(F.substring(F.hex(head), 1, 10) == "255044462D", F.lit(False))


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """(url): the lines that start with http, each once."""
    return spark.read.text(path).select(text.strip(F.col("value")).alias("url")).where(F.col("url").startswith("http")).distinct()


def examples(spark: SparkSession, path: str) -> DataFrame:
    """(question, expected_urls, titles, key_points) of an evaluation set with one or several addresses an example."""
    raw = spark.read.option("wholetext", True).text(path)
    item = "struct<question:string,expected_url:string,expected_urls:array<string>,title:string,titles:array<string>,key_points:array<string>,inputs:struct<question:string>,outputs:struct<expected_url:string,expected_urls:array<string>>>"
    e = raw.select(F.explode(F.from_json("value", f"examples array<{item}>")["examples"]).alias("e"))
    one = F.coalesce("e.expected_url", "e.outputs.expected_url")
    urls = F.coalesce("e.expected_urls", "e.outputs.expected_urls", F.when(one.isNotNull(), F.array(one)))
    return e.select(F.coalesce("e.question", "e.inputs.question").alias("question"), F.array_distinct(urls).alias("expected_urls"), F.coalesce("e.titles", F.array("e.title")).alias("titles"), F.coalesce("e.key_points", F.array().cast("array<string>")).alias("key_points"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(question, human_score, reviewed_answer): people's scores, kept in a map by question."""
    raw = spark.read.option("wholetext", True).text(path)
    kind = "labels map<string,struct<human_score:double,reviewed_answer:string,notes:string,reviewed:boolean>>"
    return raw.select(F.explode(F.from_json("value", kind)["labels"]).alias("question", "l")).select("question", "l.*")


def fetched(addresses: DataFrame, fetch: Callable[[str], dict]) -> DataFrame:
    """(url, title, text, date, error): pages by a callable; a failure is a row's error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([pages.page(fetch, url) for url in part["url"]], columns=["url", "title", "text", "date", "error"])

    return addresses.select("url").mapInPandas(run, pages.PAGE)
