"""Queries against their SQL on small tables of rows that the given tables have only where they are large."""

import hashlib

import duckdb
import pytest

from shelfmark.plans import QUERIES, SQL


def same(spark, folder, tables, name):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for table, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cur = c.execute(SQL[name])
    order = sorted(d[0] for d in cur.description)
    place = [[d[0] for d in cur.description].index(x) for x in order]
    want = sorted(repr([r[i] for i in place]) for r in cur.fetchall())
    got = sorted(repr([r[x] for x in order]) for r in QUERIES[name](spark, folder).collect())
    assert got == want and got


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_pages_of_one_address(spark, tmp_path):
    html = sorted(("<p>a</p>", "<p>b</p>", "<p>c</p>"), key=lambda h: hashlib.sha256(h.encode()).hexdigest(), reverse=True)
    pages = [(i * 3, "http://one", h) for i, h in enumerate(html)] + [(1, "http://two", "x"), (2, "http://three", "y")]
    same(spark, str(tmp_path), {"pages": ("page_id long, url string, html string", pages), "documents": (DOCUMENTS, [(i, f"t{i}", "en", "s") for i in range(12)])}, "cac02")


@pytest.mark.parametrize("name", ["txt06", "grf04", "grf04_edges", "grf14_vectors"])
def test_sections_of_joined_parts(spark, tmp_path, name):
    """A sentence that is cut leaves a part without an end, to which the next is joined by a blank line."""
    long = " ".join(f"word{i}" for i in range(420)) + ". " + "And a short one that follows. " * 45
    same(spark, str(tmp_path), {"documents": (DOCUMENTS, [(7, long, "en", "s"), (14, "x" * 5200 + ". " + "Some more. " * 100, "en", "s"), (15, "short", "en", "s")])}, name)


def test_long_names_that_begin_alike(spark, tmp_path):
    word = "Abcdefghijklmno"
    text = f"so {word} {word} {word} {word} Xone is. and {word} {word} {word} {word} Xtwo was. Some Other Name here."
    same(spark, str(tmp_path), {"documents": (DOCUMENTS, [(7, text, "en", "s"), (8, f"see {word} {word} {word} {word} Xtwo there", "en", "s")])}, "grf17")
