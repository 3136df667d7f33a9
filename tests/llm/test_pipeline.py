"""The pipeline's stages, and its whole against the operators' brute force."""

import numpy as np
import pytest
from test_operators import KIND, docs, edited, plain_lines, prose, reference_ids

import corpus_pipeline
from shelfmark.llm import neardup


def folder(spark, tmp_path, rows, items):
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    item = prose(900, 25)
    rows = [(i, prose(i, 120)) for i in range(30)]
    rows += [(40, rows[3][1]), (41, edited(rows[4][1], 0.01, 1)), (42, prose(950, 60) + item + prose(951, 60)), (43, None), (44, "123"), (45, "")]
    d = folder(spark, tmp_path, rows, [(1, item)])
    held = spark.read.parquet(f"{d}/documents.parquet")
    names = [x.split(" ")[0] for x in KIND.split(", ")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, d)
        assert held.columns == names
    left = {r.doc_id: r for r in held.collect()}
    assert set(left) == set(range(30)) and all(r.n_chars == len(r.text) for r in left.values())
    lines = plain_lines([(i, t) for i, t in rows if t])
    assert all(r.text == "\n".join(lines[i, dict(rows)[i]][0]) for i, r in left.items())
    pieces = corpus_pipeline.run(spark, d).collect()
    for i, r in left.items():
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert sum(n for _, n, _ in own) == own[0][2] == len(reference_ids(r.text))
    assert {p.doc_id for p in pieces} == set(left)


def test_one_of_each_group_stays(spark, tmp_path):
    base = prose(5, 150)
    rows = [(i, edited(base, 0.01, i)) for i in range(10)] + [(20, prose(6, 80)), (20, prose(7, 80))]
    d = folder(spark, tmp_path, rows, [(1, prose(901, 20))])
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()
    kept = {r["component_id"] for r in neardup.op4_lsh_forest(docs(spark, rows)).collect()}
    assert sorted(r.doc_id for r in got) == sorted([*kept, 20])  # two unlike texts of one id


def test_rows_without_an_id_and_repeated_ones(spark, tmp_path):
    one, two, three = (prose(i, 80) for i in (31, 32, 33))
    rows = [(None, one), (None, one), (None, two), (7, two), (8, three), (8, three), (8, edited(one, 0.01, 2)), (9, one)]
    d = folder(spark, tmp_path, rows, [(1, prose(901, 20))])
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()
    assert sorted((r.doc_id, r.text == two) for r in got) == [(7, True), (8, False), (9, False)]
    alone = corpus_pipeline.near_dedup(spark, docs(spark, rows[:3]), d).collect()
    assert sorted(r.text for r in alone) == sorted([one, two])


CLASHES = {"score": "mine", "lang_pred": "xx", "n_lines": 99, "n_removed": 98, "spans": "own", "key": 97, "row": "r", "kept": "k", "component_id": 96, "__leak": 95, "part": "p", "item_id": 94, "at": 93, "h": 92, "p": 91, "value": "v", "a": 1, "b": 2, "s": 3, "overlap": "o"}


@pytest.mark.parametrize("stage", range(4))
def test_columns_come_back_as_they_were(spark, tmp_path, stage):
    clashes = CLASHES
    kind = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{k}` {'string' if isinstance(v, str) else 'long'}" for k, v in clashes.items())])
    rows = [(i, prose(i, 120), "en", "s", 0, *clashes.values()) for i in range(12)] + [(20, prose(3, 120), "en", "s", 0, *clashes.values())]
    d = folder(spark, tmp_path, [(1, "x")], [(1, prose(900, 25))])
    frame = spark.createDataFrame(rows, kind)
    got = corpus_pipeline.STAGES[stage][1](spark, frame, d)
    assert got.columns == frame.columns
    found = got.collect()
    assert len(found) >= 12 and all([r[k] for k in clashes] == list(clashes.values()) for r in found)
    empty = corpus_pipeline.STAGES[stage][1](spark, frame.limit(0), d)
    assert empty.columns == frame.columns and empty.count() == 0


def test_empty_tables(spark, tmp_path):
    d = folder(spark, tmp_path, [], [(1, "a b c d e f")])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")} and "pipeline" in entry.queries()
    assert np.all([q in entry.queries() for q in entry.oracle_sql()])
