import pytest

import corpus_pipeline
from fluxlode.llm.store import written

DIR = "/root/testdata/sf0.001"


def test_stages_run_in_turn_and_keep_the_columns(spark, docs_of):
    import os

    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) >= 0.6 * len(before)
        before = after
    whole = written(corpus_pipeline.STAGES[-1][1](spark, docs, DIR), "packed")
    assert {r.doc_id for r in whole.select("doc_id").collect()} == before
    direct = corpus_pipeline.run(spark, DIR)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, direct.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))


def test_near_duplicates_equal_brute_force(spark, docs_of):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:k], "x", *base[k + 1 :]])) for i, k in enumerate((0, 59, 58, 30, 31))] + [(10, " ".join(base)), (11, "other words here"), (12, "other words here"), (13, ""), (14, None)]
    sets = {i: {tuple((t or "").split()[j : j + 5]) for j in range(len((t or "").split()) - 4)} or ({tuple(t.split())} if t else set()) for i, t in rows}
    label = {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(rows), DIR).collect()}
    assert got == set(label.values())


def test_stages_keep_clashing_and_missing_columns(spark):
    """Columns named as inner ones stay as they are, and n_chars may be missing."""
    line = "A shared notice line with enough words to go 12"
    rows = [(i, f"own text {i} of this document here\n{line}", "own", 7, "x") for i in range(6)] + [(50, None, "own", 7, "x"), (51, "", "own", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, gone_lines int, labelled_good string")
    got = corpus_pipeline.line_dedup(spark, docs, DIR)
    assert got.schema == docs.schema
    out = {r.doc_id: r for r in got.collect()}
    assert all((r.n_lines, r.gone_lines, r.labelled_good) == ("own", 7, "x") for r in out.values())
    assert [line in (out[i].text or "") for i in range(6)] == [True] + [False] * 5 and out[50].text is None
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.line_dedup):
        assert stage(spark, docs.limit(0), DIR).collect() == []
    assert corpus_pipeline.packing(spark, docs, DIR).count() == len(rows)


def test_line_dedup_stage_counts_characters(spark, docs_of):
    line = "Another shared notice line with enough words 5"
    docs = docs_of([(i, f"own words {i} stand here too\n{line}") for i in range(6)] + [(9, "short"), (10, None)])
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, DIR).collect()}
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got.values())


def test_rows_that_repeat_a_document_leave_one(spark, docs_of):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (3, ""), (3, ""), (None, "a b c d e f g"), (4, None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs_of(rows), DIR).collect()]
    assert got.count((1, "a b c d e f g")) == 1 and got.count((1, "h i j k l m n")) == 1 and (2, "h i j k l m n") not in got
    assert (None, "a b c d e f g") in got and (4, None) in got and got.count((3, "")) == 1
