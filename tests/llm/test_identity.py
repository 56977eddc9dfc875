"""Rows and ids that are not one to one, clashing column names, and the whole pipeline on awkward tables."""
import collections
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faresight.llm import common, language_id, mixing, ngram_join, secret_scan

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _text(k, n=120):
    return " ".join(f"w{k}x{(i * 7919 + k) % 100003}" for i in range(n))


def _near(text):
    w = text.split(" ")
    w[60] = "changed"
    return " ".join(w)


A, B, C = (_text(k) for k in (1, 2, 3))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rows, want", [
    ([(2, A), (3, B), (5, A), (5, B)], {2: 2, 3: 2, 5: 2}),
    ([(2, _near(A)), (3, _near(B)), (5, A), (5, B), (9, C)], {2: 2, 3: 2, 5: 2, 9: 9}),
    ([(7, A), (None, _near(A)), (None, B), (4, _near(B)), (None, C), (None, None), (6, ""), (6, A)],
     {7: 6, None: {None, 4, 6}, 4: 4, 6: 6}),
    ([(1, A), (1, A), (1, A), (2, _near(A))], {1: 1, 2: 1}),
], ids=["shared", "near", "null ids", "copies"])
def test_op1_one_document_with_several_texts(spark, rows, want):
    got = collections.defaultdict(set)
    out = ngram_join.ngram_components(_docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r.doc_id].add(r.component_id)
    assert got == {k: v if isinstance(v, set) else {v} for k, v in want.items()}


@pytest.mark.parametrize("rows, want", [
    ([(1, A), (5, A), (5, B)], [(1, A), (5, B)]),
    ([(1, A), (1, A), (2, _near(A)), (None, A)], [(1, A)]),
    ([(None, B), (None, B), (8, ""), (8, ""), (None, None)], [(None, B), (8, ""), (8, ""), (None, None)]),
    ([(3, A), (2, _near(A)), (4, C)], [(2, _near(A)), (4, C)]),
])
def test_op1_keeps_a_row_of_each_text(spark, rows, want):
    docs = _docs(spark, rows).withColumn("row", F.lit(1)).withColumn("c0", F.lit(2))
    kept = ngram_join.keep_first_of_component(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_leave_columns_of_any_name(spark):
    docs = _docs(spark, [(1, "password = hunter2secret and more"), (2, "plain words only"), (3, None), (4, "")])
    names = ["_t", "_m", "_a", "_k", "_h", "_c", "_base", "_all", "_more", "_bucket", "_s", "_r", "_n", "_size", "c0", "c1"]
    for c in names:
        docs = docs.withColumn(c, F.lit(f"keep {c}"))
    for stage in (secret_scan.redact, mixing.repeat_by_plan):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"keep {c}" for r in rows for c in names)
    text = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert "hunter2" not in text[1] and text[2] == "plain words only" and text[3] is None and text[4] == ""


def _table(docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_on_an_awkward_table(spark, tmp_path):
    en = "the cat and the dog were in the house with that man who was there for all of this time "
    de = "der hund und die katze waren nicht in dem haus mit einem mann der auch noch von der stadt kam "
    rows = [(k, (en + _text(k, 3)) * 3, "en", "a") for k in range(20)] + [(100 + k, (de + _text(k, 3)) * 3, "de", "b") for k in range(20)]
    rows += [(200, None, "en", "a"), (201, "", None, None), (202, "12345", "en", "a"), (203, en * 4000, "en", "b"),
             (0, (en + _text(0, 3)) * 3, "en", "a"), (None, (en + _text(1, 3)) * 3, "en", None), (205, (de + _text(77, 3)) * 3, "de", None),
             (204, (en + _text(50, 30)) * 2 + " password = hunter2secret", "en", "a")]
    docs = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], SCHEMA).repartition(3)
    for c in ("size", "row", "_t", "_bucket", "piece", "c0"):
        docs = docs.withColumn(c, F.lit("other"))
    out = corpus_pipeline.run(spark, _table(docs, tmp_path)).collect()
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    ids = {r.doc_id for r in out}
    assert ids and not {200, 201, 202} & ids
    again = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == ids


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _table(spark.createDataFrame([], SCHEMA), tmp_path)).collect() == []


def test_pipeline_sends_python_small_batches(spark, tmp_path):
    """Whole texts go to Python a few MB at a time; a smaller choice of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = _table(spark.createDataFrame([], SCHEMA), tmp_path)
    try:
        for given, then in (("64m", "4194304"), ("1m", "1m")):
            spark.conf.set(key, given)
            corpus_pipeline.keep_known_languages(spark, spark.read.parquet(f"{docs}/documents.parquet"), docs)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)


def test_fitting_a_language_model_copies_no_matrix():
    """The steps work on the matrix as given, whose last column is the bias."""
    rng = np.random.default_rng(3)
    x = np.hstack([rng.random((300, language_id.DIM), np.float32), np.ones((300, 1), np.float32)])
    y = np.where(np.arange(300) % 2, 1, -1).astype(np.float32)
    tracemalloc.start()
    try:
        w, _ = language_id._svm(x, y, steps=3)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(w) == language_id.DIM and most < x.nbytes / 2


def test_workers_give_back_memory_between_batches(monkeypatch):
    """What Arrow's pool holds unused goes back after every batch, also after the last one."""
    said = []

    class Pool:
        def __init__(self, name):
            self.name = name

        def release_unused(self):
            said.append(self.name)

    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: Pool("arrow"))
    monkeypatch.setattr(common.pa, "system_memory_pool", lambda: Pool("malloc"))
    for b in common.trimmed(iter([1, 2])):
        said.append(b)
    assert said == [1, "arrow", "malloc", 2, "arrow", "malloc"]
