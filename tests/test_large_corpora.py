"""Steps that would otherwise be done anew for each token, end or query, or shuffle each token."""

import pytest
from pyspark.sql import functions as F

from lexspan import queries, stored
from lexspan.operators import corpus, selection, summary


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def calls(monkeypatch, module, name):
    made, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: made.append(1) or plain(*a, **k))
    return made


@pytest.mark.parametrize("group", [None, "lang"])
def test_only_different_tokens_are_normalised(spark, group):
    docs = spark.createDataFrame([("en", "Well, well- İx 'tis İ"), ("es", "well"), (None, None)], "lang string, text string")
    counts = corpus.word_frequency(docs, group=group)
    assert {r.word: r["count"] for r in counts.collect() if not group or r.lang is None} == {"well": 3, "tis": 1}
    if not group:  # no condition on words lies below the count of tokens
        assert "RLIKE" not in plan_of(counts).split("count(1)")[-1]


def test_texts_are_tiled_once(spark):
    docs = spark.createDataFrame([(1, "a b word c"), (2, None), (3, ""), (4, "none")], "doc_id long, text string")
    hits = corpus.occurrences(docs, spark.createDataFrame([("word",)], "word string"), 2, lowercase_only=True)
    assert plan_of(hits).count("regexp_extract_all") == 1
    assert [(r.doc_id, r.start, r.end, r.prefix) for r in hits.collect()] == [(1, 4, 8, "a b")]


def test_offsets_shuffle_no_token(spark):
    docs = spark.createDataFrame([(1, "«é ab’ - c"), (2, None), (3, ""), (4, "x"), (4, "y z")], "doc_id long, text string").coalesce(8)
    found = corpus.token_offsets(docs)
    assert sorted(map(tuple, found.collect()))[:4] == [(1, 0, "é", 1, 2), (1, 1, "ab’", 3, 6), (1, 2, "c", 9, 10), (4, 0, "x", 0, 1)]
    assert sorted(tuple(r)[1:] for r in found.where("doc_id = 4").collect()) == [(0, "x", 0, 1), (0, "y", 0, 1), (1, "z", 2, 3)]
    assert "hashpartitioning" not in plan_of(found) and dict(found.dtypes) == {"doc_id": "bigint", "index": "int", "token": "string", "start": "int", "end": "int"}


def test_prefixes_far_into_a_text(spark):
    texts = {1: "w" * 300 + " a'b'c'd '' e " + "x" * 90 + " end", 2: "a'- " * 400 + "end", 3: "\r\n".join(["one", "two"] * 200) + " end", 4: "- " * 300 + "a b c end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    starts = [(k, len(t.replace("\r\n", "\n")) - 3) for k, t in texts.items()]
    for context in (1, 2, 3):
        got = {r.doc_id: r.prefix for r in selection.repaired_prefixes(spark.createDataFrame(starts, "doc_id long, start int"), docs, context).collect()}
        want = {r.doc_id: r.prefix for r in corpus.occurrences(docs, spark.createDataFrame([("end",)], "word string"), context).collect()}
        assert got == want and len(got) == 4


def test_words_are_counted_once_for_missing_words(spark, monkeypatch):
    made = calls(monkeypatch, queries.C, "sample_words")
    assert queries.queries()["missing_words"](spark, "/root/testdata/sf0.001").columns == ["word", "found"]
    assert len(made) == 1


def test_accepted_contexts_are_found_once(spark, monkeypatch):
    rows = spark.createDataFrame([(w, i) for w in "abc" for i in range(3)], "word string, at int")
    made = calls(monkeypatch, stored, "written")
    out = corpus.accept(rows, F.col("at") >= 0, 2, 2, [F.col("at")], [F.col("word")])
    assert [tuple(r) for r in out.select("word", "at", "sample_id").orderBy("sample_id").collect()] == [("a", 0, "sample-000001"), ("a", 1, "sample-000002"), ("b", 0, "sample-000003"), ("b", 1, "sample-000004")]
    assert len(made) == 1


def test_generations_are_scored_once_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 10_000)
    rows = queries.generations(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(key)) == stored.ARROW_ROWS
    plans, plain = [], stored.written
    monkeypatch.setattr(stored, "written", lambda df: plans.append(plan_of(df)) or plain(df))
    summary.paired_effects(rows, ["model"], queries.grids.ENDPOINTS).collect()
    assert sum(p.count("ArrowEvalPython") for p in plans) == 1
