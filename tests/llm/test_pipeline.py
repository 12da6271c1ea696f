"""The pipeline against brute force, stage by stage, and as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspan.llm import line_dedup, toxicity
from tests.llm.test_operators import BYTES, components_by_force, dedup_by_force, edited, hits_by_force, ids_of, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base, passage, shared = prose(150, 70), prose(30, 71), prose(55, 72)
    texts = [(i, prose(30 + i % 50, 300 + i)) for i in range(120)]
    texts += [(200 + i, edited(base, i % 3, i)) for i in range(8)] + [(300 + i, f"{prose(20, 400 + i)} {passage} {prose(9, 500 + i)}") for i in range(4)]
    texts += [(350 + i, f"{prose(15, 600 + i)}\n{shared}\n{prose(15, 700 + i)}") for i in range(5)] + [(360, None), (361, ""), (362, texts[3][1])]
    toxic = []
    for i in range(40):
        w = prose(40, 800 + i).split()
        for _ in range(4):
            w.insert(random.Random(i).randrange(len(w)), random.Random(i).choice(["idiot", "moron"]))
        toxic.append((400 + i, " ".join(w)))
    where = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(texts + toxic, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d >= 400)) for d, t in texts + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, prose(20, 99))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{folder}/labels.parquet")
    bench = [(1, prose(30, 71)), (2, prose(20, 99))]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, labels)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            scores = dict(zip([d for d, _ in rows], model.scores([t or "" for _, t in rows]), strict=True))
            rows = [(d, t) for d, t in rows if scores[d] < toxicity.THRESHOLD]
            assert not {d for d, _ in rows} & set(range(400, 440)) and len(rows) >= 135
        elif name == "line_dedup":
            texts = dedup_by_force(rows, line_dedup.MIN_WORDS)
            rows = [(d, texts.get(d)) for d, _ in rows]
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
        elif name == "ngram_jaccard_join":
            kept = {c for _, _, c in components_by_force(rows)}
            rows = [(d, t) for d, t in rows if d in kept]
        else:
            rows = [(d, t) for d, t in rows if not hits_by_force(t, bench)[-1]]
            assert not {300, 301, 302, 303} & {d for d, _ in rows}
        assert sorted((r.doc_id, r.text or "") for r in docs.collect()) == sorted((d, t or "") for d, t in rows)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in packed) == sorted((d, 0, len(ids_of(BYTES, t)) + 1) for d, t in rows)


def test_stages_of_empty_tables_and_of_columns_with_clashing_names(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = {c: F.lit(f"{c}!") for c in ("doc", "mark", "part", "line", "n_lines", "n_deleted", "kept", "id", "n", "w", "item_id", "component_id", "score")}
    few = docs.where("doc_id in (1, 2, 200, 300, 360, 361)").withColumns(extra)
    few.write.parquet(f"{tmp_path}/few")
    few = spark.read.parquet(f"{tmp_path}/few")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, few, folder)
        rows = out.collect()
        assert out.columns == few.columns and all(r["mark"] == "mark!" and r["n_lines"] == "n_lines!" for r in rows)
        assert {1, 2, 200, 360, 361} <= {r.doc_id for r in rows} <= {1, 2, 200, 300, 360, 361}, name
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, docs.limit(0), folder).count() == 0 and pack(spark, few, folder).count() == few.count()
