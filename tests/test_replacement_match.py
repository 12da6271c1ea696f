from lexspan import queries


def test_all_rejected_documents_can_be_replaced_by_any_unlabelled_one(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = [(10, "s", 5), (14, "s", 6), (15, "s", 7), (16, "s", 5), (17, "s", 8), (18, "s", 8), (19, "s", 9), (20, "t", 10)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(10, 1, 0), (14, 0, 0), (15, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = sorted(map(tuple, queries.queries()["replacement_match"](spark, folder).collect()))
    assert got == [(14, "s", 17, 8), (15, "s", 19, 9)]
