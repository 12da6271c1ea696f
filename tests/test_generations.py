import random

import pytest
from pyspark.sql import functions as F

from lexspan import queries
from lexspan.functions import diversity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in "abcdefghijkl"[: 3 + i % 9]], k=200 + i)), "en", "s") for i in range(36)]
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_generations_have_the_mtld_of_their_tokens(spark, tables):
    folder, rows = tables
    expected = {}
    for i, text, *_ in rows:
        expected.setdefault(f"m{i % 3}", []).append(round(diversity.mtld_of(text.split()), 9))
    assert [sorted(r.v) for r in queries.generations(spark, folder).groupBy("model").agg(F.collect_list(F.round("mtld", 9)).alias("v")).orderBy("model").collect()] == [sorted(expected[m]) for m in sorted(expected)]
    got = {r.model: r.maximum for r in queries.queries()["metric_outliers"](spark, folder).where("metric = 'mtld'").collect()}
    assert got == {m: max(v) for m, v in expected.items()}
