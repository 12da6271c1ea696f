import pytest
from pyspark.sql import functions as F

from lexspan.operators import audit, coverage
from lexspan.plans import grids

ROWS = "sample_id string, word string, word_token_index int, rank int, probability double, cumulative_probability double, probability_ratio_to_top double"


def rows(spark, data):
    return spark.createDataFrame(data, ROWS).withColumn("model", F.lit("m")).withColumn("temperature", F.lit(1.0))


def covered(spark, audit_rows, points):
    paths = coverage.extremes(audit_rows, ["model", "temperature", "sample_id", "word"])
    got = coverage.context_coverage(paths, grids.grid(spark, points), ["model", "temperature"]).collect()
    return {(r.decoder, r.parameter): r.covered_contexts for r in got}


def test_every_token_must_survive(spark):
    data = [("a", "a", 0, 1, 0.1, 0.20, 0.9), ("a", "a", 1, 2, 0.1, 0.40, 0.8), ("b", "b", 0, 1, 0.1, 0.20, 0.9), ("b", "b", 1, 5, 0.1, 0.96, 0.01)]
    points = [("top_k", 2.0), ("top_k", 5.0), ("top_p", 0.5), ("top_p", 0.99), ("min_p", 0.05), ("min_p", 0.95)]
    assert [covered(spark, rows(spark, data), points)[p] for p in points] == [1, 2, 1, 2, 1, 0]


def test_top_p_keeps_the_token_that_crosses(spark):
    points = [("top_p", 0.44), ("top_p", 0.5)]
    got = covered(spark, rows(spark, [("x", "x", 0, 2, 0.1, 0.55, 0.2)]), points)
    assert [got[p] for p in points] == [0, 1]


def test_unknown_decoder_fails(spark):
    with pytest.raises(Exception, match="unknown decoder"):
        covered(spark, rows(spark, [("x", "x", 0, 2, 0.1, 0.55, 0.2)]), [("beam", 1.0)])


def test_words_with_any_and_all_contexts(spark):
    data = [("1", "a", 0, 1, 0.0, 0.20, 0.9), ("2", "a", 0, 50, 0.0, 0.99, 0.001), ("3", "b", 0, 50, 0.0, 0.99, 0.001), ("4", "b", 0, 60, 0.0, 0.99, 0.001)]
    paths = coverage.extremes(rows(spark, data), ["model", "temperature", "sample_id", "word"])
    for r in coverage.word_coverage(paths, grids.grid(spark, [("top_k", 10.0), ("top_p", 0.5), ("min_p", 0.05)]), ["model"]).collect():
        assert (r.total_words, r.total_contexts, r.covered_words_any, r.covered_words_all, r.covered_contexts) == (2, 4, 1, 0, 1)


def recipe(spark, rank, cumulative, probability, top, k, p):
    df = rows(spark, [("s", "w", 0, rank, probability, cumulative, 0.0)])
    df = df.withColumn("top_tokens", F.array(*[F.struct(F.lit(i).alias("token_id"), F.lit(x).alias("probability")) for i, x in enumerate(top)]))
    return coverage.recipe_paths(df, ["sample_id"], [grids.Recipe("r", k, p)]).first().survives


def test_recipes_renormalise_after_top_k(spark):
    assert recipe(spark, 3, 0.95, 0.05, [0.7, 0.2, 0.05], 3, 0.95)
    assert not recipe(spark, 4, 0.96, 0.01, [0.7, 0.25, 0.01], 3, 0.95)
    assert not recipe(spark, 3, 0.97, 0.01, [0.7, 0.25, 0.01], 3, 0.95)
    assert not recipe(spark, 2, 0.7, 0.1, [0.6, 0.1], 2, 0.8)
    assert not recipe(spark, 9, 0.7, 0.1, [0.6], 2, 0.8)
    with pytest.raises(Exception, match="fewer alternatives"):
        recipe(spark, 1, 0.7, 0.1, [0.6], 2, 0.8)


def scored(spark, logits, target, temperatures, **kw):
    df = spark.createDataFrame([(logits, target)], "logits array<float>, token_id int")
    return audit.score_target(df, "logits", "token_id", temperatures, **kw).orderBy("temperature").collect()


def test_ranks_top_and_neighbours(spark):
    (r,) = scored(spark, [0.0, 3.0, 1.0, 2.0], 3, [1.0], top=4)
    ids = lambda a: [x.token_id for x in a]
    assert (r["rank"], ids(r.top_tokens), ids(r.neighbors_above), ids(r.neighbors_below)) == (2, [1, 3, 2, 0], [1], [2])
    assert r.cumulative_probability == pytest.approx(r.top_probability + r.probability)


def test_temperature(spark):
    cold, hot = scored(spark, [3.0, 2.0, 0.0], 1, [0.5, 1.5])
    assert hot.probability > cold.probability and cold.top_probability > hot.top_probability
    with pytest.raises(ValueError):
        scored(spark, [1.0], 0, [0.0])


def test_completeness_and_last_rows(spark):
    df = spark.createDataFrame([("done", 0, 2, 1), ("done", 1, 2, 2), ("partial", 0, 2, 3), ("done", 1, 2, 4)], "sample_id string, word_token_index int, word_token_count int, pos int")
    df = df.withColumn("model", F.lit("m")).withColumn("temperature", F.lit(1.0))
    assert sorted((r.sample_id, r.pos) for r in audit.retain_complete(df, "pos").collect()) == [("done", 1), ("done", 4)]
    with pytest.raises(Exception, match="duplicate key"):
        audit.require_unique(df, ["sample_id", "word_token_index"]).collect()


def test_parsers():
    assert grids.parse_recipe("x:3:0.9") == grids.Recipe("x", 3, 0.9)
    assert grids.parse_strata("1:10:2, 11:20:3")[1] == grids.Stratum(11, 20, 3)
    for bad in ("9:1:2", "1:2", ""):
        with pytest.raises(ValueError):
            grids.parse_strata(bad)
    with pytest.raises(ValueError):
        grids.parse_temperatures("1,-1")
    assert len(grids.grid_rows()) == 53
