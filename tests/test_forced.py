import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.operators import audit, forced

VOCABULARY = 12


def logits_of(context):
    return [float(x) for x in np.random.default_rng(list(context)).normal(size=VOCABULARY)]


def encode():
    return lambda text: [ord(c) % VOCABULARY for c in text if c != "?"]


SAMPLES = [(1, "a long way", "home"), (2, "a long way", "house"), (3, "a long way", "home"), (4, "b", "home"), (5, "b", "h")]


def test_paths_equal_one_call_for_each_step(spark, tmp_path):
    calls = str(tmp_path)

    def load():
        def model(contexts):
            assert len({len(c) for c in contexts}) == 1 and len(contexts) <= 3
            for c in contexts:
                with (pathlib.Path(calls) / "-".join(map(str, c))).open("a") as f:
                    f.write("x")
            return [logits_of(c) for c in contexts]

        return model

    df = forced.encoded(spark.createDataFrame(SAMPLES, "sample_id int, prefix string, word string"), encode)
    got = forced.forced_audit(df, forced.model_scorer(load, batch=3), [0.7, 1.0]).collect()
    expected = {}
    for i, prefix, word in SAMPLES:
        ids, context = encode()(" " + word), encode()(prefix)
        for k, token in enumerate(ids):
            row = spark.createDataFrame([(logits_of(context + ids[:k]), token)], "logits array<double>, token_id int")
            for r in audit.score_target(row, "logits", "token_id", [0.7, 1.0]).collect():
                expected[i, k, r.temperature] = (token, r["rank"], r.probability, r.cumulative_probability, len(ids))
    assert {(r.sample_id, r.word_token_index, r.temperature): (r.token_id, r["rank"], r.probability, r.cumulative_probability, r.word_token_count) for r in got} == expected
    # Each node of the trie was scored once, however many samples go through it.
    paths = {tuple(encode()(p) + encode()(" " + w)[:k]) for _, p, w in SAMPLES for k in range(len(w) + 1)}
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"-".join(map(str, p)): "x" for p in paths}


@pytest.mark.parametrize("sample", [(1, "?", "home"), (2, "a", "?"), (3, "a", None), (4, None, "b")])
def test_sides_without_ids_fail(spark, sample):
    load = lambda: lambda text: [ord(c) for c in text if c not in "? "]
    with pytest.raises(Exception, match="no token ids"):
        forced.encoded(spark.createDataFrame([sample], "sample_id int, prefix string, word string"), load).collect()


def test_prepared_prefixes_stay(spark):
    df = spark.createDataFrame([(1, "x", "b", [7, 7]), (2, "a", "b", None)], "sample_id int, prefix string, word string, prefix_ids array<int>")
    got = {r.sample_id: (r.prefix_ids, r.word_ids) for r in forced.encoded(df, encode).collect()}
    assert got == {1: ([7, 7], encode()(" b")), 2: (encode()("a"), encode()(" b"))}
    assert forced.nodes(forced.steps(forced.encoded(df.limit(0), encode))).count() == 0


def test_a_frequent_context_is_one_node(spark):
    rows = spark.range(2000).select(F.col("id").alias("sample_id"), F.array(F.lit(1), F.lit(2)).alias("prefix_ids"), F.array((F.col("id") % 5).cast("int"), F.lit(3)).alias("word_ids"))
    got = {tuple(r.context): r.targets for r in forced.nodes(forced.steps(rows)).collect()}
    assert got == {(1, 2): [0, 1, 2, 3, 4], **{(1, 2, k): [3] for k in range(5)}}
