import pathlib

import pytest
from pyspark.sql import functions as F

from lexspan.operators import adapters


def rows(spark, n=10):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("w"), "id").alias("word"))


def failing_judge(folder, times, error):
    """Fails so many times for each batch, whichever task asks."""

    def ask(part):
        mark = pathlib.Path(folder) / f"batch-{part[0]['k']}"
        seen = len(mark.read_text()) if mark.exists() else 0
        mark.write_text("x" * (seen + 1))
        if seen < times:
            raise error
        return [r["k"] % 2 == 0 for r in part]

    return ask


def test_a_judge_that_fails_twice_is_asked_again(spark, tmp_path):
    decide = adapters.batch_decider(failing_judge(tmp_path, 2, adapters.Unavailable("busy", after=0.0)), batch=3, tries=3, wait=0.0)
    got = {r.k: (r.accepted, r.reason) for r in decide(rows(spark).coalesce(1)).collect()}
    assert got == {k: (k % 2 == 0, None) for k in range(10)}
    assert sorted((p.name, len(p.read_text())) for p in tmp_path.iterdir()) == [(f"batch-{k}", 3) for k in (0, 3, 6, 9)]


@pytest.mark.parametrize(("error", "asked"), [(TimeoutError(), 2), (PermissionError("no"), 1)])
def test_a_judge_that_does_not_recover_rejects(spark, tmp_path, error, asked):
    decide = adapters.batch_decider(failing_judge(tmp_path, 9, error), batch=50, tries=2, wait=0.0)
    got = decide(rows(spark).coalesce(1)).collect()
    assert {(r.accepted, r.reason) for r in got} == {(False, f"error: {type(error).__name__}")}
    assert [len(p.read_text()) for p in tmp_path.iterdir()] == [asked]
    with pytest.raises(Exception, match="did not answer"):
        adapters.batch_decider(failing_judge(tmp_path, 99, error), tries=1, strict=True)(rows(spark)).collect()


def test_answers_that_are_missing_too_many_or_no_booleans(spark):
    few = adapters.batch_decider(lambda part: [True], batch=4)
    assert sorted((r.k, r.accepted, r.reason) for r in few(rows(spark, 3).coalesce(1)).collect()) == [(0, True, None), (1, False, "omitted"), (2, False, "omitted")]
    many = adapters.batch_decider(lambda part: [True] * 99)
    assert many(rows(spark, 3)).where("accepted").count() == 3
    odd = adapters.batch_decider(lambda part: ["yes"] * len(part))
    assert {r.reason for r in odd(rows(spark, 3)).collect()} == {"error: ValueError"}
    with pytest.raises(ValueError):
        adapters.batch_decider(lambda part: [], batch=0)
    assert few(rows(spark, 0)).count() == 0


def test_known_decisions(spark):
    known = spark.createDataFrame([(0, True, "fine"), (1, False, "odd")], "k int, accepted boolean, reason string")
    got = {r.k: (r.accepted, r.reason) for r in adapters.table_decider(known, ["k"])(rows(spark, 3)).collect()}
    assert got == {0: (True, "fine"), 1: (False, "odd"), 2: (False, "omitted")}
