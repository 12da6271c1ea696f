import json

import pytest
from pyspark.sql import functions as F

from lexspan.operators import audit
from lexspan.sources import merge, publish


def check(df):
    return df.agg((F.count("*") >= 3).alias("valid"))


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_only_what_passes_is_put_in_place(spark, tmp_path, kind):
    path = f"file://{tmp_path}/table"
    assert publish.publish(spark.range(5), path, check, kind).count() == 5
    with pytest.raises(publish.Refused):
        publish.publish(spark.range(2), path, check, kind)
    assert publish.read(spark, path, "id long", kind).count() == 5
    assert publish.publish(spark.range(7), path, check, kind).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_a_failing_write_keeps_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    publish.publish(spark.range(5), path, check)
    with pytest.raises(Exception, match="broken"):
        publish.publish(spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path, check)
    assert publish.read(spark, path, "id long").count() == 5 and [p.name for p in tmp_path.iterdir()] == ["table"]


def test_a_run_that_was_lost_between_renames(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    publish.publish(spark.range(5), path, check)
    publish.rename(spark, path, f"{path}.old")  # lost here: the old version goes back
    assert publish.read(spark, path, "id long").count() == 5
    spark.range(9).write.parquet(f"{path}.old")  # lost after the second rename: the old version goes
    assert publish.read(spark, path, "id long").count() == 5 and not publish.exists(spark, f"{path}.old")


def test_validity_of_audits(spark):
    fields = "sample_id int, audit_schema_version int, top_tokens array<int>, rank_neighbor_count int, neighbors_above array<int>, neighbors_below array<int>"
    good = [(1, 2, [1, 2], 1, [], [3]), (2, 3, [1, 2, 3], 1, [4], [])]
    valid = lambda rows: audit.validity(spark.createDataFrame(rows, fields), 2, 2, 1).first().valid
    assert valid(good)
    for bad in ((2, 1, [1, 2], 1, [], []), (2, 2, [1], 1, [], []), (2, 2, [1, 2], 2, [], []), (2, 2, [1, 2], 1, None, []), (2, None, [1, 2], 1, [], []), (1, 2, [1, 2], 1, [], [])):
        assert not valid([good[0], bad])
    assert not valid([])


def folder(top, audits):
    for name, rows in audits.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(json.dumps(r) + "\n" for r in rows) + "\n")
    return str(top)


def row(sample, k, mark):
    return {"sample_id": sample, "k": k, "mark": mark, "text": "ü 'x'"}


BASE = {name: [row(s, k, name) for k in range(2) for s in ("c", "a", "b")] for name in ("audit.m1.jsonl", "deep/er/audit.m2.jsonl", "audit.m3.jsonl", "other.jsonl")}


def test_folders_are_merged_file_by_file(spark, tmp_path):
    delta = {name: [row("a", k, "new") for k in range(3)] for name in ("audit.m1.jsonl", "deep/er/audit.m2.jsonl")}
    base_dir, delta_dir, out = folder(tmp_path / "base", BASE), folder(tmp_path / "delta", delta), tmp_path / "out"
    changed = spark.createDataFrame([("a",)], "sample_id string")
    assert merge.merge_directories(spark, base_dir, delta_dir, str(out), changed) == sorted(delta)
    for name in delta:
        parts = sorted(p for p in (out / name).iterdir() if p.name.startswith("part-"))
        got = [json.loads(line) for p in parts for line in p.read_text().splitlines()]
        old = [r for r in BASE[name]]
        of = lambda s: [r for r in old if r["sample_id"] == s]
        assert got == of("c") + delta[name] + of("b")
    assert not (out / "audit.m3.jsonl").exists() and [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []


@pytest.mark.parametrize(("delta", "changed", "error"), [
    ({"audit.m1.jsonl": [row("a", 0, "n")]}, ["a", "b"], ValueError), ({"audit.m1.jsonl": [row("a", 0, "n"), row("b", 0, "n")]}, ["a"], ValueError),
    ({"audit.m1.jsonl": [row("z", 0, "n")]}, ["z"], ValueError), ({"audit.m9.jsonl": [row("a", 0, "n")]}, ["a"], FileNotFoundError),
    ({"else.jsonl": [row("a", 0, "n")]}, ["a"], FileNotFoundError), ({"audit.m1.jsonl": [row("a", 0, "n")]}, [], ValueError)])
def test_folders_that_do_not_fit(spark, tmp_path, delta, changed, error):
    base_dir, delta_dir = folder(tmp_path / "base", BASE), folder(tmp_path / "delta", delta)
    with pytest.raises(error):
        merge.merge_directories(spark, base_dir, delta_dir, str(tmp_path / "out"), spark.createDataFrame([(c,) for c in changed], "sample_id string"))
    assert not (tmp_path / "out").exists()
