import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from lexspan.operators import adapters
from lexspan.sources import readers, sinks
from lexspan.streaming import candidates


def test_frequency_list(spark, tmp_path):
    f = tmp_path / "f.tsv"
    f.write_text("# list\n1\tthe\t23135851162\n\n2\tof\t13151942776\nplain\nword2go,7\n" .replace("word2go", "eloquence"))
    got = [(r["rank"], r.word, r["count"]) for r in readers.read_frequency(spark, str(f)).collect()]
    assert got == [(1, "the", 23135851162), (2, "of", 13151942776), (3, "plain", None), (4, "eloquence", 7)]
    f.write_text("rank\tword\tcount\n1\tthe\t5\n")
    with pytest.raises(Exception, match="could not parse"):
        readers.read_frequency(spark, str(f)).collect()


def test_dictionary_and_corpus(spark, tmp_path):
    (tmp_path / "d.lst").write_text("Elaborate\n'quoted'\n42\n\n")
    assert sorted(r.word for r in readers.read_dictionary(spark, str(tmp_path / "d.lst")).collect()) == ["elaborate", "quoted"]
    (tmp_path / "c" / "deep").mkdir(parents=True)
    (tmp_path / "c" / "a.txt").write_text("one")
    (tmp_path / "c" / "deep" / "b.text").write_text("two")
    (tmp_path / "c" / "x.md").write_text("no")
    assert sorted(r.text for r in readers.read_corpus(spark, str(tmp_path / "c")).collect()) == ["one", "two"]


def test_payloads_and_archives(spark, tmp_path):
    d = tmp_path / "in"
    (d / "g").mkdir(parents=True)
    (d / "a.json").write_text(json.dumps({"url": "no", "x": ["b", {"y": "c"}]}))
    (d / "g" / "t.csv").write_text("title,lyrics\nA,la la\n")
    (d / "p.txt").write_text("plain")
    got = {r.group: r.text for r in readers.read_payloads(spark, str(d)).collect()}
    assert got == {"a": "b\nc", "g": "la la", "p": "plain"}
    with tarfile.open(tmp_path / "w.tar.gz", "w:gz") as tar:
        data = b"1\tThe\t5\n2\tthe\t3\n3\t!!\t9\nbad\n"
        info = tarfile.TarInfo("x/x_words.txt")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert [tuple(r) for r in readers.read_word_archive(spark, str(tmp_path / "w.tar.gz")).collect()] == [("the", 8)]


def test_books_and_audits(spark, tmp_path):
    spark.createDataFrame([("b1", "es", "hola mundo"), ("b2", "en", "hello"), ("b3", None, "sin idioma"), ("b4", "es", " ")], "identifier string, lang string, content string").write.parquet(str(tmp_path / "b"))
    assert sorted(r.book_id for r in readers.read_books(spark, str(tmp_path / "b")).collect()) == ["b1", "b3"]
    (tmp_path / "audit.m.jsonl").write_text(json.dumps({"sample_id": "s", "model": "m", "rank": 3}) + "\n")
    r = readers.read_audits(spark, str(tmp_path)).first()
    assert (r["rank"], r.temperature) == (3, 1.0)
    with pytest.raises(FileNotFoundError):
        readers.read_generations(spark, str(tmp_path / "none")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, count long")
    sinks.write_frequency(df, str(tmp_path / "f"))
    rows = [x.split("\t") for p in sorted((tmp_path / "f").glob("part*")) for x in p.read_text().splitlines()]
    assert rows == [["1", "c", "9"], ["2", "a", "2"], ["3", "b", "2"]]
    sinks.write_by_temperature(df.withColumn("temperature", F.lit(1.5)), str(tmp_path / "t"))
    assert (tmp_path / "t" / "temperature_slug=t1p5").exists()
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert sinks.cached_index(spark, str(tmp_path / "i"), {"n": "1"}, build).count() == 3
    sinks.cached_index(spark, str(tmp_path / "i"), {"n": "2"}, build)
    assert len(calls) == 2


def test_deciders(spark):
    assert [adapters.aligned([True, False, True], n) for n in (3, 2, 4)] == [[True, False, True], [True, False], [True, False, True, False]]
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    known = spark.createDataFrame([(1, True), (2, False)], "id int, accepted boolean")
    assert {r.id: r.accepted for r in adapters.table_decider(known, ["id"])(df).collect()} == {1: True, 2: False, 3: False}
    got = adapters.batch_decider(lambda rows: [r["id"] != 2 for r in rows])(df)
    assert {r.id: r.accepted for r in got.collect()} == {1: True, 2: False, 3: True}


def test_quota_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    part = lambda rows: spark.createDataFrame(rows, candidates.OUT).coalesce(1).write.mode("append").parquet(folder)
    part([("w", 1, 5, "a"), ("w", 1, 5, "a"), ("w", 2, 1, "b"), ("v", 1, 0, "c")])
    run = lambda: candidates.collect_available(spark, spark.readStream.schema(candidates.OUT).parquet(folder), 3, str(tmp_path / "out"), str(tmp_path / "check"))
    run()
    part([("w", 3, 1, "d"), ("w", 4, 1, "e")])
    run()
    got = sorted((r.word, r.doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("v", 1), ("w", 1), ("w", 2), ("w", 3)]


def test_quota_stream_counts_a_place_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i, rows in enumerate([[("a", 1, 5, "p"), ("a", 2, 5, "p")], [("a", 1, 5, "p"), ("a", 3, 1, "p"), ("a", 4, 1, "p")]]):
        spark.createDataFrame(rows, candidates.OUT).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(candidates.OUT).parquet(folder)
        candidates.collect_available(spark, stream, 3, str(tmp_path / "out"), str(tmp_path / "check"))
        got = sorted((r.doc_id, r.start) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [[(1, 5), (2, 5)], [(1, 5), (2, 5), (3, 1)]][i]


def test_a_judge_is_asked_again():
    calls = []

    def ask(part):
        calls.append(len(part))
        if len(calls) < 3:
            raise ConnectionError("later")
        return [True] * len(part)

    assert adapters.asked(ask, [{}, {}], 5, 0.0) == [(True, None)] * 2 and calls == [2, 2, 2]
    assert adapters.asked(ask, [{}], 1, 0.0) == [(True, None)]
    calls.clear()
    assert adapters.asked(ask, [{}], 2, 0.0) == [(False, "error: ConnectionError")]


def test_web_shards_and_curve(spark, tmp_path):
    for n in (10, 2):
        rows = [(f"text {n} {i}", f"{n}-{i}", "u", "d", 0.9, 3) for i in range(3)] + [(None, f"{n}-x", "u", "d", 0.1, 0)]
        spark.createDataFrame(rows, readers.WEB).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        (file,) = (tmp_path / f"part{n}").glob("*.parquet")
        (tmp_path / "web").mkdir(exist_ok=True)
        file.rename(tmp_path / "web" / f"shard-{n}.parquet")
    got = readers.read_web(spark, str(tmp_path / "web")).collect()
    assert sorted((r.shard, r.id) for r in got) == [(n, f"{n}-{i}") for n in (2, 10) for i in range(3)]
    some = [sorted(r.id for r in readers.read_web(spark, str(tmp_path / "web"), 4).collect()) for _ in range(2)]
    assert len(some[0]) == 4 and some[0] == some[1]
    assert [p.rpartition("/")[2] for p in readers.shards_in_order(spark, str(tmp_path / "web"))] == ["shard-2.parquet", "shard-10.parquet"]
    (tmp_path / "curve.tsv").write_text("1\tthe\t900\n2\tof\t500\n3\tand\t40\n")
    assert sorted(map(tuple, readers.read_curve(spark, str(tmp_path / "curve.tsv"), 2).collect())) == [(1, 900), (2, 500)]
