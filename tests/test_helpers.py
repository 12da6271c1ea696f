import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.operators import adapters, audit, coverage, selection, summary
from lexspan.plans import grids
from lexspan.sources import readers, sinks


def values(spark, column, *xs, kind="string"):
    return [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}").orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_text_helpers(spark):
    assert values(spark, T.canonical_path, r"C:\a\data\processed\b\c.txt", "x/y.txt", None) == ["data/processed/b/c.txt", "x/y.txt", None]
    assert values(spark, lambda x: T.excerpt(x, F.lit("word")), "before  \n", "") == ["before word", " word"]
    assert values(spark, T.model_short_name, "org/model-7b", "plain") == ["model-7b", "plain"]
    assert values(spark, T.model_variant, "a/Gemma-it", "b/Llama-Instruct", "c/Llama") == ["instruct", "instruct", "base"]
    assert values(spark, T.significant, 123.456789012, 1.23456789012e-7, kind="double") == [123.45679, 1.2345679e-7]
    df = spark.createDataFrame([(0.7,), (0.7 + 1e-12,), (0.71,)], "t double")
    assert df.where(audit.temperature_is("t", 0.7)).count() == 2


def test_names():
    assert grids.parse_names(" a, b c ,d") == ["a", "b c", "d"]
    with pytest.raises(ValueError):
        grids.parse_names(" , ")


def test_slack_keeps_what_rounding_lost(spark):
    paths = spark.createDataFrame([(1, 0.90000001, 0.0499999)], "worst_rank int, mass_above double, min_ratio double")
    points = grids.grid(spark, [("top_p", 0.9), ("min_p", 0.05), ("top_k", 1.0)])
    kept = lambda slack: {r.decoder for r in coverage.on_grid(paths, points, slack).where("survives").collect()}
    assert kept(0.0) == {"top_k"} and kept(1e-6) == {"top_k", "top_p", "min_p"}


def test_joins_with_coverage_and_words(spark):
    rows = spark.createDataFrame([("m", "top_k", 1.0), ("m", "untruncated", 0.0), ("n", "top_k", 1.0)], "model string, decoder string, parameter double")
    covered = spark.createDataFrame([("m", "top_k", 1.0, 0.5)], "model string, decoder string, parameter double, coverage double")
    keys = ["model", "decoder", "parameter"]
    assert [tuple(r) for r in summary.with_coverage(rows, covered, keys).collect()] == [("m", "top_k", 1.0, 0.5)]
    assert summary.with_coverage(rows.where("model = 'm'"), covered, keys, strict=True).count() == 1
    with pytest.raises(Exception, match="no coverage"):
        summary.with_coverage(rows, covered, keys, strict=True).collect()
    found = selection.with_samples(spark.createDataFrame([("a", 1), ("b", 2)], "word string, rank int"), spark.createDataFrame([("a", 9, 8)], "word string, rank int, more int"), "word")
    assert [r.asDict() for r in found.collect()] == [{"word": "a", "rank": 1, "more": 8}]


def test_generation_by_conditions(spark):
    samples, conditions = spark.createDataFrame([(1, "p")], "sample_id int, prefix string"), spark.createDataFrame([("top_k", 2.0), ("top_p", 0.5)], "decoder string, parameter double")
    load = lambda: lambda rows: [f"{r['prefix']} {r['decoder']} {r['parameter']}" for r in rows]
    assert sorted(r.text for r in adapters.generate(samples, conditions, load).collect()) == ["p top_k 2.0", "p top_p 0.5"]


def test_writers_and_their_readers(spark, tmp_path):
    at = lambda name: f"{tmp_path}/{name}"
    samples = spark.createDataFrame([("b", "w", 1), ("a", "v", 2)], "id string, word string, rank int")
    sinks.write_jsonl(samples, at("samples"))
    assert [(r.id, r.word) for r in readers.read_samples(spark, at("samples"), 1).collect()] == [("a", "v")] and readers.read_samples(spark, at("samples")).count() == 2
    sinks.write_summary(samples, at("summary"), ["word", "rank"], ["rank"])
    assert [tuple(r) for r in readers.read_summary(spark, at("summary"), "word string, rank int").collect()] == [("w", 1), ("v", 2)]
    books = spark.createDataFrame([("1", "es", "uno dos"), ("2", "en", "one")], "book_id string, language string, text string")
    assert tuple(sinks.write_books(books, at("books")).first()) == (2, 10)
    assert {r.language: r.text for r in spark.read.parquet(at("books/books")).collect()} == {"es": "uno dos", "en": "one"}
    sinks.write_per_word(spark.createDataFrame([("w", 2), ("w", 1), ("v", 3)], "word string, start int"), at("words"))
    assert {r.word: [c.start for c in r.contexts] for r in spark.read.json(at("words/words")).collect()} == {"w": [1, 2], "v": [3]}
    assert {r.word: r.contexts for r in spark.read.json(at("words/index")).collect()} == {"w": 2, "v": 1}


def test_books_of_epubs_and_lyrics(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='OPS/x.opf'/></rootfiles></container>")
        z.writestr("OPS/x.opf", "<package xmlns='http://www.idpf.org/2007/opf'><manifest><item id='1' href='1.html'/><item id='2' href='2.html'/></manifest><spine><itemref idref='2'/><itemref idref='1'/></spine></package>")
        z.writestr("OPS/1.html", "<p>second</p><script>no</script>")
        z.writestr("OPS/2.html", "<h1>First</h1><p>of &amp; all <b>words</b></p><nav><p>menu</p></nav>")
    assert [r.text for r in readers.read_epubs(spark, str(tmp_path)).collect()] == ["First\nof & all words\nsecond"]
    (tmp_path / "l.tsv").write_bytes("name\tlyrics\nx\tcanción\n".encode("latin1"))
    (tmp_path / "l.json").write_text(json.dumps([{"lyrics": "one", "url": "u"}, {"lyrics": "two"}]))
    (tmp_path / "l.jsonl").write_text('{"lyrics": "a"}\n{"text": "b"}\n{"other": 1}\n')
    got = {k: sorted(r.text for r in readers.read_lyrics(spark, f"{tmp_path}/l.{k}", k).collect()) for k in ("tsv", "json", "jsonl")}
    assert got == {"tsv": ["canción"], "json": ["one\ntwo"], "jsonl": ["a", "b"]}
