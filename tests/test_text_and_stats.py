import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lexspan import ordered
from lexspan.functions import diversity, stats
from lexspan.functions import text as T
from lexspan.operators import corpus, repair


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    tokens = one(spark, T.lexical_tokens, "Word word can't well-known 123")
    assert tokens == ["word", "word", "can't", "well-known"]
    assert one(spark, diversity.type_token_ratio, tokens, "array<string>") == 0.75
    assert one(spark, T.normalize_word, " ’Hello’- ") == "hello" and one(spark, T.normalize_word, "a b") == ""
    assert one(spark, T.strip_boilerplate, "x *** START OF THE PROJECT GUTENBERG EBOOK A ***in*** END OF PROJECT GUTENBERG EBOOK A ***y") == "in"
    assert one(spark, T.slug, "  A b/c! ") == "a_b_c" and one(spark, T.format_p, 0.0123, "double") == ".012"
    assert one(spark, T.html_text, "<html><script>x</script><h1>A &amp;  b</h1><p>c<b>d</b></p></html>") == "A & b\ncd"


def test_mtld(spark):
    many, same = [f"word{i}" for i in range(100)], ["same"] * 100
    assert diversity.mtld_of(many) > diversity.mtld_of(same)
    assert diversity.mtld_of([]) == 0
    assert one(spark, diversity.mtld, same, "array<string>") == diversity.mtld_of(same)
    with pytest.raises(ValueError):
        diversity.mtld(F.col("x"), 1.0)


def contexts(spark, text, words, n):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return corpus.occurrences(docs, spark.createDataFrame([(w,) for w in words], "word string"), n).collect()


def test_contexts(spark):
    (hit,) = contexts(spark, 'Alpha, beta; "gamma" delta epsilon target arrives.', ["target"], 5)
    assert hit.prefix == 'Alpha, beta; "gamma" delta epsilon'
    found = {r.word: r.matched for r in contexts(spark, "uno dos tres cuatro cinco Después llega doña Jacinta.", ["después", "doña"], 5)}
    assert found == {"después": "Después", "doña": "doña"}


def test_ranked_without_one_task(spark):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("ab", 3), ("z", 1)], "word string, count long")
    got = {r.word: r["rank"] for r in corpus.ranked(counts).collect()}
    assert got == {"c": 1, "a": 2, "ab": 3, "b": 4, "z": 5}


def test_average_ranks_and_correlations(spark):
    df = spark.createDataFrame([("g", float(x), float(-x)) for x in (10, 20, 20, 40)], "g string, x double, y double")
    assert sorted(r.r for r in ordered.with_average_rank(df, ["g"], "x", "r").collect()) == [1, 2.5, 2.5, 4]
    r = stats.correlations(df, ["g"], "x", ["y"]).first()
    assert r.spearman == pytest.approx(-1) and r.pearson == pytest.approx(-1)
    flat = spark.createDataFrame([("g", 1.0, 1.0), ("g", 1.0, 2.0)], "g string, x double, y double")
    assert stats.correlations(flat, ["g"], "x", ["y"]).first().pearson is None


@pytest.mark.parametrize(("raw", "adjusted"), [([0.01, 0.04, 0.03, 0.20], [0.04, 0.09, 0.09, 0.20]), ([0.9, 0.01], [0.9, 0.02])])
def test_holm(spark, raw, adjusted):
    df = spark.createDataFrame(list(enumerate(raw)), "i int, p double")
    got = [r.a for r in stats.holm(df, "p", [], ["i"], "a").orderBy("i").collect()]
    assert got == pytest.approx(adjusted)


def test_wilcoxon_exact_and_approximate(spark):
    d = [1.0, -2.0, 3.0, 4.0, -5.5, 6.0]
    ranks = range(1, 7)
    least = min(1 + 3 + 4 + 6, 2 + 5)
    exact = sum(sum(r for r, s in zip(ranks, signs, strict=True) if s) <= least for signs in itertools.product((0, 1), repeat=6)) * 2 / 64
    rows = [("e", x) for x in d] + [("z", 0.0)] * 3 + [("t", x) for x in (1.0, 1.0, -1.0, 2.0, 3.0)]
    got = {r.g: (r.statistic, r.p) for r in stats.wilcoxon(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").collect()}
    assert got["e"] == (least, pytest.approx(exact)) and got["z"] == (0.0, 1.0)
    n, w, ties = 5, 2.0, 3**3 - 3
    z = abs(w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert got["t"] == (w, pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-9))


def test_erfc(spark):
    xs = [0.0, 0.3, 1.0, 2.4, 2.6, 5.0]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("y")).orderBy("x").collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], abs=1e-9)


def test_permutation_and_bootstrap(spark):
    random.seed(1)
    df = spark.createDataFrame([("g", i, float(i), i + random.random()) for i in range(12)], "g string, i int, x double, y double")
    p = stats.permutation_p(df, ["g"], "i", "x", "y", 200).first().p
    assert 0 < p <= 0.02
    sums = spark.createDataFrame([("g", k, float(k), 1.0) for k in range(10)], "g string, k int, t double, n double")
    r = stats.cluster_bootstrap(sums, ["g"], "k", ["t", "n"], F.col("t") / F.col("n"), 200, 1).first()
    assert 1 < r.low < 4.5 < r.high < 8


def test_changes_and_merge(spark):
    a = spark.createDataFrame([(1, "x", "m"), (2, "y", "m")], "id int, t string, meta string")
    b = spark.createDataFrame([(1, "x", "other"), (2, "z", "m")], "id int, t string, meta string")
    assert [r.id for r in repair.changed(a, b, "id", ["t"]).collect()] == [2]
    with pytest.raises(Exception, match="ids differ"):
        repair.changed(a, b.where("id = 1"), "id", ["t"]).collect()
    base = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "id int, k int")
    delta = spark.createDataFrame([(2, 9)], "id int, k int")
    ids = spark.createDataFrame([(2,)], "id int")
    assert sorted(map(tuple, repair.merged(base, delta, ids, "id").collect())) == [(1, 0), (2, 9)]
    with pytest.raises(Exception, match="cannot merge"):
        repair.merged(base, delta.where("id = 3"), ids, "id").collect()


def test_replacements_and_shortages(spark):
    rejected = spark.createDataFrame([("s2", "cat"), ("s3", "dog")], "sample_id string, word string")
    candidates = spark.createDataFrame([("cat", 1), ("cat", 3), ("dog", 1)], "word string, at int")
    used = spark.createDataFrame([(1,)], "at int")
    got = repair.replacements(rejected, candidates, used, ["at"], [F.col("at")])
    assert [(r.sample_id, r.at) for r in got.collect()] == [("s2", 3)]
    assert [tuple(r) for r in repair.shortages(rejected, got).collect()] == [("dog", 1, 0)]
    samples = spark.createDataFrame([("s2", "cat", 1), ("s9", "cow", 5)], "sample_id string, word string, at int")
    fixed = {r.sample_id: (r.at, r.metadata) for r in repair.apply_replacements(samples, got, ["at"]).collect()}
    assert fixed == {"s2": (3, {"quality_repaired": "1"}), "s9": (5, {})}
