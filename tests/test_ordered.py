import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan import ordered
from lexspan.functions import diversity, stats
from lexspan.operators import pooled, selection, summary


def force_ranks(values):
    order = sorted(v for v in values if v is not None)
    return {v: sum(i + 1 for i, w in enumerate(order) if w == v) / order.count(v) for v in order}


def test_running_sums_and_maxima_over_groups_and_nulls(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v long")
    base = ordered.sorted_rows(df, ["g"], ["i"])
    out = ordered.running(ordered.running(base, ["g"], F.col("v"), "upto"), ["g"], F.col("v"), "top", "max", inclusive=False)
    got = {x.i: (x.upto, x.top) for x in ordered.plain(out).collect()}
    expected, sums, tops = {}, Counter(), {}
    for g, i, v in rows:
        sums[g] += v
        expected[i] = (sums[g], tops.get(g))
        tops[g] = max(tops.get(g, 0), v)
    assert got == expected


def test_average_ranks_by_force(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", None]), r.choice([None, -0.5, 1.0, 2.0, 7.0, float(r.randint(0, 50))])) for _ in range(400)]
    got = ordered.with_average_rank(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "r").collect()
    assert len(got) == len(rows)
    for g in ("a", None):
        ranks = force_ranks([x for h, x in rows if h == g])
        assert all(x.r == (ranks[x.x] if x.x is not None else None) for x in got if x.g == g)


def test_no_sort_meets_all_rows(spark):
    # One value holds a third of all rows, one group two thirds: what is sorted are distinct values.
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(3)).alias("x"), (F.col("id") % 3 == 1).alias("g"))
    plan = ordered.with_average_rank(df, ["g"], "x", "r")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("share", [0.0, 0.025, 0.5, 0.975, 1.0])
def test_quantiles_by_force(spark, share):
    r = random.Random(3)
    rows = [("few", float(i)) for i in range(4)] + [("one", 5.0), ("null", None)] + [("ties", float(r.randint(0, 3))) for _ in range(999)] + [("many", r.gauss(0, 1)) for _ in range(30_000)] + [("steps", float(r.randint(0, 9) ** 9)) for _ in range(20_000)]
    got = {x.g: (x.n, x.quantile) for x in ordered.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], ["x"], [share]).collect()}
    assert set(got) == {"few", "one", "ties", "many", "steps"}
    for g, (n, q) in got.items():
        own = [x for h, x in rows if h == g]
        assert n == len(own) and q == pytest.approx(float(np.quantile(own, share)), abs=1e-12)


def test_medians_of_several_columns(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 8.0), ("b", 3.0, 1.0)], "g string, x double, y double")
    assert {r.g: (r.median_x, r.median_y) for r in ordered.medians(df, ["g"], ["x", "y"]).collect()} == {"a": (1.5, 8.0), "b": (3.0, 1.0)}


def test_holm_in_groups_by_force(spark):
    r = random.Random(4)
    rows = [(g, i, round(r.random() / 9, 3)) for g in ("a", "b") for i in range(60)]
    got = {(x.g, x.i): x.a for x in stats.holm(spark.createDataFrame(rows, "g string, i int, p double"), "p", ["g"], ["i"], "a").collect()}
    for g in ("a", "b"):
        own, top = sorted((p, i) for h, i, p in rows if h == g), 0.0
        for k, (p, i) in enumerate(own):
            top = max(top, p * (len(own) - k))
            assert got[g, i] == pytest.approx(min(1.0, top))


def test_offsets_of_files(spark):
    files = spark.createDataFrame([(f"p{i:03d}", "x" * (i * 7 % 11)) for i in range(100)], "path string, text string")
    got = selection.running_offsets(files, "path", F.length("text")).orderBy("path").collect()
    at = 0
    for r in got:
        assert r.offset == at
        at += r.size + 1


def texts_of(kind, r):
    if kind == "natural":
        return [[f"w{min(int(r.paretovariate(0.6)), 300)}" for _ in range(r.randint(0, 90))] for _ in range(25)]
    if kind == "same":
        return [["same"] * r.randint(0, 40) for _ in range(12)]
    if kind == "distinct":  # one factor over the whole sequence, longer than any first piece
        return [[f"x{i}_{j}" for j in range(30)] for i in range(20)]
    return [["a", "b"], [], ["a"]] if kind == "short" else [[], []]


@pytest.mark.parametrize("piece", [5, 64, 10_000])
def test_pooled_mtld_equals_that_of_one_sequence(spark, piece):
    r = random.Random(piece)
    groups = {k: texts_of(k, r) for k in ("natural", "same", "distinct", "short", "empty")}
    rows = [(None if k == "same" else k, i, t) for k, texts in groups.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g string, i int, t array<string>").repartition(7)
    got = {x.g: (x.tokens, x.pooled_ttr, x.pooled_mtld) for x in pooled.pooled_diversity(df, ["g"], ["i"], "t", piece=piece).collect()}
    for k, texts in groups.items():
        flat = [w for t in texts for w in t]
        n, ttr, mtld = got[None if k == "same" else k]
        assert n == len(flat) and ttr == pytest.approx(len(set(flat)) / max(len(flat), 1)) and mtld == pytest.approx(diversity.mtld_of(flat), rel=1e-12)


def test_factor_ends_by_force():
    r = random.Random(6)
    for _ in range(60):
        ids = np.array([r.randint(0, 9) for _ in range(r.randint(1, 40))])
        own, whole = r.randint(1, len(ids)), r.random() < 0.5
        following, part = pooled.factor_ends(ids, own, whole, 0.72)
        for s in range(own):
            ends = [e for e in range(s, len(ids)) if len(set(ids[s : e + 1].tolist())) / (e - s + 1) <= 0.72]
            rest = (1 - len(set(ids[s:].tolist())) / (len(ids) - s)) / (1 - 0.72)
            assert (following[s], part[s]) == ((ends[0] + 1, 1.0) if ends else (len(ids), pytest.approx(rest)) if whole else (pooled.OPEN, 1.0))


def test_outliers_take_the_first_of_equal_rows(spark):
    rows = [("m", 2, "top_k", 1.0, True, 0.5, 3.0, "b"), ("m", 1, "top_k", 2.0, True, 0.5, 2.0, "a"), ("m", 0, "top_k", 2.0, False, 0.9, 9.0, "c")]
    df = spark.createDataFrame(rows, "model string, sample_id int, decoder string, parameter double, reached boolean, ttr double, mtld double, text string")
    got = {x.metric: (x.maximum, x.sample_id, x.text_preview) for x in summary.outliers(df, ["model"]).collect()}
    assert got == {"ttr": (0.5, 1, "a"), "mtld": (3.0, 2, "b")}


def drawn_by_force(values, draws, seed):
    out = []
    for d in range(1, draws + 1):
        taken = [values[stats.hash32(f"{seed}|{d}|{place}") % len(values)] for place in range(1, len(values) + 1)]
        out.append(sum(t for t, _ in taken) / sum(n for _, n in taken))
    return np.quantile(out, [0.025, 0.975])


@pytest.mark.parametrize("most", [1_000, 10])
def test_redrawn_clusters_by_force(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "CLUSTERS", most)  # with 10, one group goes by joins
    r = random.Random(7)
    groups = {"a": [(r.random(), 1.0 + r.random()) for _ in range(40)], None: [(r.random(), 2.0) for _ in range(7)]}
    rows = [(g, k, *v) for g, own in groups.items() for k, v in enumerate(own)]
    df = spark.createDataFrame(rows, "g string, k int, t double, n double")
    got = {x.g: (x.low, x.high) for x in stats.cluster_bootstrap(df, ["g"], "k", ["t", "n"], F.col("t") / F.col("n"), 120, 5).collect()}
    assert set(got) == {"a", None}
    for g, own in groups.items():
        assert got[g] == pytest.approx(tuple(drawn_by_force(own, 120, 5)))
    same = df.select(stats.uniform_hash(5, F.col("k"), 3).alias("h"), "k").distinct().collect()
    assert all(x.h == stats.hash32(f"5|{x.k}|3") for x in same)


def test_many_clusters_are_not_rows_of_draws(spark):
    n, draws = 100_000, 6
    sums = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("t"), F.lit(1.0).alias("n"))
    got = stats.cluster_bootstrap(sums, ["g"], "k", ["t", "n"], F.col("t") / F.col("n"), draws, 1).first()
    assert 2.9 < got.low <= got.high < 3.1
