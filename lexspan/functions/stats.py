"""Statistics over DataFrames: ranks, correlations, corrections, tests, resampling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan import ordered, stored


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation; null where a side doesn't vary (corr() would raise)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, by: list[str], x: str, ys: list[str]) -> DataFrame:
    """by, metric, n, pearson, spearman of x with each of several columns, over rows that have both.

    Spearman is Pearson over average ranks, which come from the distinct values of each side.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("y")) for c in ys])).alias("m")
    long = df.select(*by, F.col(x).cast("double").alias("x"), each).select(*by, "x", "m.metric", "m.y").where("x is not null and y is not null")
    keys = [*by, "metric"]
    long = stored.written(long)  # read for the ranks of either side, and for the sums
    ranked = ordered.joined(long, ordered.distinct_ranks(long, keys, "x").select(*keys, "x", F.col("rank").alias("rx")), [*keys, "x"])
    ranked = ordered.joined(ranked, ordered.distinct_ranks(long, keys, "y").select(*keys, "y", F.col("rank").alias("ry")), [*keys, "y"])
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"))


def holm(df: DataFrame, p: str, family: list[str], order: list[str], name: str) -> DataFrame:
    """Holm's adjusted p-values over a family of tests of any size: a running maximum of p times the tests that are left."""
    sizes = df.groupBy(*family).agg(F.count("*").alias("_m"))
    rows = ordered.running(ordered.sorted_rows(df, family, [p, *order]), family, F.lit(1).cast("long"), "_i", inclusive=False)
    rows = ordered.joined(rows, sizes, family) if family else rows.crossJoin(F.broadcast(sizes))  # one row
    rows = rows.withColumn("_s", (F.col("_m") - F.col("_i")) * F.col(p))
    stepped = ordered.running(rows, family, F.col("_s"), "_top", "max")
    return ordered.plain(stepped.withColumn(name, F.least(F.lit(1.0), F.col("_top"))).drop("_s", "_i", "_m", "_top"))


def interval(mean: Column, sd: Column, n: Column, sign: int) -> Column:
    """An end of the normal 95 % interval of a mean; the mean itself for fewer than two values."""
    return F.when(n < 2, mean).otherwise(mean + sign * 1.96 * sd / F.sqrt(n))


def wilcoxon(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """by, n, statistic, p: signed-rank test; zeros are dropped, ties share ranks.

    The exact distribution serves where there are at most 50 differences, none zero and none tied;
    else the normal approximation with tie correction and without continuity correction.
    """
    d = df.select(*by, F.col(difference).alias("d"))
    zeros = d.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if(F.col("d") == 0).alias("zeros"))
    # Ranks are of distinct sizes, so sums of them need no rows.
    sizes = d.where("d <> 0").groupBy(*by, F.abs("d").alias("a")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    upto = ordered.running(ordered.sorted_rows(sizes, by, ["a"]), by, F.col("t"), "upto")
    ranked = ordered.plain(upto).withColumn("r", F.col("upto") - (F.col("t") - 1) / 2.0)
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("t").alias("n"), F.sum(F.col("r") * F.col("up")).alias("plus"), F.sum(F.col("r") * (F.col("t") - F.col("up"))).alias("minus"), F.sum(t * (t * t - 1)).alias("ties"))
    n = F.col("n")
    out = ordered.joined(zeros, sums, by, "left").withColumn("statistic", F.coalesce(F.least("plus", "minus"), F.lit(0.0)))
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    z = F.abs(F.col("statistic") - n * (n + 1) / 4.0) / F.sqrt(variance)
    exact = (F.col("zeros") == 0) & (F.col("ties") == 0) & (n <= 50)
    p = F.when(n.isNull(), F.lit(1.0)).when(exact, _exact_p(n, F.col("statistic"))).otherwise(erfc(z / math.sqrt(2)))
    return out.select(*by, "pairs", "statistic", F.least(F.lit(1.0), p).alias("p"))


def _exact_p(n: Column, statistic: Column) -> Column:
    """Twice the share of sign patterns whose rank sum is at most the statistic, by adding a rank at a time."""
    top = (n * (n + 1) / 2).cast("int")
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), top))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda c, k: F.zip_with(c, F.concat(F.array_repeat(F.lit(0.0), k), F.slice(c, 1, top + 1 - k)), lambda a, b: a + b))
    below = F.aggregate(F.slice(counts, 1, F.floor(statistic).cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    return 2.0 * below / F.pow(F.lit(2.0), n)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, by a continued fraction or a series."""
    terms = range(1, 60)
    series = F.aggregate(
        F.array(*[F.lit(float(k)) for k in terms]), F.struct(x.alias("t"), x.alias("s")),
        lambda a, k: F.struct((a["t"] * -x * x / k).alias("t"), (a["s"] + a["t"] * -x * x / k / (2 * k + 1)).alias("s")), lambda a: a["s"])
    fraction = F.aggregate(F.array(*[F.lit(float(k)) for k in reversed(terms)]), x, lambda f, k: x + k / 2.0 / f)
    tail = F.exp(-x * x) / fraction / math.sqrt(math.pi)
    return F.when(x < 2.5, 1.0 - 2.0 / math.sqrt(math.pi) * series).otherwise(tail)


def uniform_hash(*parts: Column | int | str) -> Column:
    """A whole number below 2^32 from md5 of the parts, the same on every engine."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def permutation_p(df: DataFrame, by: list[str], order: str, x: str, y: str, permutations: int, seed: int = 13) -> DataFrame:
    """by, observed, p: two-sided permutation test of a Pearson correlation.

    A draw shuffles y by the order of a hash of (seed, draw, row), within each group. Groups are a few
    configurations, so draws, not rows, are what is spread over tasks.
    """
    w = Window.partitionBy(*by).orderBy(order)
    base = df.select(*by, F.row_number().over(w).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    arrays = base.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("v"), pearson("x", "y").alias("observed"))
    draws = arrays.where("observed is not null").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    keyed = F.array_sort(F.transform("v", lambda e: F.struct(uniform_hash(seed, F.col("draw"), e["i"]).alias("h"), e["i"].alias("i"), e["y"].alias("y"))))
    pair = F.zip_with("v", keyed, lambda a, b: a["x"] * b["y"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e)
    n = F.size("v")
    xs, ys = F.transform("v", lambda e: e["x"]), F.transform("v", lambda e: e["y"])
    covariance = total(pair) / n - total(xs) / n * (total(ys) / n)
    sd = lambda a: F.sqrt(total(F.transform(a, lambda e: e * e)) / n - F.pow(total(a) / n, F.lit(2)))
    drawn = draws.withColumn("r", covariance / (sd(xs) * sd(ys)))
    out = drawn.groupBy(*by).agg(F.count_if(F.abs("r") >= F.abs("observed") - 1e-12).alias("extreme"))
    return arrays.select(*by, "observed").join(out, by, "left").select(*by, "observed", ((F.col("extreme") + 1) / (permutations + 1.0)).alias("p"))


#: Clusters of a group whose values go to each task of its draws, 8 bytes each; larger groups are joined instead.
CLUSTERS = 1_000_000
#: Draws of a task.
DRAWS = 50


def cluster_bootstrap(sums: DataFrame, by: list[str], cluster: str, values: list[str], statistic: Column, draws: int, seed: int) -> DataFrame:
    """by, low, high: percentile interval of a statistic of summed values, with clusters redrawn.

    `sums` has one row for each cluster of a group. A draw takes as many clusters as there are, with
    replacement, by hashes of (seed, draw, place). Draws are dealt to tasks in blocks; a task has the values
    of a group's clusters as arrays and gives one row of sums for each draw, so that no row stands for a
    cluster of a draw.
    """
    sums = stored.written(sums.select(*by, F.col(cluster).alias("_cluster"), *[F.col(v).cast("double").alias(v) for v in values]))
    sizes = sums.groupBy(*by).agg(F.count("*").alias("_n"))
    large = stored.written(sizes.where(F.col("_n") > CLUSTERS))
    rows = ordered.joined(sums, large, by, "left_anti") if not large.isEmpty() else sums
    kinds = dict(sums.dtypes)
    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"`{v}` double" for v in values)])

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict[tuple[int, int], np.ndarray] = {}  # groups of one size take the same places in a draw
        for frame in frames:
            rows, found = frame.to_dict("records"), []
            for r in rows:
                table = np.array([r[f"_{v}"] for v in values], float)
                key = (r["_first"], table.shape[1])
                if key not in places:
                    places.clear()
                    last = min(key[0] + DRAWS, draws + 1)
                    places[key] = np.array([[hash32(f"{seed}|{d}|{place}") % key[1] for place in range(1, key[1] + 1)] for d in range(key[0], last)])
                found.append(np.array([table[:, taken].sum(axis=1) for taken in places[key]]))
            times = [len(x) for x in found]
            keys = {c: frame[c].repeat(times).reset_index(drop=True) for c in by}
            yield pd.DataFrame(keys | {v: np.concatenate([x[:, i] for x in found]) for i, v in enumerate(values)})

    column = lambda v: F.transform("_v", lambda x: x[v]).alias(f"_{v}")
    cells = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_cluster", *values))).alias("_v"))
    blocks = cells.select(*by, F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(DRAWS))).alias("_first"), *map(column, values))
    blocks = blocks.withColumn("_size", F.size(f"_{values[0]}")).repartition("_first").sortWithinPartitions("_first", "_size").drop("_size")
    drawn = blocks.mapInPandas(draw, fields)
    if not large.isEmpty():
        drawn = drawn.unionByName(_drawn_by_joins(ordered.joined(sums, large, by, "left_semi"), by, values, draws, seed))
    stats = drawn.select(*by, statistic.alias("s"))
    return stats.groupBy(*by).agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"))


def hash32(text: str) -> int:
    """What `uniform_hash` gives for the parts of a text."""
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big")


def _drawn_by_joins(sums: DataFrame, by: list[str], values: list[str], draws: int, seed: int) -> DataFrame:
    """by and sums of each draw, for clusters of any number: numbers of clusters are drawn as rows and joined."""
    numbered = ordered.plain(ordered.running(ordered.sorted_rows(sums, by, ["_cluster"]), by, F.lit(1).cast("long"), "_k", inclusive=False))
    sizes = sums.groupBy(*by).agg(F.count("*").alias("_n"))
    slots = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw")).select("*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_slot"))
    slots = slots.select(*by, "_draw", (uniform_hash(seed, F.col("_draw"), F.col("_slot")) % F.col("_n")).alias("_k"))
    slots = slots.groupBy(*by, "_draw", "_k").agg(F.count("*").alias("_times"))
    drawn = ordered.joined(slots, numbered, [*by, "_k"])
    return drawn.groupBy(*by, "_draw").agg(*[F.sum(F.col(v) * F.col("_times")).alias(v) for v in values]).drop("_draw")
