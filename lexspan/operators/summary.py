"""Summaries of generations and of how coverage and diversity go together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan import ordered, stored
from lexspan.functions import diversity, stats
from lexspan.operators import coverage, pooled

METRICS = ["ttr", "mtld"]


def generation_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, contexts, completion_rate, and mean, median, sd and 95 % interval of each metric over completed rows."""
    done = F.col("reached")
    aggs = [F.count("*").alias("contexts"), F.count_if(done).alias("completed")]
    for m in METRICS:
        v = F.when(done, F.col(m))
        aggs += [F.avg(v).alias(f"mean_{m}"), F.stddev_pop(v).alias(f"sd_{m}")]
    rows = stored.written(rows.select(*by, "reached", *METRICS))  # for sums, and twice for medians
    middle = ordered.medians(rows.where("reached"), by, METRICS)
    out = ordered.joined(rows.groupBy(*by).agg(*aggs), middle, by, "left").withColumn("completion_rate", F.col("completed") / F.col("contexts"))
    for m in METRICS:
        for c in ("mean", "median", "sd"):
            out = out.withColumn(f"{c}_{m}", F.coalesce(f"{c}_{m}", F.lit(0.0)))
        for end, sign in (("low", -1), ("high", 1)):
            out = out.withColumn(f"{m}_{end}", stats.interval(F.col(f"mean_{m}"), F.col(f"sd_{m}"), F.col("completed"), sign))
    return out


def completion_summary(summary: DataFrame, by: list[str]) -> DataFrame:
    """by, configurations, mean, lowest and highest completion rate, and which configuration is lowest."""
    first = F.min_by(F.struct("decoder", "parameter"), F.struct("completion_rate", "decoder", "parameter"))
    return summary.groupBy(*by).agg(
        F.count("*").alias("configurations"), F.avg("completion_rate").alias("mean_rate"), F.min("completion_rate").alias("min_rate"), F.max("completion_rate").alias("max_rate"), first.alias("f")).select(
        *by, "configurations", "mean_rate", "min_rate", "max_rate", F.col("f.decoder").alias("lowest_decoder"), F.col("f.parameter").alias("lowest_parameter"))


def outliers(rows: DataFrame, by: list[str], preview: int = 300) -> DataFrame:
    """by, metric, maximum and its row among completed rows; ties go to the smallest sample, decoder and parameter.

    Of each group one struct is kept; texts are fetched by key for these few rows only.
    """
    own = ["sample_id", "decoder", "parameter"]
    long = rows.where("reached").select(*by, *own, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m"))
    best = F.min_by(F.struct(F.col("m.value").alias("maximum"), *own), F.struct(-F.col("m.value"), *own)).alias("best")
    found = long.groupBy(*by, F.col("m.metric").alias("metric")).agg(best).select(*by, "metric", "best.*")
    found = stored.small(found)
    wanted = ordered.joined(rows.where("reached").select(*by, *own, "text"), found.select(*by, *own), [*by, *own], "left_semi")
    texts = wanted.groupBy(*by, *own).agg(F.min(F.left("text", F.lit(preview))).alias("text_preview"))
    return ordered.joined(found, texts, [*by, *own], "left")


def with_coverage(rows: DataFrame, covered: DataFrame, keys: list[str], strict: bool = False, extra: list[str] | None = None) -> DataFrame:
    """rows ⋈ covered (and its extra columns) without untruncated rows; missing ones are dropped, or fail the query if strict."""
    rows = rows.where("decoder <> 'untruncated'")
    both = rows.join(covered.select(*keys, *(extra or []), "coverage"), keys, "left" if strict else "inner")
    if strict:
        both = both.withColumn("coverage", F.coalesce("coverage", F.raise_error(F.lit("a configuration has no coverage")).cast("double")))
    return both


def filter_correlations(joined: DataFrame, by: list[str], metrics: list[str], least: int = 3) -> DataFrame:
    """Correlations of coverage with metrics: of all filters together, and of each decoder."""
    both = joined.withColumn("filters", F.explode(F.array(F.lit("all_filters"), F.col("decoder"))))
    return stats.correlations(both, [*by, "filters"], "coverage", metrics).where(F.col("n") >= least)


def paired_effects(rows: DataFrame, by: list[str], endpoints: list[tuple[str, float, float]]) -> DataFrame:
    """by, decoder, metric: mean and median of permissive less restrictive, and the signed-rank test."""
    spark = rows.sparkSession
    rows = stored.written(rows.select(*by, "sample_id", "decoder", "parameter", "reached", *METRICS))  # both ends read it
    table = F.broadcast(spark.createDataFrame(endpoints, "decoder string, lo double, hi double"))
    ends = rows.join(table, "decoder").where("parameter in (lo, hi)").where("reached")
    pick = lambda end: ends.where(F.col("parameter") == F.col(end)).select(*by, "sample_id", "decoder", *[F.col(m).alias(f"{end}_{m}") for m in METRICS])
    pairs = pick("lo").join(pick("hi"), [*by, "sample_id", "decoder"])
    long = pairs.select(*by, "decoder", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"hi_{m}") - F.col(f"lo_{m}")).alias("d")) for m in METRICS])).alias("m")).select(*by, "decoder", "m.metric", "m.d")
    keys = [*by, "decoder", "metric"]
    long = stored.written(long)
    means = ordered.joined(long.groupBy(*keys).agg(F.avg("d").alias("mean_difference")), ordered.medians(long, keys, ["d"]), keys)
    return ordered.joined(means.withColumnRenamed("median_d", "median_difference"), stats.wilcoxon(long, keys, "d"), keys)


def panel_ranks(joined: DataFrame, panel: list[str], metric: str) -> DataFrame:
    """panel, x, y: ranks of coverage and a metric within a panel, less the panel's mean."""
    joined = stored.written(joined.select(*panel, "coverage", metric))
    ranked = ordered.with_average_rank(ordered.with_average_rank(joined, panel, "coverage", "rx"), panel, metric, "ry")
    means = joined.groupBy(*panel).agg(((F.count("*") + 1) / 2.0).alias("mean"))  # of ranks 1 to n
    ranked = ordered.joined(ranked, means, panel)
    return ranked.select(*panel, (F.col("rx") - F.col("mean")).alias("x"), (F.col("ry") - F.col("mean")).alias("y"))


def pooled_spearman(centred: DataFrame, cluster: str, draws: int = 0, seed: int = 10298) -> DataFrame:
    """rho over all panels, with an interval by redrawing clusters; ranks don't change when clusters are redrawn."""
    sums = centred.groupBy(cluster).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    rho = F.try_divide(F.sum("xy"), F.sqrt(F.sum("xx") * F.sum("yy")))
    out = sums.agg(rho.alias("rho"), F.count("*").alias("clusters")).withColumn("g", F.lit(1))
    if not draws:
        return out.drop("g")
    ci = stats.cluster_bootstrap(sums.withColumn("g", F.lit(1)), ["g"], cluster, ["xy", "xx", "yy"], F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), draws, seed)
    return out.join(F.broadcast(ci), "g").drop("g")


def coverage_gap(covered: DataFrame, group: str, left: str, right: str, keys: list[str]) -> DataFrame:
    """keys, best coverage of either group, and right less left."""
    best = covered.groupBy(group, *keys).agg(F.max("coverage").alias("c"))
    a = best.where(F.col(group) == left).select(*keys, F.col("c").alias("left_coverage"))
    b = best.where(F.col(group) == right).select(*keys, F.col("c").alias("right_coverage"))
    return a.join(b, keys).withColumn("gap", F.col("right_coverage") - F.col("left_coverage"))


def open_generation_summary(rows: DataFrame, by: list[str], order: list[str], tokens: str) -> DataFrame:
    """by, samples, tokens, and diversity: means over samples, and pooled over the tokens of all samples in order."""
    t = F.col(tokens)
    each = rows.select(*by, diversity.type_token_ratio(t).alias("_r"), diversity.mtld(t).alias("_m"))
    means = each.groupBy(*by).agg(F.count("*").alias("samples"), F.avg("_r").alias("mean_ttr"), F.avg("_m").alias("mean_mtld"))
    return ordered.joined(means, pooled.pooled_diversity(rows, by, order, tokens), by)


def coverage_by_tokens(paths: DataFrame, grid: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """Coverage with an interval by redrawing words, of all contexts (n_tokens 0) and of those of each number of tokens."""
    checked = coverage.on_grid(paths, grid).withColumn("n_tokens", F.explode(F.array(F.lit(0).cast("long"), F.col("n_tokens").cast("long"))))
    keys = [*by, "decoder", "parameter", "n_tokens"]
    sums = checked.groupBy(*keys, "word").agg(F.count_if("survives").cast("double").alias("covered"), F.count("*").cast("double").alias("total"))
    share = F.col("covered") / F.col("total")
    ends = stats.cluster_bootstrap(sums, keys, "word", ["covered", "total"], share, draws, seed)
    whole = sums.groupBy(*keys).agg(F.sum("covered").alias("covered"), F.sum("total").alias("total")).withColumn("coverage", share)
    return whole.join(ends, keys)


def family(tests: DataFrame, by: list[str], p: str = "p", exclude: list[str] | None = None) -> DataFrame:
    """Tests of one family with adjusted p and whether that is below .05; models are excluded before p is adjusted."""
    rows = tests.where(~F.col("model").isin(exclude)) if exclude else tests
    return stats.holm(rows, p, [], by, "p_holm").withColumn("significant", F.col("p_holm") < 0.05)


def significance_counts(adjusted: DataFrame, by: list[str]) -> DataFrame:
    """by, tests, significant."""
    return adjusted.groupBy(*by).agg(F.count("*").alias("tests"), F.count_if("significant").alias("significant"))
