"""Which contexts and words survive decoder filters, over whole parameter grids.

Every filter asks the same of all tokens of a path, so a path is reduced first to its worst rank,
largest mass above, smallest ratio and number of tokens; grids meet paths, not tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.plans.grids import Recipe

SLACK = 1e-12


def extremes(audit: DataFrame, keys: list[str]) -> DataFrame:
    """keys, worst_rank, mass_above, min_ratio, n_tokens of each path."""
    count = F.coalesce(F.max("word_token_count").cast("long"), F.count("*")) if "word_token_count" in audit.columns else F.count("*")
    return audit.groupBy(*keys).agg(
        F.max("rank").alias("worst_rank"), F.max(F.col("cumulative_probability") - F.col("probability")).alias("mass_above"), F.min("probability_ratio_to_top").alias("min_ratio"), count.alias("n_tokens"))


def survives(decoder: Column, parameter: Column, slack: float = 0.0) -> Column:
    """Whether all tokens of a path pass: the token that crosses top-p's mass is kept; a decoder that isn't known fails the query."""
    return (
        F.when(decoder == "top_k", F.col("worst_rank") <= parameter)
        .when(decoder == "top_p", F.col("mass_above") <= parameter + slack)
        .when(decoder == "min_p", F.col("min_ratio") >= parameter - slack)
        .otherwise(F.raise_error(F.concat(F.lit("unknown decoder: "), decoder)).cast("boolean")))


def on_grid(paths: DataFrame, grid: DataFrame, slack: float = 0.0) -> DataFrame:
    """paths × grid with `survives`; the grid is a few dozen literal rows."""
    return paths.crossJoin(F.broadcast(grid)).withColumn("survives", survives(F.col("decoder"), F.col("parameter"), slack))


def context_coverage(paths: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """by, decoder, parameter, covered_contexts, total_contexts, coverage."""
    g = on_grid(paths, grid).groupBy(*by, "decoder", "parameter").agg(F.count_if("survives").alias("covered_contexts"), F.count("*").alias("total_contexts"))
    return g.withColumn("coverage", F.col("covered_contexts") / F.col("total_contexts"))


def _words(checked: DataFrame, by: list[str], point: list[str]) -> DataFrame:
    words = checked.groupBy(*by, "word", *point).agg(F.bool_or("survives").alias("any"), F.bool_and("survives").alias("all"), F.count_if("survives").alias("c"), F.count("*").alias("n"))
    out = words.groupBy(*by, *point).agg(
        F.count_if("any").alias("covered_words_any"), F.count_if("all").alias("covered_words_all"), F.count("*").alias("total_words"), F.sum("c").alias("covered_contexts"), F.sum("n").alias("total_contexts"))
    return out.withColumn("any_coverage", F.col("covered_words_any") / F.col("total_words")).withColumn("all_coverage", F.col("covered_words_all") / F.col("total_words"))


def word_coverage(paths: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """Words with any and with all contexts covered, for each point of the grid."""
    return _words(on_grid(paths, grid), by, ["decoder", "parameter"])


def recipe_paths(audit: DataFrame, keys: list[str], recipes: list[Recipe]) -> DataFrame:
    """keys, recipe, survives: top-k, then top-p of what top-k leaves, renormalised.

    A row whose rank passes but which stores fewer alternatives than top-k needs fails the query.
    """
    rows = audit.select(*keys, "rank", "cumulative_probability", "probability", F.transform("top_tokens", lambda t: t["probability"]).alias("_top"))
    rows = rows.withColumn("r", F.explode(F.array(*[F.struct(F.lit(r.name).alias("recipe"), F.lit(r.top_k).alias("k"), F.lit(float(r.top_p)).alias("p")) for r in recipes])))
    mass = F.aggregate(F.slice("_top", 1, F.col("r.k")), F.lit(0.0), lambda a, x: a + x)
    short = F.coalesce(F.size("_top"), F.lit(0)) < F.col("r.k")
    ok = (
        F.when(F.col("rank") > F.col("r.k"), False)
        .when(short, F.raise_error(F.lit("fewer alternatives are stored than a recipe needs")).cast("boolean"))
        .otherwise((mass > 0) & (F.try_divide(F.col("cumulative_probability") - F.col("probability"), mass) <= F.col("r.p"))))
    return rows.select(*keys, "r.recipe", ok.alias("ok")).groupBy(*keys, "recipe").agg(F.bool_and("ok").alias("survives"))


def recipe_words(paths: DataFrame, by: list[str]) -> DataFrame:
    return _words(paths, by, ["recipe"])


def word_means(paths: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """by, word: mean coverage over contexts and grid, share of contexts that any point reaches, tokens."""
    contexts = on_grid(paths, grid).groupBy(*by, "word", "sample_id").agg(F.count_if("survives").alias("hits"), F.count("*").alias("points"), F.max("n_tokens").alias("t"))
    out = contexts.groupBy(*by, "word").agg(F.count("*").alias("evaluated_contexts"), F.sum("hits").alias("h"), F.sum("points").alias("evaluated_settings"), F.count_if(F.col("hits") > 0).alias("a"), F.avg("t").alias("mean_token_count"))
    return out.select(*by, "word", "evaluated_contexts", "evaluated_settings", (F.col("h") / F.col("evaluated_settings")).alias("mean_coverage"), (F.col("a") / F.col("evaluated_contexts")).alias("any_reachable_rate"), "mean_token_count")


def with_all_models(words: DataFrame, keys: list[str]) -> DataFrame:
    """words and, for each word, the unweighted mean of its rows as model ALL_MODELS."""
    everything = words.groupBy(*keys).agg(
        F.lit("ALL_MODELS").alias("model"), F.lit(None).cast("double").alias("temperature"), F.sum("evaluated_contexts").alias("evaluated_contexts"), F.sum("evaluated_settings").alias("evaluated_settings"),
        *[F.avg(c).alias(c) for c in ("mean_coverage", "any_reachable_rate", "mean_token_count")])
    return words.unionByName(everything.select(*words.columns))


def explorer(audit: DataFrame, keys: list[str]) -> DataFrame:
    """keys, worst_rank, probability_product, ordered steps, and the first token's alternatives."""
    step = F.struct("word_token_index", "token_id", "rank", "probability")
    return audit.groupBy(*keys).agg(
        F.max("rank").alias("worst_rank"), F.product("probability").alias("probability_product"), F.sort_array(F.collect_list(step)).alias("steps"),
        F.min_by(F.struct("neighbors_above", "neighbors_below"), "word_token_index").alias("first_neighbors"))


def models_found(checked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, found, models, any, all: in how many models a context survives."""
    g = checked.groupBy(*keys).agg(F.count_if("survives").alias("found"), F.count("*").alias("models"))
    return g.withColumn("any_model", F.col("found") > 0).withColumn("all_models", F.col("found") == F.col("models"))


def probability_status(p: Column) -> Column:
    """The bounds of how likely a word counts."""
    return F.when(p >= 0.8, "Excellent").when(p >= 0.5, "Good").when(p >= 0.1, "Fair").when(p >= 0.01, "Poor").otherwise("Missed")


def leaderboard(coverage: DataFrame, by: list[str], decoder: str = "top_p") -> DataFrame:
    """Each model's best row of one decoder (of any, where it has none), ranked."""
    own = F.when(F.col("decoder") == decoder, 0).otherwise(1)
    best = coverage.groupBy("model", *by).agg(F.min_by(F.struct("decoder", "parameter", "coverage"), F.struct(own.alias("o"), (-F.col("coverage")).alias("c"), "parameter", "decoder")).alias("b"))
    w = Window.partitionBy(*by).orderBy(F.col("b.coverage").desc(), "model")
    return best.select("model", *by, "b.decoder", "b.parameter", "b.coverage", F.row_number().over(w).cast("long").alias("place"))
