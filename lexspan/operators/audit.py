"""From next-token scores to audit rows, and checks of their completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["model", "temperature", "sample_id"]


def score_target(df: DataFrame, logits: str, target: str, temperatures: list[float], top: int = 5, neighbors: int = 1) -> DataFrame:
    """df with temperature, rank, probability, top_probability, ratio, cumulative_probability, the top
    tokens and the target's neighbours; the scores are read once for all temperatures.

    Equal probabilities share the best rank; neighbours go by place among equal scores' token ids.
    """
    if any(t <= 0 for t in temperatures) or top < 0 or neighbors < 0:
        raise ValueError("temperatures must be positive; top and neighbors must not be negative")
    x = F.transform(F.col(logits), lambda v: v.cast("double"))
    rows = df.withColumn("_x", x).withColumn("_mx", F.array_max("_x")).withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in temperatures])))
    rows = rows.withColumn("_e", F.transform("_x", lambda v: F.exp((v - F.col("_mx")) / F.col("temperature"))))
    rows = rows.withColumn("_p", F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)))
    p = F.get("_p", F.col(target))
    rows = rows.withColumn("probability", p).withColumn("rank", F.size(F.filter("_p", lambda v: v > F.col("probability"))) + 1)
    ordered = F.array_sort(F.transform("_p", lambda v, i: F.struct((-v).alias("n"), i.alias("id"))))
    rows = rows.withColumn("_s", ordered).withColumn("top_probability", -F.get("_s", F.lit(0))["n"])
    rows = rows.withColumn("probability_ratio_to_top", F.col("probability") / F.col("top_probability"))
    rows = rows.withColumn("cumulative_probability", F.aggregate(F.slice("_s", 1, F.col("rank")), F.lit(0.0), lambda a, e: a - e["n"]))
    place = F.array_position(F.transform("_s", lambda e: e["id"]), F.col(target)).cast("int")
    pick = lambda a: F.transform(a, lambda e: F.struct(e["id"].alias("token_id"), (-e["n"]).alias("probability")))
    first = F.greatest(place - neighbors, F.lit(1))
    rows = rows.withColumn("top_tokens", pick(F.slice("_s", 1, top)))
    rows = rows.withColumn("neighbors_above", pick(F.slice("_s", first, place - first))).withColumn("neighbors_below", pick(F.slice("_s", place + 1, neighbors)))
    return rows.drop("_x", "_mx", "_e", "_p", "_s", logits)


def completeness(audit: DataFrame, expected: str = "word_token_count") -> DataFrame:
    """KEYS, n_rows, expected, complete: whether a sample has each token index once."""
    g = audit.groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"), F.max(expected).cast("long").alias("expected"), F.countDistinct("word_token_index").alias("_d"), F.min("word_token_index").alias("_lo"), F.max("word_token_index").alias("_hi"))
    ok = (F.col("n_rows") == F.col("expected")) & (F.col("_d") == F.col("expected")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("expected") - 1)
    return g.select(*KEYS, "n_rows", "expected", ok.alias("complete"))


def keep_last(audit: DataFrame, position: str) -> DataFrame:
    """The last row by position of each token, where rows were written again."""
    w = Window.partitionBy(*KEYS, "word_token_index").orderBy(F.col(position).desc())
    return audit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def retain_complete(audit: DataFrame, position: str) -> DataFrame:
    """Rows of complete samples only, each token once (its last row)."""
    last = keep_last(audit, position)
    return last.join(completeness(last).where("complete").select(*KEYS), KEYS, "left_semi")


def validity(audit: DataFrame, expected_samples: int, top: int, neighbors: int, version: int = 2, by: list[str] | None = None) -> DataFrame:
    """A row (of each group): whether an audit is of the schema, holds the alternatives asked for, and has all samples.

    Rows must have at least `top` alternatives and exactly the asked number of neighbours on record, with both lists.
    """
    enough = (F.col("audit_schema_version") >= version) & (F.size("top_tokens") >= top) & (F.col("rank_neighbor_count") == neighbors)
    enough = enough & F.col("neighbors_above").isNotNull() & F.col("neighbors_below").isNotNull()
    found = audit.groupBy(*(by or [])).agg(
        F.countDistinct("sample_id").alias("samples"), F.coalesce(F.bool_and(F.coalesce(enough, F.lit(False))), F.lit(False)).alias("rows_valid"))
    return found.withColumn("valid", F.col("rows_valid") & (F.col("samples") == expected_samples))


def temperature_is(column: str, value: float) -> Column:
    return F.abs(F.col(column) - value) <= 1e-9


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing when it runs if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    check = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws("|", *keys))).cast("int")).otherwise(F.lit(0))
    return df.withColumn("_u", check).where("_u = 0").drop("_u")
