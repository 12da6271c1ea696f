"""Maintenance of sample sets and audits: changes, merges, replacements, decision logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(original: DataFrame, repaired: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose fields differ; other columns may. Keys that only one side has fail the query."""
    a = original.select(F.col(key).alias("ka"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = repaired.select(F.col(key).alias("kb"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = a.join(b, F.col("ka") == F.col("kb"), "full")
    alone = F.col("ka").isNull() | F.col("kb").isNull()
    differs = reduce(lambda x, y: x | y, [~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")) for f in fields])
    error = F.raise_error(F.concat(F.lit("sample ids differ: "), F.coalesce("ka", "kb").cast("string"))).cast("boolean")
    return both.where(F.when(alone, error).otherwise(differs)).select(F.col("ka").alias(key))


def merged(base: DataFrame, delta: DataFrame, changed_keys: DataFrame, key: str) -> DataFrame:
    """base, with all rows of changed samples replaced by those of delta.

    Changed keys that base or delta lacks, or keys of delta that didn't change, fail the query.
    """
    ids = changed_keys.select(key).distinct()
    side = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    check = ids.withColumn("c", F.lit(True)).join(side(base, "b"), key, "left").join(side(delta, "d"), key, "full")
    bad = F.col("c").isNull() | F.col("b").isNull() | F.col("d").isNull()
    fine = check.where(F.when(bad, F.raise_error(F.concat(F.lit("cannot merge sample "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).select(key)
    return base.join(fine, key, "left_anti").unionByName(delta.join(fine, key, "left_semi").select(base.columns))


def replacements(rejected: DataFrame, candidates: DataFrame, used: DataFrame, location: list[str], order: list[Column]) -> DataFrame:
    """rejected samples (sample_id, word) with the n-th unused candidate of their word.

    Candidates at a used location are out, and of several at one location the first counts.
    """
    free = candidates.join(used.select(location).distinct(), location, "left_anti")
    free = free.withColumn("_d", F.row_number().over(Window.partitionBy(*location).orderBy(*order))).where("_d = 1").drop("_d")
    free = free.withColumn("turn", F.row_number().over(Window.partitionBy("word").orderBy(*order)))
    need = rejected.withColumn("turn", F.row_number().over(Window.partitionBy("word").orderBy("sample_id")))
    return need.join(free, ["word", "turn"]).drop("turn")


def shortages(rejected: DataFrame, replaced: DataFrame) -> DataFrame:
    """word, needed, found of words with fewer replacements than rejected samples."""
    n = rejected.groupBy("word").agg(F.count("*").alias("needed"))
    m = replaced.groupBy("word").agg(F.count("*").alias("found"))
    return n.join(m, "word", "left").select("word", "needed", F.coalesce("found", F.lit(0)).cast("long").alias("found")).where("found < needed")


def apply_replacements(samples: DataFrame, replaced: DataFrame, fields: list[str]) -> DataFrame:
    """samples, with the fields of replaced ones; ids stay, and metadata say what was done."""
    new = replaced.select("sample_id", *[F.col(f).alias(f"n_{f}") for f in fields], F.lit(True).alias("_r"))
    out = samples.join(new, "sample_id", "left")
    values = [F.when(F.col("_r"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in samples.columns if c != "metadata"]
    extra = F.create_map(F.lit("quality_repaired"), F.lit("1"))
    own = F.col("metadata") if "metadata" in samples.columns else F.create_map().cast("map<string,string>")
    return out.select(*values, F.when(F.col("_r"), F.map_concat(F.map_filter(own, lambda k, _: k != "quality_repaired"), extra)).otherwise(own).alias("metadata"))


def decision_reasons(log: DataFrame, accepted: Column, reason: Column) -> DataFrame:
    """reason, decisions, share."""
    counts = log.groupBy(F.when(accepted, F.lit("accepted")).otherwise(F.coalesce(reason, F.lit("unknown"))).alias("reason")).agg(F.count("*").alias("decisions"))
    total = counts.agg(F.sum("decisions").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "decisions", (F.col("decisions") / F.col("total")).alias("share"))


def rejection_examples(log: DataFrame, accepted: Column, reason: Column, most: int, order: list[Column], text: str, chars: int) -> DataFrame:
    """The first rejected rows of each reason, with the collapsed end of a text."""
    rows = log.where(~F.coalesce(accepted, F.lit(False))).withColumn("reason", F.coalesce(reason, F.lit("unknown")))
    w = Window.partitionBy("reason").orderBy(*order)
    first = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    flat = F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    return first.withColumn("excerpt", F.when(F.length(flat) > chars, F.concat(F.lit("…"), F.right(flat, F.lit(chars)))).otherwise(flat))
