"""Writers. Spark's commit protocol makes each of them whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import corpus


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def temperature_slug(temperature: Column) -> Column:
    """t1p5 for 1.5"""
    return F.concat(F.lit("t"), F.replace(F.regexp_replace(F.format_string("%.6f", temperature), r"\.?0+$", ""), F.lit("."), F.lit("p")))


def write_by_temperature(df: DataFrame, path: str) -> None:
    """One folder for each temperature, which later reads can skip."""
    df.withColumn("temperature_slug", temperature_slug(F.col("temperature"))).write.mode("overwrite").partitionBy("temperature_slug").json(path)


def write_summary(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A small table as one ordered CSV file."""
    df.select(*columns).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def write_frequency(counts: DataFrame, path: str) -> None:
    """rank, word, count by tabs, in order of ranks; files follow each other."""
    corpus.ranked(counts).select("rank", "word", "count").orderBy("rank").write.mode("overwrite").option("sep", "\t").csv(path)


def write_books(books: DataFrame, path: str) -> DataFrame:
    """Books as Parquet by language, and a one-row manifest, which is also returned."""
    books.write.mode("overwrite").partitionBy("language").parquet(f"{path}/books")
    manifest = books.agg(F.count("*").alias("books"), F.sum(F.length("text")).alias("characters"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_per_word(contexts: DataFrame, path: str) -> None:
    """A JSON row for each word with its contexts, in folders by word groups, and an index of words."""
    rows = contexts.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(*[c for c in contexts.columns if c != "word"]))).alias("contexts"))
    rows = rows.withColumn("part", F.left(F.md5("word"), F.lit(2)))
    rows.write.mode("overwrite").partitionBy("part").json(f"{path}/words")
    contexts.groupBy("word").agg(F.count("*").alias("contexts")).write.mode("overwrite").json(f"{path}/index")


def cached_index(spark: SparkSession, path: str, metadata: dict[str, str], build) -> DataFrame:
    """The occurrence index at a path if it was built with the same metadata, else a new one."""
    import json

    wanted = json.dumps(metadata, sort_keys=True)
    try:
        found = spark.read.text(f"{path}/metadata").first()
        if found and found.value == wanted:
            return spark.read.parquet(f"{path}/index")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(f"{path}/index")
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return spark.read.parquet(f"{path}/index")
