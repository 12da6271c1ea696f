"""From documents to packed sequences: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents. Counted as part of lexspan.llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import decontam, line_dedup, ngram_join, packing, scratch, toxicity
from lexspan.llm.queries import tokenizer_file


#: Words whose ids a worker keeps: fewer than alone, as workers live on and so hold them through other stages.
CACHED_WORDS = 100_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.kept(docs, _table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go from the texts; rows stay, n_chars follows where there is one."""
    out = line_dedup.dedup_lines(docs, counts=False)
    kept = [F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c, kind in docs.dtypes]
    return out.select(*kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their places in sequences."""
    return packing.best_fit_pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2, cache_parts=CACHED_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: The classifier and the search for few sequences have no SQL; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
