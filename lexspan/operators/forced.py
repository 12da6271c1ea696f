"""Forced paths: how a model scores each token of a target behind a prefix, each context scored once.

The contexts of a sample are its prefix and the beginnings of its target behind it. Over all samples they
form a trie: samples with one prefix share its node, targets that begin alike the nodes behind it. Each
node is scored once for all targets that go through it; what a model gives stays in the row in which it is
scored, and only audits of targets are joined with the samples again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators import audit

#: From a text to the ids of its tokens, made in each task.
Encode = Callable[[str], list[int]]


class Scorer(Protocol):
    """Adds logits (an array) to rows that have a context (array<int>)."""

    def __call__(self, contexts: DataFrame) -> DataFrame: ...


def _required(ids: str, what: str):
    error = F.raise_error(F.concat(F.lit(f"no token ids for {what} "), F.coalesce(what, F.lit("null")))).cast("array<int>")
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, F.col(ids)).otherwise(error).alias(ids)


def encoded(samples: DataFrame, load: Callable[[], Encode], prefix: str = "prefix", word: str = "word") -> DataFrame:
    """samples with prefix_ids and word_ids; a target follows its prefix behind a space.

    Samples that have prefix_ids already, and not null ones, keep them. Either side without ids fails the query.
    """
    has_ids = "prefix_ids" in samples.columns
    kept = [c for c in samples.columns if c != "prefix_ids"]
    rows = samples.select(*kept, (F.col("prefix_ids") if has_ids else F.lit(None)).cast("array<int>").alias("prefix_ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            own = [list(encode(p or "")) if ids is None else list(ids) for p, ids in zip(frame[prefix], frame["prefix_ids"], strict=True)]
            yield frame.assign(prefix_ids=pd.Series(own, frame.index, object), word_ids=pd.Series([list(encode(" " + w)) if w else [] for w in frame[word]], frame.index, object))

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    out = rows.mapInPandas(run, f"{fields}, word_ids array<int>")
    return out.select(*kept, _required("prefix_ids", prefix), _required("word_ids", word))


def steps(samples: DataFrame) -> DataFrame:
    """A row for each token of each target: word_token_index, token_id, and the context before it."""
    rows = samples.select("*", F.posexplode("word_ids").alias("word_token_index", "token_id"))
    context = F.concat("prefix_ids", F.slice("word_ids", F.lit(1), F.col("word_token_index")))
    return rows.withColumn("context", context).withColumn("word_token_count", F.size("word_ids"))


def nodes(path_steps: DataFrame) -> DataFrame:
    """context, targets: each node of the trie with the tokens that some target goes on with, as many as a vocabulary has."""
    return path_steps.groupBy("context").agg(F.sort_array(F.collect_set("token_id")).alias("targets"))


def model_scorer(load: Callable[[], Callable[[list[list[int]]], list[list[float]]]], batch: int = 16) -> Scorer:
    """A model that each task loads once, asked for batches of contexts of one length.

    Contexts are dealt by length and order, so that a batch needs no padding and neighbours share their beginnings.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for _, same in frame.groupby(frame["context"].map(len), sort=True):
                for i in range(0, len(same), batch):
                    part = same.iloc[i : i + batch]
                    yield part.assign(logits=pd.Series(model([list(map(int, c)) for c in part["context"]]), part.index, object))

    def score(contexts: DataFrame) -> DataFrame:
        n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = [F.size("context"), F.col("context")]
        dealt = contexts.repartitionByRange(n, *order).sortWithinPartitions(*order)
        fields = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
        return dealt.mapInPandas(run, f"{fields}, logits array<double>")

    return score


def forced_audit(samples: DataFrame, scorer: Scorer, temperatures: list[float], top: int = 5, neighbors: int = 1) -> DataFrame:
    """The steps of samples (prefix_ids, word_ids and others), with how each is scored at each temperature."""
    path_steps = steps(samples)
    scored = scorer(nodes(path_steps)).select(F.col("context").alias("_context"), F.explode("targets").alias("_target"), "logits")
    found = audit.score_target(scored, "logits", "_target", temperatures, top, neighbors)
    same = (F.col("context") == F.col("_context")) & (F.col("token_id") == F.col("_target"))
    return path_steps.join(found, same).drop("_context", "_target")
