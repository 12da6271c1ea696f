"""Connected components of a graph given by its edges, as joins and minima only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm import scratch

#: Edges that are left up to this number go through one task, which needs no more rounds for them.
FEW = 20_000


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, comp of the edges of one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "comp": pd.Series([root(x) for x in ids], dtype="int64")})


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): for each node of the edges (a, b), the smallest node that it is connected with.

    Each round hooks every node to its smallest neighbour, follows that pointer once more, and
    contracts the edges; at least every second node that has an edge is gone after it. Once FEW edges
    are left, one task finishes. An edge table without rows gives no rows. Loops and repeated edges
    change nothing.
    """
    a, b = F.col("a"), F.col("b")
    spark, labels = edges.sparkSession, None
    rest = scratch.written(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    while True:
        left = rest.count()
        if not left:
            break
        if left <= FEW:
            ends = scratch.written(rest.coalesce(1).mapInPandas(_united, "id long, comp long"), "united")
            if labels is None:
                return ends
            last = ends.select(F.col("id").alias("a"), F.col("comp").alias("p"))
            labels = labels.join(last, F.col("comp") == F.col("a"), "left").select("id", F.coalesce("p", "comp").alias("comp"))
            break
        both = rest.union(rest.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        over = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
        hook = scratch.written(hook.join(over, "p").select("a", F.col("q").alias("p")), "hooks")
        if labels is None:
            labels = hook.select(F.col("a").alias("id"), F.col("p").alias("comp"))
        else:
            labels = labels.join(hook, F.col("comp") == F.col("a"), "left").select("id", F.coalesce("p", "comp").alias("comp"))
        ends = rest.join(hook.withColumnRenamed("p", "pa"), "a").join(hook.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        ends = ends.where(F.col("pa") != F.col("pb"))
        rest = scratch.written(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return spark.createDataFrame([], "id long, comp long")
    return scratch.written(labels, "labels")
