"""Lexical diversity of token arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 0.72


def type_token_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(F.lit(0.0))


def mtld_of(tokens: Sequence[str], threshold: float = THRESHOLD) -> float:
    """Tokens per factor; a factor is the shortest run whose type-token ratio is at most the threshold.

    A token is a new type of the run from `start` on where it last stood before `start`, so that the
    ratios of all runs from there are one cumulative sum. Runs are looked at in windows that double.
    """
    n = len(tokens)
    last, seen = np.empty(n, np.int64), {}
    for i, token in enumerate(tokens):
        last[i] = seen.get(token, -1)
        seen[token] = i
    start, factors = 0, 0.0
    while start < n:
        width = 64
        while True:
            ratio = np.cumsum(last[start : start + width] < start) / np.arange(1, min(width, n - start) + 1)
            low = ratio <= threshold
            if low.any():
                factors += 1.0
                start += int(low.argmax()) + 1
                break
            if start + width >= n:
                factors += (1.0 - float(ratio[-1])) / (1.0 - threshold)
                start = n
                break
            width *= 2
    return n / factors if factors > 0 else float(n)


def mtld(tokens: Column, threshold: float = THRESHOLD, bidirectional: bool = False) -> Column:
    """Mean length of runs that keep the ratio above a threshold, forward or as the mean of both ways.

    A set of types grows with each token; as a fold over arrays in the JVM that is a copy for each
    token, so this one is an Arrow-batched function, linear in the length of a text.
    """
    if not 0.0 < threshold < 1.0:
        raise ValueError("the threshold must lie between 0 and 1")

    @F.pandas_udf("double")
    def score(arrays: pd.Series) -> pd.Series:
        one = lambda a: mtld_of(a, threshold)
        return arrays.map(lambda a: None if a is None else (one(a) + one(a[::-1])) / 2.0 if bidirectional else one(a)).astype(float)

    return score(tokens)
