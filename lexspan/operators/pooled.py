"""Diversity of all tokens of a group, one behind the other, without a task or a row that holds a group.

MTLD goes through a sequence factor by factor: from a place, the next factor begins behind the first run
whose type-token ratio is at most the threshold. Where a factor that begins at some place ends does not
depend on what came before, so the places are cut into pieces, and each piece finds for every one of its
places at which place behind the piece, and after how many factors, one leaves it. A piece sees the pieces
behind it as far as factors reach. Of these pointers only those matter that another piece leads to; they
are followed by doubling, so that a sequence of n pieces takes log2(n) joins of a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan import ordered, stored
from lexspan.functions import diversity

#: Tokens of a piece, and how many times as many a piece has in the next turn if a factor reaches too far.
PIECE, LONGER = 20_000, 4
#: No place: a factor does not end within what a piece sees.
OPEN = -1


def factor_ends(ids: np.ndarray, own: int, whole: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first `own` places, where the next factor begins, and how much of a factor lies between.

    That is 1 unless a factor reaches the end of `ids`: then it is a part if the sequence ends there (`whole`), else open.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    last = np.full(n, -1, np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    last[order[1:][again]] = order[:-1][again]
    following, part = np.full(own, OPEN, np.int64), np.ones(own)
    start, types = np.arange(own), np.zeros(own, np.int64)
    for width in range(1, n + 1):  # all factors grow by a token at a time; those that end drop out
        at = start + width - 1
        inside = at < n
        if not inside.all():
            if whole:
                following[start[~inside]] = n
                part[start[~inside]] = (1.0 - types[~inside] / (width - 1)) / (1.0 - threshold)
            start, types, at = start[inside], types[inside], at[inside]
        if not len(start):
            break
        types = types + (last[at] < start)
        done = types / width <= threshold
        following[start[done]] = start[done] + width
        start, types = start[~done], types[~done]
    if whole and len(start):  # only the first place sees all n tokens
        following[start] = n
        part[start] = (1.0 - types / n) / (1.0 - threshold)
    return following, part


def exits(following: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: where one leaves the piece, and how many factors lie between."""
    own = len(following)
    out, factors = following.copy(), part.copy()
    for s in range(own - 1, -1, -1):
        to = following[s]
        if to != OPEN and to < own:
            out[s], factors[s] = out[to], factors[s] + factors[to]
    return out, factors


def _pieces(rows: DataFrame, by: Sequence[str], piece: int, threshold: float) -> DataFrame:
    """by, piece, exits, factors of each piece, from rows (by, _t, _start, _total)."""
    at = F.explode(F.sequence(F.floor(F.col("_start") / piece), F.floor((F.col("_start") + F.size("_t") - 1) / piece)))
    cut = rows.where(F.size("_t") > 0).select("*", at.alias("_q"))
    lo = F.greatest(F.col("_q") * piece, F.col("_start"))
    hi = F.least((F.col("_q") + 1) * piece, F.col("_start") + F.size("_t"))
    cut = cut.select(*by, "_q", "_total", lo.alias("_lo"), F.slice("_t", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias("_t"))
    # Each slice goes to its own piece and to the one before, which looks ahead.
    seen = cut.withColumn("_piece", F.explode(F.sequence(F.greatest(F.col("_q") - 1, F.lit(0)), F.col("_q"))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_lo")
        number, total = int(frame["_piece"].iloc[0]), int(frame["_total"].iloc[0])
        tokens = np.concatenate([np.asarray(t, object) for t in frame["_t"]])
        first = number * piece
        following, part = factor_ends(pd.factorize(tokens)[0], min(piece, len(tokens)), first + len(tokens) == total, threshold)
        to, factors = exits(following, part)
        out = frame[list(by)].iloc[:1].copy()
        out["_piece"], out["_exits"], out["_factors"] = number, [np.where(to == OPEN, OPEN, to + first)], [factors]
        return out

    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    return seen.groupBy(*by, "_piece").applyInPandas(run, f"{fields}, _piece long, _exits array<long>, _factors array<double>")


def pooled_mtld(rows: DataFrame, by: Sequence[str], threshold: float, piece: int = PIECE) -> DataFrame:
    """by, _factors (with the part that is left): of groups of rows (by, _t, _start, _total)."""
    pieces = stored.written(_pieces(rows, by, piece, threshold))
    first = pieces.select(*by).distinct().withColumn("_entry", F.lit(0).cast("long"))
    others = pieces.select(*by, F.explode(F.array_distinct("_exits")).alias("_entry")).where(F.col("_entry") != OPEN)
    entries = first.union(others.distinct()).withColumn("_piece", F.floor(F.col("_entry") / piece))
    at = (F.col("_entry") - F.col("_piece") * piece).cast("int")
    steps = ordered.joined(entries, pieces, [*by, "_piece"]).where(at < F.size("_exits"))
    steps = steps.select(*by, "_entry", F.get("_exits", at).alias("_exit"), F.get("_factors", at).alias("_n"))
    steps = stored.written(steps)
    while True:
        # A place that no piece begins at is the end of its sequence; an open one ends the path too.
        ahead = steps.select(*by, F.col("_entry").alias("_exit"), F.col("_exit").alias("_to"), F.col("_n").alias("_more"))
        if ordered.joined(steps.where("_entry = 0"), ahead, [*by, "_exit"], "left_semi").isEmpty():
            break
        both = ordered.joined(steps, ahead, [*by, "_exit"], "left")
        steps = stored.written(both.select(*by, "_entry", F.coalesce("_to", "_exit").alias("_exit"), (F.col("_n") + F.coalesce("_more", F.lit(0.0))).alias("_n")))
    ends = steps.where("_entry = 0")
    done = ends.where(F.col("_exit") != OPEN).select(*by, F.col("_n").alias("_factors"))
    short = stored.written(ends.where(F.col("_exit") == OPEN).select(*by))
    if short.isEmpty():
        return done
    # A factor reaches beyond the next piece: longer pieces for these groups, as long as a factor needs.
    return done.union(pooled_mtld(ordered.joined(rows, short, by, "left_semi"), by, threshold, piece * LONGER))


def pooled_diversity(rows: DataFrame, by: Sequence[str], order: Sequence[str], tokens: str, threshold: float = diversity.THRESHOLD, piece: int = PIECE) -> DataFrame:
    """by, tokens, pooled_ttr, pooled_mtld of all tokens of a group in order of its rows; null counts as no tokens.

    A task holds two pieces, which grow to the longest factor where one is longer; never a group.
    """
    texts = rows.select(*by, *order, F.coalesce(tokens, F.array().cast("array<string>")).alias("_t"))
    placed = ordered.running(ordered.sorted_rows(texts, by, order), by, F.size("_t").cast("long"), "_start", inclusive=False)
    totals = stored.written(texts.groupBy(*by).agg(F.sum(F.size("_t")).alias("_total")))
    placed = stored.written(ordered.joined(ordered.plain(placed).select(*by, "_t", "_start"), totals, by))
    types = placed.select(*by, F.explode("_t").alias("_token")).distinct().groupBy(*by).agg(F.count("*").alias("_types"))
    factors = pooled_mtld(placed, by, threshold, piece)
    out = ordered.joined(ordered.joined(totals, types, by, "left"), factors, by, "left")
    n = F.col("_total")
    mtld = F.when(F.col("_factors") > 0, n / F.col("_factors")).otherwise(n.cast("double"))
    return out.select(*by, n.alias("tokens"), F.when(n > 0, F.col("_types") / n).otherwise(0.0).alias("pooled_ttr"), mtld.alias("pooled_mtld"))
