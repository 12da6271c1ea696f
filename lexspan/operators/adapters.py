"""What can't run here, behind small interfaces: score models, generators, judges."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Decider(Protocol):
    """Adds accepted, reason and note to candidate rows."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


def table_decider(decisions: DataFrame, keys: list[str]) -> Decider:
    """Decisions that are known already; what has none is rejected, as an omitted answer is."""

    def decide(candidates: DataFrame) -> DataFrame:
        known = decisions.select(*keys, F.col("accepted").alias("_a"), *[F.col(c) if c in decisions.columns else F.lit(None).cast("string").alias(c) for c in ("reason", "note")])
        out = candidates.join(known, keys, "left")
        return out.withColumn("accepted", F.coalesce("_a", F.lit(False))).withColumn("reason", F.when(F.col("_a").isNull(), F.lit("omitted")).otherwise(F.col("reason"))).drop("_a")

    return decide


class Unavailable(Exception):
    """A judge that may answer later, after so many seconds if it says so; it is asked again."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


#: What a judge is asked again for; anything else it raises is final.
PASSING = (Unavailable, TimeoutError, ConnectionError)


def aligned(answers: list[bool], expected: int) -> list[bool]:
    """A judge's answers for a batch: missing ones are rejections, those beyond are dropped; ValueError if one is no boolean."""
    if any(type(x) is not bool for x in answers):
        raise ValueError(f"answers must be booleans: {answers!r}")
    return [*answers, *[False] * (expected - len(answers))][:expected]


def asked(ask: Callable[[list[dict]], list[bool]], part: list[dict], tries: int, wait: float) -> list[tuple[bool, str | None]]:
    """A judge's answers with a reason where there is one, asked again after a wait that doubles, or that the judge names.

    A batch is rejected when all tries have failed, or at once when a failure isn't of those that pass.
    """
    error = ""
    for k in range(tries):
        try:
            given = list(ask(part))
            return [(x, None if i < len(given) else "omitted") for i, x in enumerate(aligned(given, len(part)))]
        except PASSING as e:
            error = f"error: {type(e).__name__}"
            if k + 1 < tries:
                after = getattr(e, "after", None)
                time.sleep(wait * 2**k if after is None else after)
        except Exception as e:  # noqa: BLE001 - whatever else a judge raises, asking again would not mend it
            return [(False, f"error: {type(e).__name__}")] * len(part)
    return [(False, error)] * len(part)


def batch_decider(ask: Callable[[list[dict]], list[bool]], batch: int = 50, tries: int = 5, wait: float = 1.0, strict: bool = False) -> Decider:
    """Asks a judge in batches of rows, in the tasks; strict fails the job instead of rejecting what it could not ask."""
    if batch < 1 or tries < 1:
        raise ValueError("batches and tries must be 1 or more")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            out = [x for i in range(0, len(rows), batch) for x in asked(ask, rows[i : i + batch], tries, wait)]
            failed = next((r for _, r in out if r and r != "omitted"), None)
            if strict and failed:
                raise RuntimeError(f"the judge did not answer: {failed}")
            yield frame.assign(accepted=pd.Series([a for a, _ in out], frame.index, bool), reason=pd.Series([r for _, r in out], frame.index, object))

    def decide(candidates: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{c}` {t}" for c, t in candidates.dtypes)
        return candidates.mapInPandas(run, f"{fields}, accepted boolean, reason string")

    return decide


def generate(samples: DataFrame, conditions: DataFrame, load: Callable[[], Callable[[list[dict]], list[str]]]) -> DataFrame:
    """samples × conditions with generated text; conditions are a few literal rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield frame.assign(text=model(frame.to_dict("records")))

    rows = samples.crossJoin(F.broadcast(conditions))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, text string")
