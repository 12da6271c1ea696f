"""Quality by a Bradley-Terry model: pairwise preferences between documents, by logistic loss.

A document of label 1 is preferred to one of label 0. Each document has a score that is linear in its
features; the chance that one is preferred is the logistic function of the difference of scores, so
the weights are fitted on differences of features. The cut is a quantile of the sample's scores: the
share of label 0 lies below it. The score that is given out is a logistic function of the distance to
that cut, which is THRESHOLD at the cut.

Cases: null and empty texts have zeros for features and get the score of such; without labelled rows
of both kinds every score is the share of label 1 (0 without any); repeated rows get equal scores; a null
doc_id is kept and counts as the empty text for held_out; very long texts are read whole; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm import labelled

BY, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Preference pairs that the weights are fitted on, steps of the fit, and its penalty on weights.
PAIRS, STEPS, PENALTY = 40_000, 60, 1e-3
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = slice(65, 91)
DIGITS = slice(48, 58)
STOPS, MARKS = [ord(c) for c in ".,;:'\"-?()"], [ord("!")]
SIGNS = [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]


def features(text: str) -> list[float]:
    """Rates of kinds of characters, and of repetition and shapes of words and lines."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    k = max(1, len(words))
    tally = Counter(words)
    top = max(tally.values(), default=0)
    lines = text.split("\n")
    letters = max(1, int(counts[LETTERS].sum()))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    rate = lambda places: float(counts[places].sum()) / n
    soft = lambda x, scale: math.tanh(x / scale)
    return [
        letters / n, rate(DIGITS), soft(rate(DIGITS), 0.05), rate(STOPS), rate(SIGNS), soft(rate(SIGNS), 0.02), soft(rate(MARKS), 0.01),
        float(counts[UPPER].sum()) / letters, soft(float(counts[UPPER].sum()) / letters, 0.2), float(counts[32]) / n,
        soft(sum(map(len, words)) / k, 10), len(tally) / k, soft(len(tally) / k, 0.3), top / k, same / k, soft(same / k, 0.05),
        soft(tally[b"|"] / k, 0.05), soft(sum(1 for w in tally if len(w) > 25) / k, 0.05), soft(math.log1p(k), 5), soft(k, 20),
        1 - len(set(lines)) / len(lines), soft(len(lines) / k, 0.2), soft((counts[46] + counts[63] + counts[33]) / k, 0.1)]


N_FEATURES = len(features(""))


@dataclass
class Model:
    weights: np.ndarray | None
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    spread: float
    share: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        raw = self.raw(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES))
        z = (raw - self.cut) / self.spread + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def bradley_terry(better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Weights that make preferred rows score higher: Newton steps on the logistic loss of differences."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
        gradient = d.T @ (1 - p) / len(d) - PENALTY * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + PENALTY * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[str, int]], pairs: int = PAIRS) -> Model:
    """A model from (text, label) rows."""
    y = np.array([v for _, v in rows], int)
    share = float(y.mean()) if len(y) else 0.0
    zeros = np.zeros(N_FEATURES)
    if len(set(y)) < 2:
        return Model(None, zeros, zeros + 1, 0.0, 1.0, share)
    x = np.array([features(t) for t, _ in rows])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    random = np.random.default_rng(0)
    a, b = (random.choice(np.flatnonzero(y == k), pairs) for k in (1, 0))
    w = bradley_terry(z[a], z[b])
    raw = z @ w
    order = np.sort(raw)
    k = int((y == 0).sum())
    # Half way across the gap at the quantile, so that ties there don't decide.
    cut = float((order[k - 1] + order[min(k, len(order) - 1)]) / 2)
    return Model(w, mean, scale, cut, float(np.std(raw)) / 4 + 1e-9, share)


def _scored(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(texts), pa.float64())], ["doc_id", "score"])

    return score


def quality(documents: DataFrame, labels: DataFrame, rows: int = labelled.FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; a row for each document."""
    fitted = fit([(t, y) for _, t, y in labelled.sample(documents, labels, "quality", BY, HELD_OUT, rows)])
    model = documents.sparkSession.sparkContext.broadcast(fitted)
    out = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", (labelled.remainder("doc_id", BY) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
