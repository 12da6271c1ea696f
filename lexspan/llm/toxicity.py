"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Lexicon: words, and beginnings of words, that are far more common in documents labelled toxic. It is
learned from the labelled sample alone, crosswise: the features of a row that the trees are fitted on
come from a lexicon that hasn't seen the row.

Features of a text: rates and counts of lexicon words, how closely they stand together, how many have
a second-person word nearby, capitals, punctuation, and how many words are obfuscated (digits or signs
within letters), also those that turn out to be lexicon words when read plainly.

Cases: null and empty texts have zeros for features and get the score of such; without labelled rows
of both kinds every score is the share of toxic ones (0 without any); repeated rows get equal scores; a null
doc_id is kept and counts as the empty text for held_out; very long texts are read whole; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm import labelled, scratch
from lexspan.stored import numbered

BY, HELD_OUT, THRESHOLD = 4, 2, 0.3
STARTS = (4, 5)
#: A unit is toxic from this log odds ratio, in this share of toxic documents, and in so many at least.
ODDS, SHARE, LEAST = 3.0, 0.015, 3
#: Units kept; bounds the model.
UNITS = 5_000
FOLDS = 3
#: Second-person words of the languages here, and readings of signs used for letters.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo".split())
PLAIN = str.maketrans("013457@$!|", "oieastasii")
SIGNS = ".,;:!?\"'()[]{}<>*_-…«»¡¿"
NEAR, CLOSE = 5, 20
N_FEATURES = 17


def units(words: list[str]) -> set[str]:
    """What a lexicon is made of: whole words, and beginnings (marked by a trailing *) of longer ones."""
    out = set(words)
    for n in STARTS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def cores(text: str) -> list[str]:
    return [w.strip(SIGNS) for w in text.lower().split()]


def frequent(toxic: dict[str, int], n: dict[int, int]) -> set[str]:
    """Units of enough toxic rows; n: how many rows have each label."""
    return {u for u, c in toxic.items() if c >= least(n) and u not in ("", "*")}


def least(n: dict[int, int]) -> int:
    return max(LEAST, math.ceil(SHARE * n[1]))


def chosen(toxic: dict[str, int], other: dict[str, int], n: dict[int, int]) -> frozenset[str]:
    """Units far more common among toxic rows, by document counts."""
    held = frequent(toxic, n)
    odds = {u: math.log((toxic[u] + 0.5) / (n[1] + 1)) - math.log((other[u] + 0.5) / (n[0] + 1)) for u in held}
    return frozenset(sorted((u for u in held if odds[u] >= ODDS), key=lambda u: (-odds[u] * toxic[u], u))[:UNITS])


def learn_lexicon(rows: list[tuple[list[str], int]]) -> frozenset[str]:
    toxic, other = Counter(), Counter()
    n = Counter(y for _, y in rows)
    for words, y in rows:
        if y:
            toxic.update(units(words))
    held = frequent(toxic, n)
    for words, y in rows:
        if not y:
            other.update(held & units(words))
    return chosen(toxic, other, n)


class Lexicon:
    def __init__(self, held: frozenset[str]):
        self.words = {u for u in held if not u.endswith("*")}
        self.starts = [(n, {u[:-1] for u in held if u.endswith("*") and len(u) == n + 1}) for n in STARTS]
        self.starts = [(n, s) for n, s in self.starts if s]

    def hits(self, words: list[str]) -> list[int]:
        """Where words of the lexicon stand."""
        found = {i for i, w in enumerate(words) if w in self.words}
        for n, starts in self.starts:
            found.update(i for i, w in enumerate(words) if w[:n] in starts and len(w) > n)
        return sorted(found)


def features(text: str, words: list[str], lexicon: Lexicon) -> list[float]:
    n, chars = max(1, len(words)), max(1, len(text))
    hits = lexicon.hits(words)
    close = max((b - a for a, b in ((i, k) for k, i in _within(hits))), default=0)
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    at = np.searchsorted(you, hits) if you and hits else []
    near = sum(1 for h, k in zip(hits, at, strict=False) if min(abs(you[j] - h) for j in (k - 1, k) if 0 <= j < len(you)) <= NEAR)
    odd = [w for w in words if not w.isalpha() and any(map(str.isalpha, w))]
    plain = [w.translate(PLAIN).replace("-", "").replace(".", "").replace("*", "") for w in odd]
    read = len(lexicon.hits(plain))
    raw = text.split()
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper())
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = text.count("!")
    return [
        len(hits) / n, math.log1p(len(hits)), math.log1p(len({words[i] for i in hits})), float(close), near / max(1, len(hits)), len(you) / n,
        shouted / n, upper / chars, marks / chars, text.count("?") / chars, sum(map(text.count, ".,;:")) / chars,
        len(odd) / n, read / n, math.log1p(read), (len(hits) + read) / n, math.log1p(n), sum(map(text.count, "#$%&*@")) / chars]


def _within(hits: list[int]) -> Iterator[tuple[int, int]]:
    """For each hit, how many hits end with it within CLOSE words (as a pair of indexes)."""
    first = 0
    for k, h in enumerate(hits):
        while hits[first] < h - CLOSE:
            first += 1
        yield k + 1, first


@dataclass
class Trees:
    """Boosted regression trees for a binary label, on binned features."""

    rate: float = 0.15
    depth: int = 3
    rounds: int = 60
    bins: int = 32
    leaf: float = 5.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    #: Each tree: per node the feature, the last bin to the left, and the value where it is a leaf.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._tree(b, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            raw += self._value(tree, b)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        n = 2 ** (self.depth + 1)
        feature, cut, value = np.full(n, -1), np.zeros(n, int), np.zeros(n)
        node = np.ones(len(b), int)
        for k in range(1, n):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            G, H = g[own].sum(), h[own].sum()
            value[k] = self.rate * G / (H + 1)
            if k >= n // 2:
                continue
            best = 1e-6
            for j in range(b.shape[1]):
                gs, hs, cs = (np.cumsum(np.bincount(b[own, j], w, self.bins)) for w in (g[own], h[own], None))
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                gain[(cs < self.leaf) | (len(own) - cs < self.leaf)] = 0
                i = int(gain.argmax())
                if gain[i] > best:
                    best, feature[k], cut[k] = gain[i], j, i
            if feature[k] >= 0:
                node[own] = 2 * k + (b[own, feature[k]] > cut[k])
        return feature, cut, value

    def _value(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.ones(len(b), int), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + (b[rows, f] > cut[node]), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._value(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function from raw scores to shares of label 1 that fits best."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, v in zip(raw[order], y[order], strict=True):
        blocks.append([v, 1.0, x, x])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    xs = np.array([x for _, _, lo, hi in blocks for x in (lo, hi)])
    ys = np.array([s / n for s, n, *_ in blocks for _ in (0, 1)])
    return xs, ys


@dataclass
class Model:
    lexicon: frozenset[str]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        lexicon = Lexicon(self.lexicon)
        x = np.array([features(t, cores(t), lexicon) for t in texts]).reshape(-1, N_FEATURES)
        return np.interp(self.trees.raw(x), *self.knots)


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows at hand; `train` makes the same from tables."""
    y = np.array([v for _, v in rows], float)
    if len(set(y)) < 2:
        return _constant(y.sum(), len(y))
    words = [cores(t) for t, _ in rows]
    both = list(zip(words, y.astype(int), strict=True))
    fold = np.arange(len(rows)) % FOLDS
    crossed = [Lexicon(learn_lexicon([r for r, f in zip(both, fold, strict=True) if f != k])) for k in range(FOLDS)]
    x = np.array([features(t, w, crossed[f]) for (t, _), w, f in zip(rows, words, fold, strict=True)])
    return _fitted(learn_lexicon(both), x, y)


def _constant(n_toxic: float, n: int) -> Model:
    return Model(frozenset(), None, (np.zeros(1), np.zeros(1)), float(n_toxic) / n if n else 0.0)


def _fitted(lexicon: frozenset[str], x: np.ndarray, y: np.ndarray) -> Model:
    """A model from the features of rows, whose folds take turns."""
    fold = np.arange(len(y)) % FOLDS
    held = np.zeros(len(y))
    for k in range(FOLDS):
        held[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicon, Trees().fit(x, y), isotonic(held, y), float(y.mean()))


def _tallied(held):
    """In how many texts of a task and fold each unit stands, or each of those held."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(FOLDS)]
        for batch in batches:
            for fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = units(cores(text))
                counts[fold].update(found & held.value if held else found)
        for fold, count in enumerate(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.string()), pa.array([fold] * len(count), pa.int32()), pa.array(list(count.values()), pa.int64())], ["unit", "fold", "n"])

    return tally


def _tally(sample: DataFrame, label: int, held=None) -> DataFrame:
    """unit, n_0, n_1, ...: in how many texts of a label and each fold it stands."""
    rows = sample.where(F.col("y") == label).select("fold", "t").mapInArrow(_tallied(held), "unit string, fold int, n long")
    return rows.groupBy("unit").agg(*[F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in range(FOLDS)])


def learn_lexicons(sample: DataFrame, n: dict[tuple[int, int], int]) -> list[frozenset[str]]:
    """For each fold the lexicon of all other folds, and last that of all; n: how many rows have each fold and label.

    Units are counted by tasks; only those that stand in enough toxic texts come to the driver.
    """
    folds = [[j for j in range(FOLDS) if j != k] for k in range(FOLDS + 1)]
    totals = [{y: sum(n.get((j, y), 0) for j in own) for y in (0, 1)} for own in folds]
    enough = [sum(F.col(f"n_{j}") for j in own) >= least(total) for own, total in zip(folds, totals, strict=True)]
    toxic = {r.unit: r[1:] for r in _tally(sample, 1).where(reduce(Column.__or__, enough)).collect()}
    held = sample.sparkSession.sparkContext.broadcast(frozenset(toxic))
    other = {r.unit: r[1:] for r in _tally(sample, 0, held).collect()}
    held.destroy()
    none = (0,) * FOLDS
    return [chosen(*({u: sum(counts.get(u, none)[j] for j in own) for u in toxic} for counts in (toxic, other)), total) for own, total in zip(folds, totals, strict=True)]


def _featured(crossed):
    """Features of a text, by the lexicon that has not seen it, as the bytes of its doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(held) for held in crossed.value]
        for batch in batches:
            x = [np.array(features(t, cores(t), lexicons[f])).tobytes() for f, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["number", "y", "x"])

    return run


def _scored(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(texts), pa.float64())], ["doc_id", "score"])

    return score


def train(documents: DataFrame, labels: DataFrame, rows: int = labelled.FIT_ROWS) -> Model:
    """A model of the labelled sample, whose texts stay with the tasks: the driver gets counts of units, and features."""
    spark = documents.sparkSession
    scratch.small_batches(spark)
    sample = numbered(labelled.sampled(documents, labels, "toxic", BY, HELD_OUT, rows), [F.col(c) for c in ("id", "t", "y")], dealt=1)
    sample = scratch.written(sample.select("number", "y", F.pmod(F.col("number") - 1, F.lit(FOLDS)).cast("int").alias("fold"), "t"), "sample")
    n = {(r.fold, r.y): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    if len({y for _, y in n}) < 2:
        model = _constant(sum(c for (_, y), c in n.items() if y), sum(n.values()))
    else:
        *crossed, lexicon = learn_lexicons(sample, n)
        held = spark.sparkContext.broadcast(crossed)
        found = sorted(sample.mapInArrow(_featured(held), "number long, y int, x binary").collect())
        held.destroy()
        x = np.frombuffer(b"".join(r.x for r in found)).reshape(-1, N_FEATURES)
        model = _fitted(lexicon, x, np.array([r.y for r in found], float))
        del found, x
    scratch.release(sample)
    scratch.give_back()  # what training held goes
    return model


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = labelled.FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; a row for each document."""
    scratch.small_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, rows))
    out = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", (labelled.remainder("doc_id", BY) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(documents: DataFrame, labels: DataFrame, rows: int = labelled.FIT_ROWS) -> DataFrame:
    """The documents, with all their columns, that aren't predicted toxic."""
    from pyspark.sql.functions import pandas_udf

    scratch.small_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, rows))

    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores([t or "" for t in text]))

    return documents.where(score("text") < THRESHOLD)
