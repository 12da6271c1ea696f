"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram's vector binds (multiplies) those of
its letters, permuted by their place in it; a text's vector bundles (sums) its trigrams' vectors. A
language's prototype bundles the texts of a labelled sample. A text gets the language of the
prototype with the largest cosine, after the mean of all prototypes, what languages have in common,
is taken off the prototypes.

Letter classes: a-z after lower-casing, the other letters by their code point, and one class for
everything between words. Runs between words count once, and stand at both ends of a text.

The score is the largest term of a softmax over the cosines, 0 to 1.

Cases: a null text, or one without a letter, is `und` with score 0; so is every text where no
language can be learned; equal cosines take the first language by name; repeated rows get equal
results; a null doc_id is kept and counts as the empty text for held_out; very long texts are read whole;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.labelled import remainder

BY, HELD_OUT, NONE = 3, 1, "und"
DIMENSIONS, CLASSES, SEED = 1024, 64, 20
#: Documents that prototypes are learned from, about, and of each language at least (or all it has).
FIT_ROWS, FIT_EACH = 8_000, 200
#: Cosines are this many times as large as the exponents of the softmax.
SHARPNESS = 40.0
#: Trigrams whose vectors are summed at a time.
BLOCK = 4096


def _class_of(cp: int) -> int:
    c = chr(cp)
    if not c.isalpha():
        return 0
    low = ord(c.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)


class Space:
    """Vectors of letter pairs and letters, and the vectors of texts made from them."""

    def __init__(self):
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))
        self.last = letters
        self.pairs = (np.roll(letters, 2, 1)[:, None] * np.roll(letters, 1, 1)[None]).reshape(-1, DIMENSIONS)
        self.classes = np.array([0 if 0xD800 <= c < 0xE000 else _class_of(c) for c in range(1 << 16)], np.int32)

    def codes(self, text: str) -> np.ndarray:
        """The classes of a text's letters, one 0 between words and at both ends."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        high = cp >= 1 << 16
        cls = self.classes[np.where(high, 0, cp)]
        if high.any():
            cls[high] = [_class_of(c) for c in cp[high].tolist()]
        keep = cls > 0
        keep[1:] |= cls[:-1] > 0
        cls = cls[keep]
        return np.concatenate(([0], cls, [0] if len(cls) and cls[-1] else []))

    def vector(self, text: str) -> np.ndarray | None:
        """The bundle of a text's trigrams; None where it has no letter."""
        c = self.codes(text).astype(np.int64)
        if not c.any():
            return None
        grams, n = np.unique((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], return_counts=True)
        out = np.zeros(DIMENSIONS, np.float32)
        for i in range(0, len(grams), BLOCK):
            g = grams[i : i + BLOCK]
            bound = self.pairs[g // CLASSES] * self.last[g % CLASSES]
            out += n[i : i + BLOCK].astype(np.float32) @ bound.astype(np.float32)
        return out


_SPACE: list[Space] = []


def space() -> Space:
    """One space for each worker."""
    if not _SPACE:
        _SPACE.append(Space())
    return _SPACE[0]


@dataclass
class Model:
    languages: list[str]
    prototypes: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        v = space().vector(text) if text and self.languages else None
        if v is None:
            return NONE, 0.0
        cosines = self.prototypes @ v / (float(np.linalg.norm(v)) or 1.0)
        best = int(cosines.argmax())
        return self.languages[best], float(1 / np.exp(SHARPNESS * (cosines - cosines[best])).sum())


def fit(rows: list[tuple[str, str]]) -> Model:
    """Prototypes from (text, language) rows."""
    sums: dict[str, np.ndarray] = {}
    for text, lang in rows:
        v = space().vector(text)
        if v is not None:
            sums[lang] = sums.get(lang, 0) + v / max(float(np.linalg.norm(v)), 1e-9)
    languages = sorted(sums)
    if not languages:
        return Model([], np.zeros((0, DIMENSIONS)))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    p = unit(np.array([sums[x] for x in languages]))
    return Model(languages, unit(p - p.mean(0)) if len(p) > 1 else p)


def train(documents: DataFrame, rows: int = FIT_ROWS, each: int = FIT_EACH) -> Model:
    """A model from documents outside the held-out remainder that have a language, about `rows` of them.

    A language that is rare among these gives more than its share, so that none is left out.
    """
    known = documents.where(F.col("lang").isNotNull() & (remainder("doc_id", BY) != HELD_OUT)).select("doc_id", "text", "lang")
    sizes = known.groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("size"))  # a row for each language
    total = sum(r["size"] for r in sizes.collect())
    share = F.greatest(F.lit(rows / max(total, 1)), F.lit(float(each)) / F.col("size"))
    known = known.join(F.broadcast(sizes), F.col("lang") == F.col("language"))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) < 1e6 * share)
    found = known.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").collect()
    return fit([(r.text, r.lang) for r in sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, r.text))])


#: Rows of an Arrow batch that are turned into Python objects together.
SLICE = 500


def _labelled(model):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            found = [model.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return label


def identify(documents: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; a row for each document."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, rows))
    out = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_labelled(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (remainder("doc_id", BY) == HELD_OUT).alias("held_out"), "lang_pred", "score")
