"""A bounded sample of labelled documents, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, about; more than these give it nothing new.
FIT_ROWS = 12_000


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo a number; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))) % by


def sampled(documents: DataFrame, labels: DataFrame, label: str, by: int, held_out: int, rows: int = FIT_ROWS) -> DataFrame:
    """(t, y, id): text and label of labelled documents outside the held-out remainder, by a hash of their ids.

    Labels other than 0 and 1 are left out; of repeated ids each label that is given counts once.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(remainder("id", by) != held_out).distinct()
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(label)), F.lit(1_000_000)) < int(1e6 * rows / n))
    known = F.broadcast(known)  # about `rows` rows at most
    return documents.select("doc_id", "text").join(known, F.col("doc_id") == F.col("id")).select(F.coalesce("text", F.lit("")).alias("t"), "y", "id")


def sample(documents: DataFrame, labels: DataFrame, label: str, by: int, held_out: int, rows: int = FIT_ROWS) -> list[tuple[int, str, int]]:
    """(id, text, label) of `sampled`, in order."""
    return sorted((r.id, r.t, r.y) for r in sampled(documents, labels, label, by, held_out, rows).collect())
