"""Packing of documents into sequences as they come, with a bounded number of open windows.

Each partition keeps `WINDOWS` open windows. What is left of a document goes whole into the fullest
window that has room for it; if none has, into a new window while fewer are open, else the fullest
window is filled with the document's first ids and emitted, and the rest is placed in the same way.
A document of a sequence's length or more fills sequences of its own first. So every emitted sequence
is full, a partition holds no more than its windows, and whatever it emits is settled.

Windows that are still open when a partition ends are merged: those of `FAN` partitions at a time are
packed anew by the same rule, round after round, until one group is left, whose windows are filled from
one another. What then remains is less than a sequence; it is cut into lengths that are powers of two,
which need no padding.

Cases: a null text is an empty one, which is the end id alone; a null doc_id is kept; repeated rows are
packed each; a very long text is cut where sequences end, nothing of it is dropped; documents that fit
several windows equally go into the one that was opened first; an empty table gives no sequences; other
columns are ignored. The order of rows within a partition decides which of equally good packings results.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm import scratch, tokens
from lexspan.stored import spread

CAPACITY = 2048
#: Open windows of a partition: at most so many times CAPACITY ids are held by a task.
WINDOWS = 64
#: Partitions whose open windows are merged by one task.
FAN = 64
#: Rows of an Arrow batch that are turned into Python objects together, and sequences that are given out together.
SLICE, BLOCK = 500, 500

#: doc_id, start, ids, and the number of all ids of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class Windows:
    """Open windows of one partition; `put` gives out the sequences that it fills."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.opened = capacity, most, 0
        self.free: list[tuple[int, int]] = []  # (room, number) of each open window, in this order
        self.pieces: dict[int, list[Piece]] = {}

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        doc, start, ids, total = piece
        at = 0
        while len(ids) - at >= self.capacity:
            yield [(doc, start + at, ids[at : at + self.capacity], total)]
            at += self.capacity
        while at < len(ids):
            n = len(ids) - at
            k = bisect_left(self.free, (n, -1))  # the least room that suffices
            if k == len(self.free) and len(self.free) < self.most:
                self.opened += 1
                self.pieces[self.opened] = []
                insort(self.free, (self.capacity, self.opened))
                k = bisect_left(self.free, (n, -1))
            elif k == len(self.free):
                k = 0  # the fullest, which has less room than is asked for
            room, window = self.free.pop(k)
            n = min(n, room)
            self.pieces[window].append((doc, start + at, ids[at : at + n], total))
            at += n
            if n == room:
                yield self.pieces.pop(window)
            else:
                insort(self.free, (room - n, window))

    def rest(self) -> Iterator[list[Piece]]:
        """What is still open, the fullest first."""
        for _, window in self.free:
            yield self.pieces[window]


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def filled(windows: list[list[Piece]], capacity: int) -> Iterator[list[Piece]]:
    """All pieces, one behind the other: full sequences, and the rest in powers of two."""
    pieces = [p for w in windows for p in w]
    total = sum(len(p[2]) for p in pieces)
    own: list[Piece] = []
    rooms = iter([capacity] * (total // capacity) + powers(total % capacity))
    room = next(rooms, 0)
    for doc, start, ids, n in pieces:
        at = 0
        while at < len(ids):
            k = min(room, len(ids) - at)
            own.append((doc, start + at, ids[at : at + k], n))
            at, room = at + k, room - k
            if not room:
                yield own
                own, room = [], next(rooms, 0)


PIECE = "struct<doc_id:bigint,start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,offset:bigint>"
#: A row for each sequence; `ids` are little-endian unsigned 32-bit integers.
SEQUENCES = f"sequence_id long, part int, open boolean, n_tokens int, pieces array<{PIECE}>, ids binary"
_PIECE = pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")])
_KINDS = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(_PIECE), pa.binary()]
_NAMES = ["sequence_id", "part", "open", "n_tokens", "pieces", "ids"]


def _rows(sequences: Iterator[tuple[list[Piece], bool]], first: int, part: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (sequence, still open); ids stay with what is open, or with all."""

    def row(k: int, pieces: list[Piece], is_open: bool) -> tuple:
        data = [p[2].tobytes() for p in pieces]
        ends = np.cumsum([len(p[2]) for p in pieces])
        own = [{"doc_id": d, "start": s, "length": len(ids), "ids_crc32": zlib.crc32(b), "doc_tokens": n, "offset": int(e) - len(ids)} for (d, s, ids, n), b, e in zip(pieces, data, ends, strict=True)]
        return first + k, part, is_open, int(ends[-1]), own, b"".join(data) if keep_ids or is_open else None

    rows = []
    for k, (pieces, is_open) in enumerate(sequences):
        rows.append(row(k, pieces, is_open))
        if len(rows) == BLOCK:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _first_id(turn: int, part: int) -> int:
    """Sequence ids of a task begin here: 2^28 for each of 2^28 tasks of a round."""
    return (turn << 56) + (part << 28)


def _packed(tokenizer: str, end_id: int, capacity: int, windows: int, keep_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, own = tokens.encoder(tokenizer), TaskContext.get().partitionId(), Windows(capacity, windows)
        end = np.uint32(end_id)

        def sequences() -> Iterator[tuple[list[Piece], bool]]:
            for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.append(encoder.encode(text).astype("<u4"), end)
                    for full in own.put((doc, 0, ids, len(ids))):
                        yield full, False
            for rest in own.rest():
                yield rest, True

        yield from _rows(sequences(), _first_id(0, part), part, keep_ids)

    return pack


def _merged(turn: int, capacity: int, windows: int, keep_ids: bool, last: bool):
    """Pack the open windows of a group anew; the last group leaves nothing open."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own.setdefault(r["group"], []).append(r)

        def sequences(rows: list[dict]) -> Iterator[tuple[list[Piece], bool]]:
            packed = Windows(capacity, windows)
            for r in sorted(rows, key=lambda r: (-r["n_tokens"], r["sequence_id"])):
                ids = np.frombuffer(r["ids"], "<u4")
                for p in r["pieces"]:
                    for full in packed.put((p["doc_id"], p["start"], ids[p["offset"] : p["offset"] + p["length"]], p["doc_tokens"])):
                        yield full, False
            for rest in filled(list(packed.rest()), capacity) if last else packed.rest():
                yield rest, not last

        for group, rows in sorted(own.items()):
            yield from _rows(sequences(rows), _first_id(turn, group), group, keep_ids)

    return merge


def online_pack(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, windows: int = WINDOWS, keep_ids: bool = True) -> DataFrame:
    """sequence_id, n_tokens, pieces, ids (null without keep_ids): a row for each sequence."""
    scratch.small_batches(documents.sparkSession)
    rows = spread(documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    found = scratch.written(rows.mapInArrow(_packed(tokenizer, end_id, capacity, windows, keep_ids), SEQUENCES), "windows")
    done, groups, turn = [found.where("not open")], found.where("open").agg(F.max("part")).first()[0], 0
    left = found.where("open")
    while groups is not None:
        turn, groups = turn + 1, groups // FAN
        dealt = left.withColumn("group", F.floor(F.col("part") / FAN).cast("int")).repartition(min(groups + 1, scratch.parts(left, 1 << 30)), "group")
        found = scratch.written(dealt.mapInArrow(_merged(turn, capacity, windows, keep_ids, groups == 0), SEQUENCES), "merged")
        done.append(found.where("not open"))
        left = found.where("open")
        groups = groups or None
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("sequence_id", "n_tokens", "pieces", "ids")


def placed(sequences: DataFrame) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = sequences.select("sequence_id", F.explode("pieces").alias("p"))
    return rows.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def padding(sequences: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and the padding that they need, none where the length is a power of two."""
    n = F.col("n_tokens")
    full = F.when(F.bit_count(n) == 1, n).otherwise(F.lit(capacity))
    return sequences.agg(F.count("*").alias("sequences"), F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.coalesce(F.sum(full - n), F.lit(0)).alias("padding"))
