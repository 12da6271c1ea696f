"""Packing of documents into sequences of bounded length by bin completion.

Documents become pieces: only those longer than a sequence are cut, into full pieces behind a first
one that takes the rest. What matters for the number of sequences is how many pieces there are of
each length, at most one count for each length up to the capacity. The search runs over these counts
on the driver, whatever the number of documents; pieces then take their places by rank among pieces
of their length.

Search: best-fit decreasing gives the first incumbent. Bin completion branches on the fillings around
the largest piece that is left: all undominated ones, of any number of pieces (a filling is dominated
if its pieces fit, as into bins, into the pieces of another), those first that waste little and, at a
price for each piece, keep small pieces for later. A branch ends where its waste exceeds what a better
solution can have; the rest of some nodes is packed by best fit for new incumbents. Discrepancies from
the first filling are allowed one by one, so that a small input is searched to its end. It stops at a
proven lower bound, when all branches are done, or after NODES nodes with the best solution so far.

Cases: a null text counts as empty, which is one piece with the end id; a null doc_id is kept;
repeated rows are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm import scratch, tokens

CAPACITY = 1024
#: Nodes of the search; bounds the driver's time (a few seconds), not the pieces packed.
NODES = 4_000
#: Prices of a piece, in tokens of waste, that fillings are ordered by in one probe after the other.
PRICES = (0, 8, 2)
#: Fillings of each total that are put in order before the others follow.
LOOK = 8
#: At every so many levels of the search the rest is packed by best fit, for a new incumbent.
INCUMBENT_EVERY = 20
#: Runs are broadcast up to this many rows; there are a few for each length.
BROADCAST_ROWS = 200_000

Counts = np.ndarray
#: Lengths of the pieces of a bin, the largest first.
Filling = tuple[int, ...]
#: A filling and in how many bins it occurs.
Run = tuple[Filling, int]


def lower_bound(counts: Counts) -> int:
    """Bins that any packing needs: for each cut-off, large pieces and the space they can't share."""
    cap = len(counts) - 1
    size, best = np.arange(cap + 1), -(-int((counts * np.arange(cap + 1)).sum()) // cap)
    n, s = np.cumsum(counts), np.cumsum(counts * size)
    half = cap // 2
    for k in range(half + 1):
        alone, large = n[cap] - n[cap - k], n[cap - k] - n[half]
        room = large * cap - (s[cap - k] - s[half])
        small = s[half] - (s[k - 1] if k else 0)
        best = max(best, int(alone + large + max(0, -(-(small - room) // cap))))
    return best


def best_fit(counts: Counts) -> list[Run]:
    """Best-fit decreasing over counts: pieces from the largest, each into the fullest bin it fits."""
    cap = len(counts) - 1
    open_bins: dict[int, list[list]] = {}
    residuals = np.zeros(cap + 1, bool)

    def put(filling: tuple[int, ...], bins: int, free: int) -> None:
        open_bins.setdefault(free, []).append([filling, bins])
        residuals[free] = True

    for length in range(cap, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(residuals[length:])
            if len(fits):
                free = int(fits[0]) + length
                filling, bins = open_bins[free].pop()
                residuals[free] = bool(open_bins[free])
            else:
                free, filling, bins = cap, (), left
            each = min(free // length, left)
            used = min(bins, left // each)
            if bins > used and filling:
                put(filling, bins - used, free)
            put(filling + (length,) * each, used, free - each * length)
            left -= used * each
    return [(f, n) for runs in open_bins.values() for f, n in runs]


def n_bins(runs: list[Run]) -> int:
    return sum(n for _, n in runs)


def dominates(a: Filling, b: Filling) -> bool:
    """Whether the pieces of b (the largest first) fit into those of a as bins."""
    room = list(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= b[i] and r not in tried:
                tried.add(r)
                room[j] -= b[i]
                if place(i + 1):
                    return True
                room[j] = r
        return False

    return sum(a) >= sum(b) and (sum(b) <= max(a, default=0) or place(0))


class Sums:
    """Which totals up to a limit can be made of the pieces, and of which."""

    def __init__(self, counts: Counts, limit: int):
        self.counts, self.sizes, self.bits = counts, np.flatnonzero(counts[: limit + 1]).tolist(), []
        mask, made = (1 << (limit + 1)) - 1, 1
        for x in self.sizes:
            for _ in range(min(int(counts[x]), limit // x)):
                made |= made << x
            made &= mask
            self.bits.append(made)  # bit t: sizes up to this one can make t

    def fillings(self, total: int) -> Iterator[Filling]:
        """All fillings of this total, those with the largest pieces first."""
        return self._below(len(self.sizes) - 1, total, ())

    def _below(self, i: int, total: int, own: Filling) -> Iterator[Filling]:
        if not total:
            yield own
            return
        for j in range(min(i, bisect_right(self.sizes, total) - 1), -1, -1):
            if not self.bits[j] >> total & 1:
                return
            x = self.sizes[j]
            for n in range(min(int(self.counts[x]), total // x), 0, -1):
                yield from self._below(j - 1, total - n * x, own + (x,) * n)


def fillings(counts: Counts, free: int, waste: int, price: int) -> Iterator[Filling | None]:
    """The undominated fillings of a free space that leave no more than `waste` of it.

    Those of least waste plus price for each piece come first, as far as the first LOOK of each total
    go; then all others. A filling that another one dominates comes behind it or, as None, not at all.
    """
    if not free or counts[free]:
        yield (free,) if free else ()  # nothing else can be better
        return
    sums, seen, ordered, others = Sums(counts, free), [], [], []

    def undominated(f: Filling) -> bool:
        return not any(g is not f and dominates(g, f) for g in seen)

    for total in range(free, max(free - waste, 0) - 1, -1):
        while ordered and ordered[0][0] <= free - total + price:  # no later one is better
            f = heappop(ordered)[2]
            yield f if undominated(f) else None
        rest = sums.fillings(total)
        for f in islice(rest, LOOK):
            heappush(ordered, (free - total + price * len(f), len(seen), f))
            seen.append(f)
        others.append(rest)
    for f in chain((heappop(ordered)[2] for _ in range(len(ordered))), chain.from_iterable(others)):
        if undominated(f):
            seen.append(f)
            yield f
        else:
            yield None


@dataclass
class Node:
    """A state of the search: counts that are left, what was done (linked), and what is to be tried."""

    rest: Counts
    done: tuple
    bins: int
    waste: int
    largest: int
    options: Iterator[Filling | None]
    #: Discrepancies that are still allowed, from here on.
    turns: int
    #: A filling that was taken as often as it goes, and is still to be tried once.
    again: Filling | None = None


class Search:
    """Bin completion over counts of lengths; `best` is the incumbent."""

    def __init__(self, counts: Counts, nodes: int = NODES):
        self.counts, self.cap = counts.astype(np.int64), len(counts) - 1
        self.total = int((self.counts * np.arange(self.cap + 1)).sum())
        self.bound, self.best, self.nodes = lower_bound(counts), best_fit(counts), nodes
        self.fewest = n_bins(self.best)
        self.proven = self.fewest == self.bound

    def run(self) -> list[Run]:
        probe, limit = self.nodes // len(PRICES), 0
        while not self.proven and self.nodes > 0:
            for price in PRICES:
                self.proven = self.proven or self._probe(price, limit, min(self.nodes, self.nodes if limit else probe))
            limit = 2 * limit + 1
        return self.best

    def _spare(self, waste: int) -> int:
        """What may still be wasted by a solution with fewer bins than the incumbent."""
        return (self.fewest - 1) * self.cap - self.total - waste

    def _enter(self, stack: list[Node], rest: Counts, done: tuple, bins: int, waste: int, turns: int, price: int) -> None:
        self.nodes -= 1
        sizes = np.flatnonzero(rest)
        if not len(sizes) or len(stack) % INCUMBENT_EVERY == INCUMBENT_EVERY - 1:
            more = best_fit(rest)
            if bins + n_bins(more) < self.fewest:
                self.fewest, self.best = bins + n_bins(more), list(more)
                link = done
                while link:
                    link, run = link
                    self.best.append(run)
        if len(sizes) and self._spare(waste) >= 0:
            largest, others = int(sizes[-1]), rest.copy()
            others[largest] -= 1
            stack.append(Node(rest, done, bins, waste, largest, fillings(others, self.cap - largest, self._spare(waste), price), turns))

    def _probe(self, price: int, limit: int, nodes: int) -> bool:
        """Search with up to `limit` discrepancies on a path; whether the incumbent is proven best."""
        stack, cut, least = [], False, self.nodes - nodes
        self._enter(stack, self.counts, (), 0, 0, limit, price)
        while stack and self.fewest > self.bound and self.nodes > least:
            node = stack[-1]
            if node.turns < 0 or self._spare(node.waste) < 0:
                cut = cut or node.turns < 0
                stack.pop()
                continue
            if node.again is not None:
                filling, times, node.again = node.again, 1, None
            else:
                try:
                    f = next(node.options)
                except StopIteration:
                    stack.pop()
                    continue
                if f is None:
                    self.nodes -= 1  # so that looking for fillings is bounded too
                    continue
                filling = (node.largest, *f)
                times = min(int(node.rest[x]) // filling.count(x) for x in set(filling))
                if times > 1 and (len(filling) > 2 or sum(filling) < self.cap):  # else it is right as often as it goes
                    node.again = filling
            node.turns -= 1
            lost = self.cap - sum(filling)
            times = min(times, self._spare(node.waste) // lost) if lost else times
            if times > 0:
                rest = node.rest.copy()
                for x in filling:
                    rest[x] -= times
                self._enter(stack, rest, (node.done, (filling, times)), node.bins + times, node.waste + lost * times, node.turns + 1, price)
        return self.fewest == self.bound or not stack and not cut


def pack(counts: Counts) -> list[Run]:
    """Fillings with their numbers of bins, as few bins as the search finds."""
    return Search(counts).run()


#: Rows of an Arrow batch that are turned into Python objects together.
SLICE = 500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer: str, end_id: int, capacity: int, cache_parts: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, cache_parts)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode(text).astype("<u4"), np.uint32(end_id))
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(pairwise(cuts))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, cache_parts: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces of all documents."""
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, capacity, cache_parts), PIECES)


def ranked(rows: DataFrame) -> DataFrame:
    """`rows` with `rank`, from 0, among the rows of the same length; no length meets in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    sums = dealt.groupBy("length", "slot").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "slot", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "start"))
    out = dealt.withColumn("own", own).join(sums, ["length", "slot"])
    return out.withColumn("rank", F.col("before") + F.col("own") - 1).drop("slot", "own", "before")


def places(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, sequence, offset): ranks lo to hi - 1 of a length go to the sequences from one on."""
    out, taken, sequence = [], {}, 0
    for filling, n in runs:
        offset = 0
        for x in filling:
            lo = taken.get(x, 0)
            out.append((x, lo, lo + n, sequence, offset))
            taken[x] = lo + n
            offset += x
        sequence += n
    return out


def best_fit_pack(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, cache_parts: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; a row for each piece. cache_parts: words whose ids a worker keeps."""
    spark = documents.sparkSession
    scratch.small_batches(spark)
    cut = scratch.written(pieces(documents, tokenizer, end_id, capacity, cache_parts), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # a row for each length up to the capacity
        counts[r["length"]] = r["count"]
    where = places(pack(counts))
    table = spark.createDataFrame(where, "length long, lo long, hi long, first long, offset long")
    table = F.broadcast(table) if len(where) <= BROADCAST_ROWS else table
    here = ranked(cut).join(table, "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return here.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
