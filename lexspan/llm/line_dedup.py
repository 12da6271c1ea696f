"""Deletion of repeated runs of lines, by a distributed suffix array over sequences of line ids.

A document is the sequence of the ids of its lines: their 128-bit hashes. Lines that stand only once
end every repeated run, so that only the islands of repeated lines between them take part; an island
ends with an id of its own, or with the end of its document.

Suffixes get their ranks by prefix doubling, two doublings a round: those of one rank agree in their
first k lines, and each round sorts them, as far as they aren't alone yet, by their rank and those of
the places k, 2k and 3k lines on; a new rank is the number of suffixes of the same first line that come before. The suffix array is the
order by first line and rank. Longest common prefixes of neighbours come from the round that parted
them, which gives them to a factor of two, and from comparing what is left; a suffix whose line before
is that of its neighbour too takes one less than the suffix before it, without a comparison.

Intervals of the array whose prefixes have m lines or more in common are the repeated runs of m lines.
For each suffix two scans over the array, from the left and from the right, give the longest run that
it shares with one that stands earlier, by (doc_id, line). The scans know of the parts of the array
beside theirs only, for each prefix length, the earliest place that shares as much with their edge.
Runs of MIN_WORDS words or more that stand earlier are deleted; the first copy stays.

Cases: null texts stay null and have no lines; an empty text is one empty line; rows of one doc_id, or
without one, stand at the same place, so none of them is the other's copy; rows without a doc_id stand
behind all others; a text all of whose lines go becomes empty, its row stays; overlapping copies within
a document (a line over and over) leave its beginning; very long texts take time in proportion to their
lines; an empty table gives an empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm import scratch

MIN_WORDS = 40
#: Ids of repeated lines, and documents that lose lines, are broadcast up to this many (of about 50 and 100 bytes).
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch that are turned into Python objects together.
SLICE = 500
#: By how much a round prolongs the prefixes that suffixes are sorted by: two doublings at once.
GROWTH = 4
#: Suffixes that a task sorts and scans at a time.
PART_ROWS = 50_000
#: The place of rows without a doc_id.
NOWHERE = (1 << 63) - 1

#: A document is known by its id and a hash of its text; a place by these and the number of the line.
DOC = ["doc", "mark"]
LINES = "doc long, mark long, line int, n_lines int, words int, id binary"


def _identity(documents: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NOWHERE)).alias("doc"), F.xxhash64("text").alias("mark")]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        docs, marks, numbers, sizes, words, ids = [], [], [], [], [], []
        for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            n = len(lines)
            docs.append(np.full(n, doc))
            marks.append(np.full(n, mark))
            sizes.append(np.full(n, n, np.int32))
            numbers.append(np.arange(n, dtype=np.int32))
            words += [len(x.split()) for x in lines]
            ids += map(xxhash.xxh3_128_digest, lines)
        if ids:
            doc, mark, number, size = map(np.concatenate, (docs, marks, numbers, sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(number), pa.array(size), pa.array(words, pa.int32()), pa.array(ids, pa.binary())],
                ["doc", "mark", "line", "n_lines", "words", "id"])


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def islands(documents: DataFrame) -> DataFrame:
    """Places of repeated lines: (doc, mark, line, n_lines, words, id, begin, end) with the ends of their island."""
    scratch.small_batches(documents.sparkSession)
    rows = documents.where(F.col("text").isNotNull()).select(*_identity(documents), "text").mapInArrow(_lines, LINES)
    rows = scratch.written(rows, "lines")
    repeated = scratch.written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    rows = rows.join(_small(repeated), "id", "left_semi").dropDuplicates([*DOC, "line"])
    run = rows.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy(*DOC).orderBy("line")))
    w = Window.partitionBy(*DOC, "island")
    return run.select(*DOC, "line", "n_lines", "words", "id", F.min("line").over(w).alias("begin"), (F.max("line").over(w) + 1).alias("end"))


def _parts(rows: DataFrame) -> int:
    """How many ranges a written table is dealt to; few for a small one, whose tasks and files cost more than its rows."""
    return rows.count() // PART_ROWS + 1


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `number`, their place in a total order, from 0: the place in a sorted range and the sizes of the ranges before."""
    dealt = rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.written(dealt, "sorted")
    part = F.shiftright("at", 33)
    before, total = [], 0
    for r in sorted(dealt.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):  # a row for each range
        before.append((r["part"], total))
        total += r["count"]
    table = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, earlier long"))
    number = F.col("earlier") + F.col("at").bitwiseAND((1 << 33) - 1)
    return dealt.join(table, part == F.col("part")).withColumn("number", number).drop("at", "part", "earlier")


def ranked(places: DataFrame) -> DataFrame:
    """places with rank, among suffixes of one id, alike, how many have that rank, and lines.

    Suffixes share `lines` lines with those of the rank before theirs, but not GROWTH times as many.
    """
    alike = _small(scratch.written(places.groupBy("id").agg(F.count("*").alias("alike")), "alike"))
    state = places.join(alike, "id").withColumn("rank", F.lit(0).cast("long")).withColumn("lines", F.lit(0))
    state = scratch.written(state, "ranks")
    width, steps = 1, range(1, GROWTH)
    key = ["id", "rank", *[f"{c}_{k}" for k in steps for c in ("id", "rank")]]
    # Behind an island stands a line that is nowhere else, with a name of its own, or the end of the text.
    only = F.concat_ws(":", F.lit("only"), *[F.col(c).cast("string") for c in (*DOC, "end")])
    name = F.when(F.col("end") < F.col("n_lines"), only).otherwise(F.lit("")).cast("binary")
    w = Window.partitionBy(*DOC, "begin").orderBy("line")
    while True:
        # A suffix is done when it is alone, or equal to others up to the ends of their documents.
        going = (F.col("alike") > 1) & (F.col("line") + width <= F.col("end"))
        ahead = {f"id_{k}": F.coalesce(F.lead("id", k * width).over(w), F.when(F.col("line") + k * width == F.col("end"), name).otherwise(F.lit(b""))) for k in steps}
        ahead |= {f"rank_{k}": F.coalesce(F.lead("rank", k * width).over(w), F.lit(0).cast("long")) for k in steps}
        act = scratch.written(state.withColumns(ahead).where(going).drop("alike"), "going")
        if act.isEmpty():
            return state
        # A new rank is the old one and the number of suffixes of that which come before.
        act = _numbered(act, [*key, *DOC, "line"])
        pairs = act.groupBy(*key).agg(F.count("*").alias("alike"), F.min("number").alias("start"))
        first = pairs.groupBy("id", "rank").agg(F.min("start").alias("first"))
        pairs = pairs.join(first, ["id", "rank"]).select(*key, "alike", (F.col("start") - F.col("first")).alias("more"))
        new = act.join(_small(scratch.written(pairs, "pairs")), key)  # written, so that a hot pair's rows can be split
        new = new.withColumn("rank", F.col("rank") + F.col("more")).withColumn("lines", F.when(F.col("more") > 0, width).otherwise(F.col("lines")))
        state = scratch.written(state.where(~going).unionByName(new.select(state.columns)), "ranks")
        width *= GROWTH


def suffix_array(places: DataFrame) -> DataFrame:
    """Places in the order of their suffixes: number (from 0), and common, the lines shared with the one before."""
    order = ["id", "rank", *DOC]  # suffixes of one rank are equal to their ends
    array = scratch.written(_numbered(ranked(places).drop("alike"), order), "array")
    last = array.select((F.col("number") + 1).alias("number"), *[F.col(c).alias(f"last_{c}") for c in ("id", "rank", *DOC, "line", "begin", "end")])
    # Of suffixes of one id: the place of the one before, and how many lines they share at least.
    both = array.join(last, "number").where(F.col("id") == F.col("last_id"))
    equal = F.col("rank") == F.col("last_rank")
    both = both.withColumn("common", F.when(equal, F.col("end") - F.col("line")))
    # Where the lines before are the same too, so are the neighbours before: one line more is shared there.
    w = Window.partitionBy(*DOC, "begin").orderBy("line")
    follows = [F.lag(c).over(w) == F.col(c) - k for c, k in (("line", 1), ("last_line", 1), *[(f"last_{c}", 0) for c in DOC])]
    both = scratch.written(both.withColumn("follows", F.coalesce(follows[0] & follows[1] & follows[2] & follows[3], F.lit(False))), "neighbours")
    open_ = both.where(~F.col("follows") & F.col("common").isNull())
    ids = array.groupBy(*DOC, "begin").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "id"))), lambda x: x["id"]).alias("ids"))
    ids = scratch.written(ids, "ids")
    rest = F.least(F.col("lines") * (GROWTH - 1), F.col("end") - F.col("line") - F.col("lines"), F.col("last_end") - F.col("last_line") - F.col("lines"))
    cut = lambda line, begin: F.slice("ids", F.col(line) - F.col(begin) + F.col("lines") + 1, F.greatest(rest, F.lit(0)))
    one = open_.join(ids, [*DOC, "begin"]).withColumn("here", cut("line", "begin")).drop("ids")
    other = ids.select(*[F.col(c).alias(f"last_{c}") for c in (*DOC, "begin")], "ids")
    one = one.join(other, [f"last_{c}" for c in (*DOC, "begin")]).withColumn("there", cut("last_line", "last_begin"))
    same = F.array_position(F.zip_with("here", "there", lambda a, b: a == b), False)
    compared = one.select(*DOC, "line", (F.col("lines") + F.when(same > 0, same - 1).otherwise(F.size("here"))).cast("int").alias("compared"))
    both = both.join(compared, [*DOC, "line"], "left").withColumn("known", F.when(~F.col("follows"), F.coalesce("common", "compared")))
    since = F.last(F.when(F.col("known").isNotNull(), F.struct("known", "line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("s", since).select("number", (F.col("s.known") - (F.col("line") - F.col("s.line"))).cast("int").alias("common"))
    return array.join(both, "number", "left").select("number", *DOC, "line", "n_lines", "words", F.coalesce("common", F.lit(0)).alias("common"))


Place = tuple[int, int]


class Edge:
    """For each number of shared lines the earliest place that shares as many with where a scan stands.

    Kept as places and lengths that both rise: what is later and shares less than another is left out.
    """

    def __init__(self, known: Iterable[tuple[Place, int]] = ()):
        self.places, self.lengths = [], []
        for place, length in sorted(known, key=lambda x: (-x[1], x[0])):
            if not self.places or place < self.places[0]:
                self.places.insert(0, place)
                self.lengths.insert(0, length)

    def narrow(self, common: int) -> None:
        """A neighbour that shares only so many lines comes between."""
        first = None
        while self.lengths and self.lengths[-1] >= common:
            first = self.places.pop()
            self.lengths.pop()
        if first is not None and common:
            self.places.append(first)
            self.lengths.append(common)

    def longest(self, place: Place) -> int:
        """The most lines that an earlier place shares."""
        k = bisect_left(self.places, place)
        return self.lengths[k - 1] if k else 0

    def add(self, place: Place, length: int) -> None:
        k = bisect_left(self.places, place)
        del self.places[k:], self.lengths[k:]
        self.places.append(place)
        self.lengths.append(length)

    def items(self) -> list[tuple[Place, int]]:
        return list(zip(self.places, self.lengths, strict=True))


#: More lines than any two places share.
ALL = (1 << 31) - 1


def _scanned(places: list[Place], common: list[int], edge: Edge) -> list[int]:
    """From left to right, the most lines that each place shares with an earlier one; common: with the one before."""
    out = []
    for place, n in zip(places, common, strict=True):
        edge.narrow(n)
        out.append(edge.longest(place))
        edge.add(place, ALL)
    return out


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """The rows of each part, which come together."""
    held: dict[str, list] = {}
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held["part"][0] != part[a]:
                yield held["part"][0], held
                held = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                held.setdefault(name, []).extend(column.slice(a, b - a).to_pylist())
    if held:
        yield held["part"][0], held


EDGES = "part int, first_common int, least int, side int, doc long, line int, lines int"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a part shows to the parts on its right (side 1) and left (0), and the fewest lines shared within it."""
    for part, x in _columns(batches):
        places, common = list(zip(x["doc"], x["line"], strict=True)), x["common"]
        right, left = Edge(), Edge()
        _scanned(places, common, right)
        _scanned(places[::-1], [0, *common[:0:-1]], left)
        rows = [(part, common[0], min(common[1:], default=ALL), side, *p, n) for side, e in ((1, right), (0, left)) for p, n in e.items()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        names = [c.split()[0] for c in EDGES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _carried(rows: list) -> dict[int, tuple[list, list]]:
    """For each part what the parts on its left and right share with its edges; the right one without the last link."""
    parts: dict[int, tuple[int, int, list, list]] = {}
    for r in rows:
        parts.setdefault(r.part, (r.first_common, r.least, [], []))[2 + r.side].append(((r.doc, r.line), r.lines))
    order = sorted(parts)
    out: dict[int, tuple[list, list]] = {}
    edge: list = []
    for k in order:
        first, least, _, shown = parts[k]
        out[k] = (edge, [])
        edge = Edge(shown + [(p, min(n, first, least)) for p, n in edge if min(n, first, least)]).items()
    edge, link = [], 0
    for k in reversed(order):
        first, least, shown, _ = parts[k]
        edge = [(p, min(n, link)) for p, n in edge if min(n, link)]
        out[k] = (out[k][0], edge)
        edge = Edge(shown + [(p, min(n, least)) for p, n in edge]).items()
        link = first
    return out


def _longest(carried):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _columns(batches):
            places, common = list(zip(x["doc"], x["line"], strict=True)), x["common"]
            left, right = carried.value[part]
            a = _scanned(places, common, Edge(left))
            b = _scanned(places[::-1], [ALL, *common[:0:-1]], Edge(right))[::-1]
            longest = np.maximum(a, b)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[c], pa.int64()) for c in DOC), *(pa.array(x[c], pa.int32()) for c in ("line", "n_lines", "words")), pa.array(longest, pa.int32())],
                [*DOC, "line", "n_lines", "words", "longest"])

    return run


def earlier_runs(documents: DataFrame) -> DataFrame:
    """(doc, mark, line, n_lines, words, longest): for each place the longest run of lines from there that stands earlier too."""
    spark = documents.sparkSession
    array = scratch.written(suffix_array(scratch.written(islands(documents), "islands")), "common")
    n = _parts(array)
    dealt = array.repartitionByRange(n, "number").sortWithinPartitions("number").withColumn("part", F.spark_partition_id())
    dealt = scratch.written(dealt, "parts")
    # Both passes have the same parts; what a part shows is bounded by the lines of the longest run.
    rows = dealt.repartition(n, "part").sortWithinPartitions("part", "number")
    carried = spark.sparkContext.broadcast(_carried(rows.select("part", "doc", "line", "common").mapInArrow(_edges, EDGES).collect()))
    return rows.mapInArrow(_longest(carried), "doc long, mark long, line int, n_lines int, words int, longest int")


def kept_ranges(line: np.ndarray, words: np.ndarray, longest: np.ndarray, n_lines: int, least: int) -> list[tuple[int, int]]:
    """(first, number) of the ranges of lines that no deleted run covers. Lines of a run are all among `line`."""
    order = np.argsort(line)
    line, words, longest = line[order], words[order], longest[order]
    sums = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(line))
    gone = (longest > 0) & (sums[at + longest] - sums[at] >= least)
    change = np.zeros(n_lines + 1, np.int64)
    np.add.at(change, line[gone], 1)
    np.add.at(change, line[gone] + longest[gone], -1)
    kept = np.concatenate(([0], np.cumsum(change[:n_lines]) == 0, [0])).astype(np.int8)
    edges = np.flatnonzero(np.diff(kept))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


CUTS = "doc long, mark long, n_deleted long, kept array<struct<first int, n int>>"


def _cuts(least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            rows = []
            for r in batch.to_pylist():
                line, words, longest = (np.array([p[c] for p in r["places"]], np.int64) for c in ("line", "words", "longest"))
                kept = kept_ranges(line, words, longest, r["n_lines"], least)
                lost = r["n_lines"] - sum(n for _, n in kept)
                if lost:
                    rows.append((r["doc"], r["mark"], lost, [{"first": a, "n": n} for a, n in kept]))
            doc, mark, lost, kept = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, kind)], ["doc", "mark", "n_deleted", "kept"])

    return cut


def cuts(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, mark, n_deleted, kept): of documents that lose lines, the ranges of those that they keep."""
    runs = earlier_runs(documents)
    places = F.collect_list(F.struct("line", "words", "longest")).alias("places")
    each = runs.groupBy(*DOC).agg(F.max("longest").alias("most"), F.max("n_lines").alias("n_lines"), places).where("most > 0")
    return scratch.written(each.select(*DOC, "n_lines", "places").mapInArrow(_cuts(min_words), CUTS), "cuts")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """`documents` with its texts less later copies of runs; with counts, n_lines and n_deleted replace columns of these names."""
    name = {c: scratch.fresh(c) for c in ("doc", "mark", "n_deleted", "kept")}  # documents may have columns of any name
    gone = _small(cuts(documents, min_words)).select(*[F.col(c).alias(n) for c, n in name.items()])
    doc, mark = _identity(documents)
    out = documents.join(gone, (doc == F.col(name["doc"])) & (mark == F.col(name["mark"])), "left")
    lines = F.split("text", "\n", -1)
    rest = F.array_join(F.flatten(F.transform(name["kept"], lambda r: F.slice(lines, r["first"] + 1, r["n"]))), "\n")
    text = F.when(F.col(name["doc"]).isNull(), F.col("text")).otherwise(rest).alias("text")
    kept = [text if c == "text" else documents[c] for c in documents.columns if not counts or c not in ("n_lines", "n_deleted")]
    if not counts:
        return out.select(*kept)
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines")
    return out.select(*kept, n_lines, F.coalesce(F.col(name["n_deleted"]), F.lit(0)).cast("long").alias("n_deleted"))


def digest(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_chars and the text that is left."""
    out = dedup_lines(documents.select("doc_id", "text"), min_words)
    return out.select("doc_id", "n_lines", "n_deleted", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(w) AS w, unnest(l) AS line FROM l),
c AS (SELECT doc_id, i, line, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c, w FROM p),
f AS (SELECT a.doc_id, a.i, min(b.i) AS e FROM c AS a JOIN c AS b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= {MIN_WORDS} GROUP BY ALL),
g AS (SELECT b.doc_id, max(a.i) AS i, b.i AS e FROM c AS a JOIN c AS b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= {MIN_WORDS} GROUP BY b.doc_id, b.i),
r AS (SELECT x.doc_id, x.i, x.e, l.l[x.i:x.e] AS run FROM (SELECT doc_id, i, e FROM f UNION SELECT doc_id, i, e FROM g) AS x JOIN l ON l.doc_id = x.doc_id),
later AS (SELECT doc_id, i, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM r) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM later),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM (SELECT c.* FROM c ANTI JOIN gone USING (doc_id, i)) GROUP BY doc_id)
SELECT d.doc_id, cast(coalesce(len(l.l), 0) AS BIGINT) AS n_lines, cast(coalesce(len(l.l), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_deleted,
  cast(coalesce(length(CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END), 0) AS BIGINT) AS n_chars, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents AS d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
