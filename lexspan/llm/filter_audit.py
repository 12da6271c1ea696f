"""How filters interact, by a Walsh-Hadamard audit.

A document's *mask* has a bit for each filter that it fails. For every set S of filters the signed
parity sum of a part and a label is the sum of (-1)^|mask & S| over their documents: 32 sums for five
filters. These 32 sums are all that is gathered; the transform is its own inverse up to the factor 32,
so that they give back, exactly, how many documents have each mask. Any order of the filters is then
read off these cells, and so are Shapley values: over all orders, a document is removed by each of
the k filters that it fails equally often, which is orders/k times.

The filters of `FILTERS` look at a text alone. One more fails documents whose text stands in a row of
a smaller doc_id, anywhere in the table: the smallest doc_id of each text is found by a digest of the
text, with partial sums before the shuffle, and rows are joined with it by digest and doc_id, so that
no group of copies meets in a task.

Cases: a null text is an empty one, which has 0 words, passes B, C and D and can be a copy of other
empty ones; a null lang is the part ''; a row without a doc_id neither is a copy nor makes others
copies; repeated rows of one doc_id count each, and aren't copies of each other; of several labels of
a document any 1 counts, and labels of no document, or null ones, count nothing; an empty table gives
no rows; a very long text is one array of words in one task; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm import scratch

#: White space other than the space, which separates words.
BREAKS = "\t\n\x0b\x0c\r"
LEAST_WORDS = 100
#: Labels are broadcast up to this many rows, of about 20 bytes.
BROADCAST_ROWS = 200_000


def features(text: Column) -> dict[str, Column]:
    """The words of a text, its capitals and its marks."""
    words = F.array_remove(F.split(F.translate(text, BREAKS, " " * len(BREAKS)), " "), "")
    return {"words": words, "capitals": F.regexp_count(text, F.lit("[A-Z]")), "marked": text.rlike(r"[#$%&*|]"), "points": F.length(text)}


#: What fails each filter, over the columns of `features` with n words, `different` ones of them.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n") < LEAST_WORDS,
    "B": lambda: 100 * F.col("different") < 80 * F.col("n"),
    "C": lambda: 100 * F.col("capitals") > 10 * F.col("points"),
    "D": lambda: F.col("marked"),
}
COPY = "E"
LETTERS = "".join(FILTERS) + COPY


def text_failures(documents: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and in `mask` a bit for each of FILTERS that the text fails."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    seen = features(F.col("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in seen.items()])
    rows = rows.select("*", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different"))
    bits = sum((F.when(fails(), 1 << i).otherwise(0) for i, fails in enumerate(f for f in FILTERS.values())), F.lit(0))
    return rows.select("doc_id", "part", "digest", bits.cast("int").alias("mask"))


def with_copies(rows: DataFrame) -> DataFrame:
    """rows, the bit of COPY set where a row of a smaller doc_id has the same text."""
    first = rows.where("doc_id is not null").groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    both = rows.join(first, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return both.select("doc_id", "part", F.when(copy, F.col("mask") + (1 << len(FILTERS))).otherwise(F.col("mask")).alias("mask"))


def label_flags(labels: DataFrame) -> DataFrame:
    """id, good, toxic: a row for each labelled document; broadcast where it is small."""
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return F.broadcast(rows) if labels.count() <= BROADCAST_ROWS else rows


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every document."""
    # Read twice, for the smallest ids and for the rows: written, so that texts are read once.
    rows = with_copies(scratch.written(text_failures(documents), "failures"))
    flags = label_flags(labels)
    rows = rows.join(flags, F.col("doc_id") == F.col("_id"), "left")
    return rows.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def sign(a: Column, b: Column | int) -> Column:
    """(-1)^|a & b|"""
    return F.lit(1) - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(rows: DataFrame, k: int) -> DataFrame:
    """part, label, sums: the 2^k signed parity sums of all documents, of good and of toxic ones."""
    label = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")))
    each = rows.select("part", "mask", F.explode(label).alias("label"))
    sums = each.groupBy("part", "label").agg(*[F.sum(sign(F.col("mask"), s)).alias(f"s{s}") for s in range(1 << k)])
    return sums.select("part", "label", F.array(*[F.col(f"s{s}") for s in range(1 << k)]).alias("sums"))


def mask_cells(sums: DataFrame, k: int) -> DataFrame:
    """part, label, cells: how many documents have each mask; the transform of the sums, divided by 2^k without remainder."""
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    one = lambda m: F.shiftright(F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + F.get("sums", s) * sign(m, s)), k)  # noqa: E731
    return sums.select("part", "label", F.transform(every, one).alias("cells"))


def _count(cells: Column | str, holds: Callable[[Column], Column], times: Callable[[Column], Column] | None = None) -> Column:
    """The sum of the cells whose mask holds, each so many times."""
    own = F.transform(cells, lambda n, m: F.when(holds(m), n * times(m) if times else n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """Counts after each step of each order of the filters, and Shapley values; a part has k! * k rows."""
    k = len(letters)
    zeros = F.array_repeat(F.lit(0).cast("long"), 1 << k)
    parts = cells.groupBy("part").agg(*[F.coalesce(F.any_value(F.when(F.col("label") == c, F.col("cells")), True), zeros).alias(c) for c in ("all", "good", "toxic")])
    bits = {letter: 1 << i for i, letter in enumerate(letters)}
    each = [F.struct(F.lit("".join(o)).alias("name"), F.array(*[F.lit(bits[x]) for x in o]).alias("bits")) for o in permutations(letters)]
    rows = parts.withColumn("o", F.explode(F.array(*each)))
    rows = rows.select("part", "all", "good", "toxic", "o", F.posexplode("o.bits").alias("at", "bit"))
    rows = rows.withColumn("before", F.aggregate(F.slice("o.bits", F.lit(1), F.col("at")), F.lit(0), lambda a, x: a + x))
    own, before = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    removed = lambda m: own(m) & ~before(m)  # noqa: E731
    return rows.select(
        "part", F.col("o.name").alias("filter_order"), (F.col("at") + 1).alias("step"),
        _count("all", lambda m: ~own(m) & ~before(m)).alias("kept"), _count("all", removed).alias("removed"),
        _count("all", lambda m: own(m) & before(m)).alias("redundant"), F.get("all", "bit").alias("unique_fails"),
        _count("good", removed).alias("good_lost"), _count("toxic", removed).alias("toxic_lost"),
        _count("all", own, lambda m: (factorial(k) / F.bit_count(m)).cast("long")).alias("shapley"))


def filter_interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    k = len(LETTERS)
    return orders(mask_cells(parity_sums(masks(documents, labels), k), k), LETTERS)


_LETTER = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(LETTERS))
_NAMES = [f"l{i}" for i in range(len(LETTERS))]
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-]+') AS words FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES {_LETTER}),
o AS (SELECT {' || '.join(f'{x}.letter' for x in _NAMES)} AS filter_order FROM {', '.join(f'f AS {x}' for x in _NAMES)}
  WHERE {' AND '.join(f'{a}.letter <> {b}.letter' for i, a in enumerate(_NAMES) for b in _NAMES[:i])}),
s AS (SELECT filter_order, step, bit, (SELECT coalesce(sum(g.bit), 0) FROM f AS g WHERE instr(filter_order, g.letter) < step)::INTEGER AS before
  FROM (SELECT filter_order, unnest(range(1, {len(LETTERS) + 1})) AS step FROM o) JOIN f ON substring(filter_order, step, 1) = letter)
SELECT part, filter_order, cast(step AS INTEGER) AS step,
  cast(coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0) AS BIGINT) AS kept,
  cast(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
  cast(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
  cast(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  cast(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
  cast(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
  cast(coalesce(sum(n * {factorial(len(LETTERS))} // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step, bit, before
"""
