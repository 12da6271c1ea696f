"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text is the sequence of its words (runs of digits, letters a-z after A-Z are lower-cased, and
anything beyond ASCII). A *window* is 10 consecutive words of an item; a shorter item that has words
is one window. A word of a document is *hit* if it lies in an occurrence of a window.

Winnowing: of 6 consecutive 5-gram hashes the smallest is kept, on both sides. A shared span of
6 + 5 - 1 = 10 words has the same six 5-grams on both sides, hence a common fingerprint: no shared
span of 10 words is missed. Each common fingerprint is extended word by word, at most 5 words to
either side; where 10 or more words agree, they are hits. A window that holds the fingerprint lies
within that reach, so the extensions cover every occurrence.

On the document side each position is looked up among the fingerprints of the items first, and is
then tested for being a window minimum; that is the same join with its two predicates swapped, and
saves hashing windows that hold no fingerprint of any item.

Cases: null or empty texts have no words and no hits; a document of fewer than 10 words can still be
hit by a short item; repeated rows each get their own result; an empty benchmark leaves every
document clean; an empty document table gives an empty result; a null doc_id is kept, and rows of one
doc_id, or without one, go together where contaminated ones go; a very long text is one array of words;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm import scratch

SPAN, K = 10, 5
#: Consecutive k-grams of which the smallest is kept, so that SPAN words are always caught.
WINDOW = SPAN - K + 1
REACH = SPAN - K
#: Item fingerprints are broadcast up to this many rows (of about 300 bytes); beyond, the join shuffles.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _gram(words: Column, at: Column | int) -> Column:
    """Hash of the K words from a position; null where they reach past the end."""
    parts = [F.get(words, F.lit(at) + i) for i in range(K)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(*parts))


def _around(words: Column, at: Column) -> Column:
    """The K words at a position with REACH words before and after; nulls stand before the first."""
    before = F.array_repeat(F.lit(None).cast("string"), F.greatest(REACH - at, F.lit(0)))
    return F.concat(before, F.slice(words, F.greatest(at - REACH, F.lit(0)) + 1, F.least(at, F.lit(REACH)) + K + REACH))


def _run(flags: Column) -> Column:
    """How many leading elements of an array of booleans hold."""
    first = F.array_position(flags, False)
    return F.when(first == 0, F.size(flags)).otherwise(first.cast("int") - 1)


def _kept(around: Column) -> Column:
    """Whether the k-gram amid these words is the smallest of some window of consecutive k-grams."""
    own = _gram(around, REACH)
    grams = F.transform(F.sequence(F.lit(0), F.lit(2 * REACH)), lambda i: F.when(F.get(around, i).isNotNull(), _gram(around, i)))
    least = F.transform(grams, lambda g: F.coalesce(g >= own, F.lit(False)))
    return _run(F.reverse(F.slice(least, 1, REACH))) + _run(F.slice(least, REACH + 2, REACH)) + 1 >= WINDOW


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """(fp, item_id, ctx): winnowed k-grams of items, with REACH words before and after each."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("iw")).where(F.size("iw") >= SPAN)
    rows = items.withColumn("iq", F.explode(F.sequence(F.lit(0), F.size("iw") - K)))
    rows = rows.select("item_id", _gram(F.col("iw"), F.col("iq")).alias("fp"), _around(F.col("iw"), F.col("iq")).alias("ctx"))
    return rows.where(_kept(F.col("ctx"))).distinct()


def short_items(benchmark: DataFrame) -> DataFrame:
    """(first, item_id, whole): items of fewer words than a span, each being one window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("whole"))
    short = items.where((F.size("whole") > 0) & (F.size("whole") < SPAN))
    return short.select(F.xxhash64(F.get(F.col("whole"), F.lit(0))).alias("first"), "item_id", "whole").distinct()


def _bounded(df: DataFrame) -> tuple[DataFrame, int]:
    n = df.count()
    return (F.broadcast(df) if n <= BROADCAST_ROWS else df), n


HIT = "struct<item:string,lo:int,hi:int>"


def _extended(rows: DataFrame) -> Column:
    """The hit of a row whose 5-gram is an item's fingerprint: the words that agree around it."""
    same = F.zip_with("mine", "ctx", lambda a, b: F.coalesce(a == b, F.lit(False)))
    left = _run(F.reverse(F.slice(same, 1, REACH)))
    right = _run(F.slice(same, REACH + K + 1, REACH))
    whole = F.forall(F.slice(same, REACH + 1, K), lambda x: x)
    ok = F.col("mine").isNotNull() & whole & (left + right + K >= SPAN) & _kept(F.col("mine"))
    lo, hi = F.col("at") - left, F.col("at") + K - 1 + right
    return F.when(ok, F.struct(F.col("long_item").cast("string").alias("item"), lo.alias("lo"), hi.alias("hi"))).cast(HIT)


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for each document."""
    fingerprints, n_long = _bounded(item_fingerprints(benchmark))
    shorts, n_short = _bounded(short_items(benchmark))
    w, at = F.col("w"), F.col("at")
    base = documents.select("doc_id", words_of(F.col("text")).alias("w"))
    base = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "w")
    # One row for each word position, and one at -1 that stands for the document itself.
    last = F.size("w") - 1 if n_short else F.greatest(F.size("w") - K, F.lit(-1)) if n_long else F.lit(-1)
    rows = base.withColumn("at", F.explode(F.sequence(F.lit(-1), last)))
    keep, columns = at < 0, [F.when(at < 0, F.size("w")).alias("size"), "rid", "doc_id", "at"]
    if n_long:
        rows = rows.withColumn("g", F.when(at >= 0, _gram(w, at)))
        rows = rows.join(fingerprints.withColumnRenamed("item_id", "long_item"), F.col("g") == F.col("fp"), "left")
        keep |= F.col("fp").isNotNull()
        columns += ["long_item", "ctx", F.when(F.col("fp").isNotNull(), _around(w, at)).alias("mine")]
    if n_short:
        rows = rows.withColumn("f", F.when(at >= 0, F.xxhash64(F.get(w, at))))
        rows = rows.join(shorts, F.col("f") == F.col("first"), "left")
        n = F.size("whole")
        is_whole = F.slice(w, at + 1, n) == F.col("whole")
        hit = F.struct(F.col("item_id").cast("string").alias("item"), at.alias("lo"), (at + n - 1).alias("hi"))
        columns.append(F.when(F.col("first").isNotNull() & (at >= 0), F.when(is_whole, hit)).cast(HIT).alias("short_hit"))
        keep |= F.col("first").isNotNull()
    rows = rows.where(keep).select(*columns)
    found = [_extended(rows)] * bool(n_long) + [F.col("short_hit")] * bool(n_short)
    hits = F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{HIT}>")
    # No filter on hits here: it would be pushed below, and take the lookup out of generated code.
    rows = rows.select("rid", "doc_id", "size", hits.alias("hits"))
    per = rows.groupBy("rid", "doc_id").agg(
        F.max("size").cast("long").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["lo"], h["hi"]))))
    return per.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that no window of an item occurs in."""
    key = scratch.fresh("hit")  # documents may have columns of any name
    hit = decontaminate(documents, benchmark).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    hit = scratch.written(hit, "hit")
    hit, _ = _bounded(hit)
    return documents.join(hit, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


ORACLE_SQL = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + least(len(w), {SPAN}) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SPAN - 1}, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
pos AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT len(g) AS m FROM win) AS ms),
hit AS (SELECT pos.doc_id, pos.i, pos.m, win.item_id FROM pos JOIN win ON w[i:i + m - 1] = win.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
