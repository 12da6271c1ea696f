"""How the sources of a language diverge in their terms: shards by language and term, counted by DuckDB.

A *group* is a language and one of its sources. Every kept term of a language has a share p in each of
its groups, a whole number in parts of 10^9 with five added to each count, and f is the distance of two
shares. A group's distance from another one is the sum of f over all kept terms.

1. Each task splits its documents into terms and counts them with DuckDB, in blocks of bounded size;
   what it hands on has one row for each group and term.
2. These rows are dealt to shards by a hash of language and term. A shard adds them up with DuckDB and
   keeps the terms with enough documents. Spark adds the totals of groups and languages.
3. Each shard gives, by DuckDB, partial sums for pairs of groups and the ranks of its own terms; Spark
   adds the sums of all shards and ranks again what the shards ranked first.

A term that one or both groups of a pair lack has a share there too, the same for all such terms of a
group. So a shard sums only over terms that both groups have (by how much f differs from what follows
if the other group lacked the term); for what a group has alone, its numbers of terms of each count,
which Spark adds up, are enough. No shard needs rows for what isn't there.

All arithmetic is on whole numbers, of 128 bits where a product needs them.

Cases: null text, lang and source count as ''; a document without terms still makes its group occur; a
language without kept terms has pairs of value 0; a source alone in its language has no pairs; repeated
rows are documents of their own and doc_id plays no part; ties go by the bytes of the item; an empty
table gives no rows; a very long text is split in one block; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm import scratch

LEAST_DOCUMENTS = 30
#: Added to each count.
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Bytes of text that a task splits at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Rows that a task counts before it hands them on.
PARTIAL_ROWS = 300_000
#: Pairs of groups that a shard sums at once.
PAIRS = 1_000_000
#: Bytes of documents for each shard.
SHARD_BYTES = 32 << 20
#: Parts in which a group's candidates for the ranking are ranked first.
RANKING_PARTS = 32
#: Groups are broadcast up to this many.
BROADCAST_ROWS = 200_000

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long"
#: Bytes that stand in a term, A-Z as a-z; all others are spaces. Bytes from 0x80 on are parts of letters.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def connection():
    """DuckDB for one task: one thread, in memory, no files."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": "", "preserve_insertion_order": False})


def blocks(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """lang, source, doc and text, the letters of a text in lower case and all else as spaces, in parts of bounded size."""
    texts = batch.column("text")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        own = bytes(memoryview(data)[at[first] : at[end]] if data else b"").translate(LETTERS)
        text = pa.StringArray.from_buffers(end - first, pa.py_buffer((at[first : end + 1] - at[first]).astype(np.int32)), pa.py_buffer(own))
        rest = [batch.column(c).slice(first, end - first) for c in ("lang", "source")]
        yield pa.table([*rest, pa.array(np.arange(end - first)), text], ["lang", "source", "doc", "text"])
        first = end


_COUNT = """INSERT INTO counted
SELECT lang, source, term, sum(n)::BIGINT, count(*) FROM (
  SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(string_split(text, ' ')) AS term FROM block)
  WHERE term <> '' GROUP BY lang, source, doc, term) GROUP BY lang, source, term"""
_ADD = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM {} GROUP BY lang, source, term"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = connection()
    con.execute("CREATE TABLE counted (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")

    def hand_on() -> Iterator[pa.RecordBatch]:
        yield from con.sql(_ADD.format("counted")).to_arrow_reader(50_000)
        con.execute("TRUNCATE counted")

    rows = 0
    for batch in batches:
        for block in blocks(batch):
            rows += con.execute(_COUNT).fetchall()[0][0]
            if rows > PARTIAL_ROWS:
                yield from hand_on()
                rows = 0
    yield from hand_on()


def _kept(least: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.RecordBatchReader.from_batches(_schema(COUNTS), batches)
        con = connection()
        con.execute(f"CREATE TABLE summed AS {_ADD.format('rows')}")
        yield from con.sql(f"""SELECT lang, source, term, n FROM summed
            SEMI JOIN (SELECT lang, term FROM summed GROUP BY lang, term HAVING sum(docs) >= {least}) AS kept USING (lang, term)""").to_arrow_reader(50_000)

    return keep


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, {"string": pa.string(), "long": pa.int64()}[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def kept_counts(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n: how often each kept term stands in each group that has it."""
    scratch.small_batches(documents.sparkSession)
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    shards = scratch.parts(rows, SHARD_BYTES)
    return rows.mapInArrow(_counted, COUNTS).repartition(shards, "lang", "term").mapInArrow(_kept(least), KEPT)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term that stands n times among `total`; null for a language without terms."""
    wide = lambda c: c.cast("decimal(26,0)")
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + SMOOTHING), wide(total + SMOOTHING * terms))
    return F.when(terms > 0, 1 + share)


PAIR = "lang string, source string, part string, item string, value long"
_DISTANCE = "abs(a.p - b.p) - abs(a.p - b.p0) - abs(b.p - a.p0) + abs(a.p0 - b.p0)"


def _partial(top: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.RecordBatchReader.from_batches(_schema("lang string, source string, term string, n long, p long, p0 long, total long, terms long"), batches)
        con = connection()
        con.execute("CREATE TABLE x AS SELECT * FROM rows")
        yield from con.sql(f"""SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM (
              SELECT x.*, 1 + ({SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + {SMOOTHING}) // (total + {SMOOTHING} * terms))::BIGINT AS q FROM x)
            WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}""").to_arrow_reader(50_000)
        con.execute("CREATE TABLE s AS SELECT lang, source, row_number() OVER () - 1 AS k FROM (SELECT DISTINCT lang, source FROM x)")
        groups = con.execute("SELECT count(*) FROM s").fetchall()[0][0]
        each = max(1, PAIRS // max(groups, 1))  # so many groups at once, each with all others
        for lo in range(0, groups, each):
            yield from con.sql(f"""SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum({_DISTANCE})::BIGINT AS value
                FROM (SELECT x.* FROM x SEMI JOIN (SELECT * FROM s WHERE k >= {lo} AND k < {lo + each}) AS own USING (lang, source)) AS a
                JOIN x AS b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL""").to_arrow_reader(50_000)

    return partial


def source_divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each group's distances from others, and the terms it has more of than its language."""
    kept = scratch.written(kept_counts(documents, least), "kept")
    occurring = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(F.broadcast(terms), "lang", "left")  # a row for each language
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("group_n"), F.coalesce("terms", F.lit(0)).alias("terms"))
    whole = groups.groupBy("lang").agg(F.sum("group_n").alias("total"))
    groups = groups.join(F.broadcast(whole), "lang").withColumn("p0", _share(F.lit(0), F.col("group_n"), F.col("terms")))
    groups = scratch.written(groups, "groups")
    small = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups

    rows = kept.join(small, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("group_n"), F.col("terms")))
    dealt = rows.select("lang", "source", "term", "n", "p", "p0", "total", "terms").repartition(scratch.parts(kept, SHARD_BYTES), "lang", "term")
    shown = scratch.written(dealt.mapInArrow(_partial(top), PAIR), "partial")

    both = shown.where("part = 'pair'")
    both = both.select("lang", "source", "item", "value").union(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = both.union(_alone(kept, groups, small)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # What shards ranked first is ranked again in a few parts of a group, so that no group's candidates meet at once.
    share = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(RANKING_PARTS))).orderBy(F.col("value").desc(), "item")
    terms = shown.where("part = 'term'").withColumn("own", F.row_number().over(share)).where(F.col("own") <= top).drop("own")
    found = pairs.withColumn("part", F.lit("pair")).unionByName(terms)
    w = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = found.withColumn("rank", F.row_number().over(w)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _alone(kept: DataFrame, groups: DataFrame, small: DataFrame) -> DataFrame:
    """lang, source, item, value: the distance of each pair of groups if they had no term in common, in two directed halves each."""
    # How many terms a group has of each count: as many rows as there are different counts.
    each = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    each = each.groupBy("lang", "source").agg(F.collect_list(F.struct("n", "m")).alias("counts"))
    mine = groups.join(each, ["lang", "source"], "left").withColumn("counts", F.coalesce("counts", F.array().cast("array<struct<n:bigint,m:bigint>>")))
    mine = mine.select("lang", "source", "group_n", "terms", "p0", F.transform("counts", lambda c: F.struct(_share(c["n"], F.col("group_n"), F.col("terms")).alias("p"), c["m"].alias("m"))).alias("counts"))
    other = small.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    rows = mine.join(other, "lang").where(F.col("source") != F.col("item"))
    apart = F.abs(F.col("p0") - F.col("q0"))
    own = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["m"] * (F.abs(c["p"] - F.col("q0")) - apart))
    rows = rows.select("lang", "source", "item", F.coalesce(own, F.lit(0)).alias("own"), F.coalesce(F.col("terms") * apart, F.lit(0)).alias("none"))
    there = rows.select("lang", "source", "item", (F.col("own") + F.col("none")).alias("value"))
    back = rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("value"))
    return there.union(back)


_P = f"cast(1 + ({SCALE}::HUGEINT * ({{}} + {SMOOTHING})) // ({{}} + {SMOOTHING} * terms) AS BIGINT)"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept ON g.lang = kept.lang
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL) AS c ON g.lang = c.lang AND g.source = c.source AND kept.term = c.term),
tot AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own, sum(n) OVER (PARTITION BY lang) AS whole, sum(n) OVER (PARTITION BY lang, term) AS here FROM dense),
v AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
p AS (SELECT tot.lang, source, term, n, {_P.format('n', 'own')} AS p, {_P.format('here', 'whole')} AS q FROM tot JOIN v ON tot.lang = v.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b
  ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, cast(coalesce(value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP}
"""
