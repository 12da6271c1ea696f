"""Word frequencies, and contexts of target words in a corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lexspan import stored
from lexspan.functions import text as T

#: Dictionaries and target words are broadcast up to this many rows; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Target words that are looked up in the row of a text; more of them go through a join.
TARGETS = 10_000


def small(df: DataFrame) -> DataFrame:
    """df, written once, to be broadcast if a count shows that it is small enough."""
    df = stored.written(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def word_frequency(corpus: DataFrame, text: str = "text", group: str | None = None) -> DataFrame:
    """word, count; with a group, counts of each group and, as group null, of all together.

    Tokens are counted as they stand; only the different ones are normalised, and their counts summed. What is
    no word goes by an aggregate: Spark would take a condition on the word itself back to each token.
    """
    by = [group] if group else []
    tokens = stored.spread(corpus.select(*by, text)).select(*by, F.explode(T.words(F.col(text))).alias("t")).groupBy(*by, "t").agg(F.count("*").alias("n"))
    words = tokens.select(*by, "n", T.normalize_word(F.col("t")).alias("word"))
    counts = words.groupBy(*by, "word").agg(F.sum("n").alias("count"), F.max(F.length("word")).alias("_l")).where("_l > 0").drop("_l")
    if not group:
        return counts
    # The totals come from the counts, not from the tokens again; these are small beside the corpus.
    counts = stored.written(counts)
    return counts.unionByName(counts.groupBy("word").agg(F.sum("count").alias("count")).withColumn(group, F.lit(None).cast("string")))


def top_ranked(counts: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """The most frequent words with rank 1, 2, ... by (-count, word); tasks keep `most` each before they meet."""
    w = Window.partitionBy(*(by or [])).orderBy(F.col("count").desc(), "word")
    source = counts if by else counts.orderBy(F.col("count").desc(), "word").limit(most)
    return source.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def ranked(counts: DataFrame) -> DataFrame:
    """All words with their rank by (-count, word), without gathering them in one task."""
    out = stored.numbered(counts.select("word", "count"), [F.col("count").desc(), F.col("word")], "rank")
    return out.select("word", "count", "rank")


def rank_band(entries: DataFrame, low: int, high: int, min_length: int = 1, dictionary: DataFrame | None = None) -> DataFrame:
    if low > high:
        raise ValueError("the lowest rank must not exceed the highest")
    band = entries.where(F.col("rank").between(low, high) & (F.length("word") >= min_length))
    return band if dictionary is None else band.join(small(dictionary.select("word").distinct()), "word", "left_semi")


def dictionary(texts: DataFrame, text: str = "text") -> DataFrame:
    return word_frequency(texts, text).select("word")


def tiles(text: Column) -> Column:
    """Tokens and what lies between them, in turn; ends of lines count as one."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(rf"(?s){T.WORD}|[^\p{{L}}\p{{Nl}}\p{{No}}]+"), F.lit(0))


@F.pandas_udf(ArrayType(IntegerType()))
def _running(numbers: pd.Series) -> pd.Series:
    """The running sums of an array, in time linear in its length."""
    return numbers.map(lambda a: None if a is None else np.cumsum(a, dtype=np.int32))


def token_offsets(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, index, token, start, end (in characters) of every token; ends of lines count as one.

    The text is tiled by tokens and what lies between, in turn; a running sum of their lengths in the row
    of the text gives the places, so that no token is shuffled.
    """
    stored.small_batches(corpus.sparkSession)
    rows = stored.spread(corpus.select(key, text)).select(key, tiles(F.col(text)).alias("_x"))
    rows = rows.withColumn("_e", _running(F.transform("_x", F.length)))
    out = rows.select(key, F.posexplode(F.arrays_zip("_x", "_e")).alias("_k", "_t")).select(key, "_k", F.col("_t._x").alias("token"), F.col("_t._e").alias("end"))
    out = out.where(F.col("token").rlike(f"^{T.LETTER}"))
    return out.select(key, F.shiftright("_k", 1).alias("index"), "token", (F.col("end") - F.length("token")).alias("start"), "end")


def _in_targets(token: Column, words: list[str]) -> Column:
    """The target word that a token stands for, or null: as it is, else without marks at its end."""
    first, second = T.match_keys(token)
    return F.when(first.isin(words), first).when(F.right(token, F.lit(1)).isin(*T.END_MARKS) & second.isin(words), second)


def occurrences(corpus: DataFrame, targets: DataFrame, context: int, key: str = "doc_id", text: str = "text", lowercase_only: bool = False) -> DataFrame:
    """word, key, start, end, matched, prefix, excerpt: each target word behind `context` tokens.

    Tokens and what lies between them alternate, so the prefix of a token is a slice of the array that
    tiles the text, and only hits leave the row of their text; a shuffle of hits adds up their places.
    Targets are looked up in a set that the plan holds; more than TARGETS of them go through a join.
    """
    names = [r.word for r in targets.select("word").distinct().limit(TARGETS + 1).collect()]  # bounded
    if len(names) > TARGETS:
        return _occurrences_by_join(corpus, targets, context, key, text, lowercase_only)
    # Texts without hits end at posexplode; Spark would evaluate a condition on these columns from the text anew.
    rows = stored.spread(corpus.select(key, text)).select(key, tiles(F.col(text)).alias("_x"))

    def place(tile: Column, at: Column) -> Column:
        # The first `context` tokens have too little before them.
        hit = (at >= 2 * context) & _in_targets(tile, names).isNotNull()
        return F.when(hit & ~T.is_capitalized(tile) if lowercase_only else hit, at)

    rows = rows.withColumn("_h", F.array_compact(F.transform("_x", place)))
    between = lambda first, n: F.array_join(F.slice("_x", first + 1, n), "")

    def cut(at: Column, i: Column) -> Column:
        tile, here = F.get("_x", at), F.when(i == 0, F.lit(0)).otherwise(F.get("_h", i - 1))
        return F.struct(
            _in_targets(tile, names).alias("word"), tile.alias("matched"), F.length(between(here, at - here)).cast("long").alias("gap"),
            between(at - 2 * context, F.lit(2 * context)).alias("before"))

    hits = rows.select(key, F.posexplode(F.transform("_h", cut)).alias("_i", "_c")).select(key, "_i", "_c.*")
    start = F.sum("gap").over(Window.partitionBy(key).orderBy("_i"))
    out = hits.withColumn("start", start.cast("int")).withColumn("end", (start + F.length("matched")).cast("int"))
    return out.select("word", key, "start", "end", "matched", T.strip(F.col("before")).alias("prefix"), T.strip(F.concat("before", "matched")).alias("excerpt"))


def _occurrences_by_join(corpus: DataFrame, targets: DataFrame, context: int, key: str, text: str, lowercase_only: bool) -> DataFrame:
    offsets = token_offsets(corpus.select(key, text), key, text)
    w = Window.partitionBy(key).orderBy("index")
    offsets = offsets.withColumn("from", F.lag("start", context).over(w) if context else F.col("start"))
    first, second = T.match_keys(F.col("token"))
    words = small(targets.select("word").distinct())
    hits = offsets.where(F.col("index") >= context).withColumn("k1", first).withColumn("k2", second)
    hits = hits.join(words.withColumnRenamed("word", "w1"), F.col("k1") == F.col("w1"), "left").join(words.withColumnRenamed("word", "w2"), F.col("k2") == F.col("w2"), "left")
    hits = hits.withColumn("word", F.coalesce("w1", "w2")).where("word is not null")
    if lowercase_only:
        hits = hits.where(~T.is_capitalized(F.col("token")))
    source = corpus.select(key, F.regexp_replace(F.col(text), r"\r\n?", "\n").alias("_t"))
    cut = lambda a, b: T.strip(F.substring(F.col("_t"), F.col(a) + 1, F.col(b) - F.col(a)))
    return hits.join(source, key).select("word", key, "start", "end", F.col("token").alias("matched"), cut("from", "start").alias("prefix"), cut("from", "end").alias("excerpt"))


def order_key(*parts: Column | str | int) -> Column:
    """A random but fixed order: md5 of a seed and what identifies a row."""
    return F.md5(F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def per_word(rows: DataFrame, most: int, order: list[Column], word: str = "word") -> DataFrame:
    """The first rows of each word in an order; tasks drop the rest before they meet."""
    w = Window.partitionBy(word).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def sample_words(entries: DataFrame, n: int, seed: int) -> DataFrame:
    """n words at random without replacement, the same on every run."""
    return entries.orderBy(order_key(seed, F.col("word")), "word").limit(n)


def circular_order(rows: DataFrame, offset: Column, start: str, word: str = "word") -> DataFrame:
    """rows with `turn` 1, 2, ...: from the first at or behind an offset, and round to the beginning."""
    w = Window.partitionBy(word).orderBy(F.col(start) < offset, F.col(start))
    return rows.withColumn("turn", F.row_number().over(w))


def accept(rows: DataFrame, accepted: Column, contexts: int, words: int, order: list[Column], word_order: list[Column]) -> DataFrame:
    """The first `contexts` accepted rows of each word that has so many, for the first `words` such words, with ids."""
    first = stored.written(per_word(rows.where(accepted), contexts, order))  # read twice; `contexts` rows a word
    full = first.groupBy("word").agg(F.count("*").alias("c"), *[F.min(c).alias(f"_o{i}") for i, c in enumerate(word_order)]).where(F.col("c") >= contexts)
    chosen = full.orderBy(*[f"_o{i}" for i in range(len(word_order))], "word").limit(words)
    out = first.join(F.broadcast(chosen.drop("c")), "word")  # at most `words` rows
    w = Window.orderBy(*[f"_o{i}" for i in range(len(word_order))], "word", *order)  # at most words x contexts rows
    return out.withColumn("sample_id", F.format_string("sample-%06d", F.row_number().over(w))).drop(*[f"_o{i}" for i in range(len(word_order))])


def missing_words(targets: DataFrame, rows: DataFrame, contexts: int) -> DataFrame:
    """word, found: targets with fewer rows than they need."""
    found = rows.groupBy("word").agg(F.count("*").alias("found"))
    return targets.select("word").join(found, "word", "left").select("word", F.coalesce("found", F.lit(0)).cast("long").alias("found")).where(F.col("found") < contexts)


def strata_sample(entries: DataFrame, strata: list, seed: int) -> DataFrame:
    """Random words of each rank stratum, with the stratum's name; seeds go up by one from stratum to stratum."""
    rows = [(i, f"{s.low}-{s.high}", s.low, s.high, s.count) for i, s in enumerate(strata)]
    table = F.broadcast(entries.sparkSession.createDataFrame(rows, "k int, stratum string, low int, high int, n int"))
    inside = entries.join(table, F.col("rank").between(F.col("low"), F.col("high")))
    w = Window.partitionBy("k").orderBy(order_key(F.lit(seed) + F.col("k"), F.col("word")), "word")
    return inside.withColumn("_n", F.row_number().over(w)).where("_n <= n").select("stratum", "word", "rank", "count")
