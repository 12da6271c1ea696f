"""Choosing and joining audits, samples and words: resumption, filters, metadata, identity and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan import ordered
from lexspan.functions import text as T
from lexspan.operators import corpus

#: Characters before a sample for each token of its prefix; a text is tiled whole where these don't hold enough.
NEAR = 16


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key isn't done yet; null keys count as equal."""
    finished = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return work.join(finished, _same(keys), "left_anti")


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cond


def full_groups(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Rows of groups that have exactly so many; what an interrupted run left of others goes."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") == size)
    return rows.join(sizes.select(group), group, "left_semi")


def in_all(rows: DataFrame, key: str, over: str, values: Sequence) -> DataFrame:
    """Keys that occur with every one of the values."""
    seen = rows.where(F.col(over).isin(list(values))).groupBy(key).agg(F.countDistinct(over).alias("_n"))
    return seen.where(F.col("_n") == len(set(values))).select(key)


def with_samples(audit: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Audit rows with the fields of their sample; rows of unknown samples are skipped."""
    extra = [c for c in samples.columns if c == key or c not in audit.columns]
    return audit.join(samples.select(*extra), key)


def word_metadata(samples: DataFrame, order: str) -> DataFrame:
    """word, first_order, contexts, word_order: words in the order in which they are first seen, with their samples."""
    words = samples.groupBy("word").agg(F.min(order).alias("first_order"), F.count("*").alias("contexts"))
    firsts = ordered.distinct_ranks(words, [], "first_order")  # words that come first together share a place
    places = ordered.running(ordered.sorted_rows(firsts.select("first_order"), [], ["first_order"]), [], F.lit(1).cast("long"), "word_order")
    return ordered.joined(words, ordered.plain(places), ["first_order"], "left")


def first_words(samples: DataFrame, order: str, most: int) -> DataFrame:
    """Samples of the first words by order of sampling; 0 takes all."""
    if not most:
        return samples
    words = samples.groupBy("word").agg(F.min(order).alias("_first")).orderBy("_first", "word").limit(most)
    return samples.join(F.broadcast(words.select("word")), "word", "left_semi")  # at most `most` rows


def select_rows(rows: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), words: DataFrame | None = None) -> DataFrame:
    """Rows of included (all if none is named) and not excluded models, and of allowed words."""
    if include:
        rows = rows.where(F.col("model").isin(list(include)))
    if exclude:
        rows = rows.where(~F.col("model").isin(list(exclude)))
    return rows if words is None else rows.join(corpus.small(words.select("word").distinct()), "word", "left_semi")


def band_of(rows: DataFrame) -> DataFrame:
    """One row: the rank band that metadata name first, else the lowest and highest rank."""
    named = lambda c, f: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))), f("rank"))
    return rows.agg(named("rank_min", F.min).alias("low"), named("rank_max", F.max).alias("high"))


def audit_identity(audit: DataFrame, key: str, models: int, temperatures: Sequence[float]) -> DataFrame:
    """One row: the models and temperatures that an audit holds, and whether these are as expected."""
    g = audit.agg(
        F.sort_array(F.collect_set("model")).alias("models"), F.sort_array(F.collect_set("temperature")).alias("temperatures"),
        F.countDistinct(key).alias("samples"))  # models and temperatures are a few dozen
    wanted = F.array(*[F.lit(float(t)) for t in sorted(temperatures)])
    return g.withColumn("valid", (F.size("models") == models) & (F.col("temperatures") == wanted))


def word_order(words: DataFrame) -> DataFrame:
    """words with their place by lower case, then as they stand."""
    rows = ordered.sorted_rows(words, [], [F.lower("word"), "word"])
    return ordered.plain(ordered.running(rows, [], F.lit(1).cast("long"), "place"))


def renamed_predictions(predictions: Column) -> Column:
    """Next-token alternatives under short names: place, token id and probability."""
    return F.transform(predictions, lambda x, i: F.struct((i + 1).alias("rank"), x["token_id"].cast("long").alias("id"), x["probability"].cast("double").alias("p")))


def expected_samples(samples: DataFrame, limit: int = 0) -> DataFrame:
    """One row: how many samples a run must give; a limit of 0 is none."""
    n = F.count("*")
    return samples.agg((F.least(n, F.lit(limit)) if limit else n).alias("expected"))


def compact_extremes(audit: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and of each context its worst rank, mass above, ratio and probability (at 8 digits) and number of tokens."""
    short = T.significant
    product = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("word_token_index", "probability"))), lambda x: x["probability"]), F.lit(1.0), lambda a, p: a * p)
    above = F.max(F.col("cumulative_probability") - F.col("probability"))
    return audit.groupBy(*keys).agg(
        F.max("rank").alias("worst_rank"), short(above).alias("mass_above"), short(F.min("probability_ratio_to_top")).alias("min_ratio"),
        short(product).alias("path_probability"), F.count("*").alias("n_tokens"))


def running_offsets(files: DataFrame, path: str, size: Column) -> DataFrame:
    """files with `offset`: where each begins if all stand one behind the other in order of their paths, a sign between."""
    rows = ordered.sorted_rows(files.select(path, size.cast("long").alias("size")), [], [path])
    return ordered.plain(ordered.running(rows, [], F.col("size") + 1, "offset", inclusive=False))


def every_kth(ranked: DataFrame, rank: str, stride: int) -> DataFrame:
    """Points of a curve: each `stride`-th by rank, and the last one."""
    last = ranked.agg(F.max(rank).alias("_last"))
    return ranked.crossJoin(F.broadcast(last)).where(((F.col(rank) - 1) % stride == 0) | (F.col(rank) == F.col("_last"))).drop("_last")  # one row


def repaired_prefixes(samples: DataFrame, corpus_rows: DataFrame, context: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """samples (key, start, ...) with `prefix` cut anew from the corpus; fails where too few tokens stand before a sample."""
    source = corpus_rows.select(key, F.regexp_replace(F.col(text), r"\r\n?", "\n").alias("_text"))
    # The last NEAR characters for each token mostly hold enough; beyond the two tiles that their beginning
    # may have cut they are tiled as the text is.
    start, near = F.col("start"), F.lit(NEAR * context)
    tail = F.substring("_text", F.greatest(start - near, F.lit(0)) + 1, F.least(start, near))
    rows = samples.join(source, key).withColumn("_near", corpus.tiles(tail))
    enough = (start <= near) | (F.size("_near") >= 2 * context + 2)
    rows = rows.withColumn("_x", F.when(enough, F.col("_near")).otherwise(corpus.tiles(F.left("_text", start)))).drop("_near")
    # Tokens and what is between them alternate, and a gap may stand at the end.
    odd = F.when(F.element_at("_x", -1).rlike(f"^{T.LETTER}"), 2 * context - 1).otherwise(2 * context)
    short = F.size("_x") < odd
    prefix = T.strip(F.array_join(F.slice("_x", F.greatest(F.size("_x") - odd + 1, F.lit(1)), F.size("_x")), ""))
    checked = F.when(short, F.raise_error(F.lit("too few tokens stand before a sample")).cast("string")).otherwise(prefix)
    return rows.withColumn("prefix", checked).drop("_x", "_text")


def suite_manifest(models: DataFrame, completed: DataFrame, expected: int) -> DataFrame:
    """model, samples, complete: of every model of a suite, how many samples its audits have."""
    done = completed.groupBy("model").agg(F.countDistinct("sample_id").alias("samples"))
    out = models.select("model").distinct().join(done, "model", "left").withColumn("samples", F.coalesce("samples", F.lit(0)).cast("long"))
    return out.withColumn("complete", F.col("samples") >= expected)


def fallback(shortages: DataFrame, occurrences: DataFrame, order: list[Column]) -> DataFrame:
    """Occurrences for words that are short, as many as each lacks; none at all if any word stays short."""
    lacking = shortages.select("word", (F.col("needed") - F.col("found")).alias("_lack"))
    w = Window.partitionBy("word").orderBy(*order)
    found = occurrences.join(lacking, "word").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("_lack"))
    counts = found.groupBy("word").agg(F.count("*").alias("_got"))
    short = lacking.join(counts, "word", "left").agg(F.coalesce(F.max(F.col("_lack") - F.coalesce("_got", F.lit(0))), F.lit(0)).alias("_short"))
    return found.crossJoin(F.broadcast(short)).where("_short <= 0").drop("_n", "_lack", "_short")  # one row
