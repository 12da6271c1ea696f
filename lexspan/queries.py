"""All queries of the library by name over the given tables, with SQL that gives the same rows.

Tables stand for what the operators work on: documents are the corpus, words of benchmark the
dictionary, labels the judge's decisions, embeddings (times 8) next-token scores whose target is the
label, two vectors a path; conversations are generations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan import ordered, stored
from lexspan.functions import diversity, stats
from lexspan.functions import text as T
from lexspan.operators import audit as A
from lexspan.operators import corpus as C
from lexspan.operators import coverage as V
from lexspan.operators import forced
from lexspan.operators import repair as R
from lexspan.operators import selection as L
from lexspan.operators import summary as S
from lexspan.plans import grids
from lexspan.sources import merge, paged, payload, publish, readers
from lexspan.streaming import candidates

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TEMPERATURES = [0.7, 1.0, 1.5]
RECIPES = [grids.Recipe("strict", 2, 0.8), grids.Recipe("usual", 3, 0.95), grids.Recipe("loose", 5, 0.99)]
STRATA = grids.parse_strata("1:200:20,201:2000:40,2001:20000:40")
CONTEXT, SEED = 16, 13


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return register


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles at nine decimals, and zero without a sign: sums have no fixed order. Counts are 64-bit."""
    kinds = {"double": lambda c: F.round(c, 9) + F.lit(0.0), "int": lambda c: c.cast("long")}
    return df.select(*[kinds[k](F.col(c)).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- audits and coverage -------------------------------------------------------------------------

def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = F.expr("vec_id div 2")
    return table(spark, sf_dir, "embeddings").select(
        sample.alias("sample_id"), (F.col("vec_id") % 2).cast("int").alias("word_token_index"), F.concat(F.lit("model-"), sample % 3).alias("model"), F.concat(F.lit("w"), sample % 20).alias("word"),
        F.col("label").alias("token_id"), F.lit(2).alias("word_token_count"), F.transform("embedding", lambda v: v.cast("double") * 8).alias("logits"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.score_target(scores(spark, sf_dir), "logits", "token_id", TEMPERATURES)


AUDIT = """b AS (SELECT vec_id // 2 AS sample_id, vec_id % 2 AS word_token_index, 'model-' || ((vec_id // 2) % 3) AS model, 'w' || ((vec_id // 2) % 20) AS word, label AS token_id,
  list_transform(embedding, lambda v: cast(v AS DOUBLE) * 8) AS x FROM embeddings),
t AS (SELECT b.*, temperature, list_max(x) AS mx FROM b, (VALUES (cast(0.7 AS DOUBLE)), (cast(1.0 AS DOUBLE)), (cast(1.5 AS DOUBLE))) AS v(temperature)),
e AS (SELECT *, list_transform(x, lambda v: exp((v - mx) / temperature)) AS e FROM t),
p AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e),
q AS (SELECT *, p[token_id + 1] AS probability, list_max(p) AS top_probability FROM p),
r AS (SELECT *, len(list_filter(p, lambda v: v > probability)) + 1 AS rank FROM q),
audit AS (SELECT *, probability / top_probability AS ratio, list_sum(list_sort(p, 'DESC')[1:rank]) AS cumulative FROM r)"""
GRID = "grid(decoder, parameter) AS (VALUES " + ", ".join(f"('{d}', cast({p} AS DOUBLE))" for d, p in grids.grid_rows()) + ")"
PATHS = f"""{AUDIT}, {GRID},
paths AS (SELECT model, temperature, sample_id, word, max(rank) AS wr, max(cumulative - probability) AS ma, min(ratio) AS mr FROM audit GROUP BY ALL),
checked AS (SELECT *, CASE decoder WHEN 'top_k' THEN wr <= parameter WHEN 'top_p' THEN ma <= parameter ELSE mr >= parameter END AS survives FROM paths, grid)"""
CONTEXT_SQL = f"""{PATHS},
cov AS (SELECT model, temperature, decoder, parameter, count(*) FILTER (survives) AS covered_contexts, count(*) AS total_contexts, count(*) FILTER (survives) / count(*) AS coverage FROM checked GROUP BY ALL)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.extremes(audit(spark, sf_dir), ["model", "temperature", "sample_id", "word"])


def context_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.context_coverage(paths(spark, sf_dir), grids.grid(spark), ["model", "temperature"])


@query("audit_rows", f"""WITH {AUDIT} SELECT model, temperature, sample_id, word_token_index, rank, round(probability, 9) AS probability, round(top_probability, 9) AS top_probability,
  round(ratio, 9) AS ratio, round(cumulative, 9) AS cumulative FROM audit""")
def _(spark, sf_dir):
    a = audit(spark, sf_dir)
    return a.select("model", "temperature", "sample_id", "word_token_index", "rank", "probability", "top_probability", F.col("probability_ratio_to_top").alias("ratio"), F.col("cumulative_probability").alias("cumulative"))


@query("audit_top_tokens", f"""WITH {AUDIT}, x AS (SELECT sample_id, word_token_index, temperature, unnest(p) AS v, unnest(range(0, len(p))) AS id FROM audit),
o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, word_token_index, temperature ORDER BY v DESC, id) AS place FROM x)
SELECT sample_id, word_token_index, temperature, place, id AS token_id, round(v, 9) AS probability FROM o WHERE place <= 5""")
def _(spark, sf_dir):
    a = audit(spark, sf_dir).select("sample_id", "word_token_index", "temperature", F.posexplode("top_tokens").alias("place", "t"))
    return a.select("sample_id", "word_token_index", "temperature", (F.col("place") + 1).alias("place"), "t.token_id", "t.probability")


@query("rank_neighbors", f"""WITH {AUDIT}, x AS (SELECT sample_id, word_token_index, temperature, token_id AS target, unnest(p) AS v, unnest(range(0, len(p))) AS id FROM audit),
o AS (SELECT *, row_number() OVER w AS place, lag(id) OVER w AS above, lead(id) OVER w AS below FROM x WINDOW w AS (PARTITION BY sample_id, word_token_index, temperature ORDER BY v DESC, id))
SELECT sample_id, word_token_index, temperature, coalesce(above, -1) AS above, coalesce(below, -1) AS below FROM o WHERE id = target""")
def _(spark, sf_dir):
    a = audit(spark, sf_dir)
    return a.select("sample_id", "word_token_index", "temperature", F.coalesce(F.get("neighbors_above", F.lit(0))["token_id"], F.lit(-1)).alias("above"), F.coalesce(F.get("neighbors_below", F.lit(0))["token_id"], F.lit(-1)).alias("below"))


@query("coverage_context", f"WITH {CONTEXT_SQL} SELECT model, temperature, decoder, parameter, covered_contexts, total_contexts, round(coverage, 9) AS coverage FROM cov")
def _(spark, sf_dir):
    return context_coverage(spark, sf_dir)


WORD_SQL = """w AS (SELECT model, temperature, word, {p}, bool_or(survives) AS a, bool_and(survives) AS l, count(*) FILTER (survives) AS c, count(*) AS n FROM {t} GROUP BY ALL)
SELECT model, temperature, {p}, count(*) FILTER (a) AS covered_words_any, count(*) FILTER (l) AS covered_words_all, count(*) AS total_words, cast(sum(c) AS BIGINT) AS covered_contexts,
  cast(sum(n) AS BIGINT) AS total_contexts, round(count(*) FILTER (a) / count(*), 9) AS any_coverage, round(count(*) FILTER (l) / count(*), 9) AS all_coverage FROM w GROUP BY ALL"""


@query("coverage_word", f"WITH {PATHS}, " + WORD_SQL.format(p="decoder, parameter", t="checked"))
def _(spark, sf_dir):
    return V.word_coverage(paths(spark, sf_dir), grids.grid(spark), ["model", "temperature"])


RECIPE_SQL = f"""{AUDIT}, recipes(recipe, k, tp) AS (VALUES {", ".join(f"('{r.name}', {r.top_k}, cast({r.top_p} AS DOUBLE))" for r in RECIPES)}),
ok AS (SELECT model, temperature, sample_id, word, recipe, rank <= k AND (cumulative - probability) / list_sum(list_sort(p, 'DESC')[1:k]) <= tp AS ok FROM audit, recipes),
rp AS (SELECT model, temperature, sample_id, word, recipe, bool_and(ok) AS survives FROM ok GROUP BY ALL)"""


def recipe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recipe_paths(audit(spark, sf_dir), ["model", "temperature", "sample_id", "word"], RECIPES)


@query("recipe_context", f"WITH {RECIPE_SQL} SELECT model, temperature, recipe, count(*) FILTER (survives) AS covered, count(*) AS total, round(count(*) FILTER (survives) / count(*), 9) AS coverage FROM rp GROUP BY ALL")
def _(spark, sf_dir):
    g = recipe_paths(spark, sf_dir).groupBy("model", "temperature", "recipe").agg(F.count_if("survives").alias("covered"), F.count("*").alias("total"))
    return g.withColumn("coverage", F.col("covered") / F.col("total"))


@query("recipe_word", f"WITH {RECIPE_SQL}, " + WORD_SQL.format(p="recipe", t="rp"))
def _(spark, sf_dir):
    return V.recipe_words(recipe_paths(spark, sf_dir), ["model", "temperature"])


MEANS_SQL = f"""{PATHS}, cx AS (SELECT model, temperature, word, sample_id, count(*) FILTER (survives) AS h, count(*) AS n FROM checked GROUP BY ALL),
means AS (SELECT model, temperature, word, count(*) AS evaluated_contexts, cast(sum(n) AS BIGINT) AS evaluated_settings, sum(h) / sum(n) AS mean_coverage, count(*) FILTER (h > 0) / count(*) AS any_reachable_rate,
  cast(2 AS DOUBLE) AS mean_token_count FROM cx GROUP BY ALL)"""


def word_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.word_means(paths(spark, sf_dir).drop("n_tokens").withColumn("n_tokens", F.lit(2)), grids.grid(spark), ["model", "temperature"])


@query("word_means", f"WITH {MEANS_SQL} SELECT model, temperature, word, evaluated_contexts, evaluated_settings, round(mean_coverage, 9) AS mean_coverage, round(any_reachable_rate, 9) AS any_reachable_rate, mean_token_count FROM means")
def _(spark, sf_dir):
    return word_means(spark, sf_dir)


@query("word_means_all_models", f"""WITH {MEANS_SQL} SELECT model, temperature, word, evaluated_contexts, evaluated_settings, round(mean_coverage, 9) AS mean_coverage, round(any_reachable_rate, 9) AS any_reachable_rate, mean_token_count FROM means
UNION ALL SELECT 'ALL_MODELS', NULL, word, cast(sum(evaluated_contexts) AS BIGINT), cast(sum(evaluated_settings) AS BIGINT), round(avg(mean_coverage), 9), round(avg(any_reachable_rate), 9), avg(mean_token_count) FROM means GROUP BY word""")
def _(spark, sf_dir):
    return V.with_all_models(word_means(spark, sf_dir), ["word"])


@query("audit_completeness", """WITH x AS (SELECT 'model-' || ((vec_id // 2) % 3) AS model, vec_id // 2 AS sample_id, vec_id % 2 AS i, temperature FROM embeddings, (VALUES (cast(0.7 AS DOUBLE)), (cast(1.0 AS DOUBLE)), (cast(1.5 AS DOUBLE))) AS v(temperature) WHERE vec_id % 11 <> 3)
SELECT model, temperature, sample_id, count(*) AS n_rows, cast(2 AS BIGINT) AS expected, count(*) = 2 AND count(DISTINCT i) = 2 AS complete FROM x GROUP BY ALL""")
def _(spark, sf_dir):
    return A.completeness(audit(spark, sf_dir).where("(sample_id * 2 + word_token_index) % 11 <> 3"))


@query("audit_keep_last", f"""WITH {AUDIT}, d AS (SELECT model, temperature, sample_id, word_token_index, rank, 1 AS pos FROM audit UNION ALL SELECT model, temperature, sample_id, word_token_index, rank + 1000, 2 FROM audit WHERE sample_id % 5 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY model, temperature, sample_id, word_token_index ORDER BY pos DESC) AS n FROM d),
k AS (SELECT * FROM l WHERE n = 1 AND (sample_id * 2 + word_token_index) % 11 <> 3), c AS (SELECT sample_id FROM k GROUP BY sample_id, model, temperature HAVING count(*) = 2)
SELECT model, temperature, sample_id, word_token_index, rank FROM k WHERE sample_id IN (SELECT sample_id FROM c)""")
def _(spark, sf_dir):
    a = audit(spark, sf_dir).select("model", "temperature", "sample_id", "word_token_index", "word_token_count", "rank").where("(sample_id * 2 + word_token_index) % 11 <> 3")
    twice = a.withColumn("pos", F.lit(1)).union(a.where("sample_id % 5 = 0").withColumn("rank", F.col("rank") + 1000).withColumn("pos", F.lit(2)))
    return A.retain_complete(twice, "pos").drop("pos", "word_token_count")


@query("explorer_rollup", f"""WITH {AUDIT} SELECT model, temperature, sample_id, word, max(rank) AS worst_rank, round(product(probability), 9) AS probability_product,
  string_agg(cast(token_id AS VARCHAR), ',' ORDER BY word_token_index) AS steps FROM audit GROUP BY ALL""")
def _(spark, sf_dir):
    e = V.explorer(audit(spark, sf_dir), ["model", "temperature", "sample_id", "word"])
    return e.select("model", "temperature", "sample_id", "word", "worst_rank", "probability_product", F.array_join(F.transform("steps", lambda s: s["token_id"].cast("string")), ",").alias("steps"))


@query("models_found", f"""WITH {PATHS} SELECT word, decoder, parameter, count(*) FILTER (survives) AS found, count(*) AS models, count(*) FILTER (survives) > 0 AS any_model, bool_and(survives) AS all_models FROM checked GROUP BY ALL""")
def _(spark, sf_dir):
    return V.models_found(V.on_grid(paths(spark, sf_dir), grids.grid(spark)), ["word", "decoder", "parameter"])


STATUS = "CASE WHEN m >= 0.8 THEN 'Excellent' WHEN m >= 0.5 THEN 'Good' WHEN m >= 0.1 THEN 'Fair' WHEN m >= 0.01 THEN 'Poor' ELSE 'Missed' END"


@query("probability_status", f"WITH {AUDIT}, x AS (SELECT word, model, avg(probability) AS m, avg(rank) AS r FROM audit GROUP BY ALL) SELECT word, model, round(m, 9) AS mean_probability, round(r, 9) AS mean_rank, {STATUS} AS status FROM x")
def _(spark, sf_dir):
    g = audit(spark, sf_dir).groupBy("word", "model").agg(F.avg("probability").alias("mean_probability"), F.avg("rank").alias("mean_rank"))
    return g.withColumn("status", V.probability_status(F.col("mean_probability")))


@query("leaderboard", f"""WITH {CONTEXT_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY model, temperature ORDER BY coverage DESC, parameter) AS n FROM cov WHERE decoder = 'top_p')
SELECT model, temperature, decoder, parameter, round(coverage, 9) AS coverage, row_number() OVER (PARTITION BY temperature ORDER BY coverage DESC, model) AS place FROM best WHERE n = 1""")
def _(spark, sf_dir):
    return V.leaderboard(context_coverage(spark, sf_dir), ["temperature"])


@query("coverage_gap", f"""WITH {CONTEXT_SQL}, m AS (SELECT model, temperature, max(coverage) AS c FROM cov WHERE decoder = 'top_p' GROUP BY ALL)
SELECT a.temperature, round(a.c, 9) AS left_coverage, round(b.c, 9) AS right_coverage, round(b.c - a.c, 9) AS gap FROM m AS a JOIN m AS b ON a.temperature = b.temperature AND a.model = 'model-0' AND b.model = 'model-1'""")
def _(spark, sf_dir):
    return S.coverage_gap(context_coverage(spark, sf_dir).where("decoder = 'top_p'"), "model", "model-0", "model-1", ["temperature"])


@query("coverage_by_word_group", f"""WITH {PATHS} SELECT temperature, cast(substr(word, 2) AS BIGINT) % 4 AS word_group, decoder, parameter, count(*) FILTER (survives) AS covered_contexts, count(*) AS total_contexts,
  round(count(*) FILTER (survives) / count(*), 9) AS coverage FROM checked GROUP BY ALL""")
def _(spark, sf_dir):
    p = paths(spark, sf_dir).withColumn("word_group", F.substring("word", 2, 9).cast("long") % 4)
    return V.context_coverage(p, grids.grid(spark), ["temperature", "word_group"])


# ---- corpus --------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{Nl}\p{No}](?:[\p{L}\p{Nl}\p{No}]|[''’\-])*"
NORMAL = r"regexp_replace(lower(t), '^[''’\-]+|[''’\-]+$', '', 'g')"
FREQUENCY = f"""tok AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{WORD}')) AS t FROM documents), nw AS (SELECT source, {NORMAL} AS word FROM tok),
freq AS (SELECT word, count(*) AS count FROM nw GROUP BY word), ranked AS (SELECT word, count, row_number() OVER (ORDER BY count DESC, word) AS rank FROM freq)"""


def frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_frequency(table(spark, sf_dir, "documents"))


@query("word_frequency", f"WITH {FREQUENCY} SELECT word, count FROM freq")
def _(spark, sf_dir):
    return frequency(spark, sf_dir)


@query("word_frequency_groups", f"WITH {FREQUENCY} SELECT source, word, count(*) AS count FROM nw GROUP BY ALL UNION ALL SELECT NULL, word, count FROM freq")
def _(spark, sf_dir):
    return C.word_frequency(table(spark, sf_dir, "documents"), group="source")


@query("frequency_ranked", f"WITH {FREQUENCY} SELECT word, count, rank FROM ranked")
def _(spark, sf_dir):
    return C.ranked(frequency(spark, sf_dir))


@query("corpus_stats", f"""WITH t AS (SELECT lang, doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS t FROM documents), n AS (SELECT lang, count(*) AS tokens, count(DISTINCT {NORMAL}) AS types FROM t GROUP BY lang)
SELECT d.lang, count(*) AS books, any_value(n.tokens) AS tokens, any_value(n.types) AS types FROM documents AS d JOIN n ON n.lang = d.lang GROUP BY d.lang""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    counts = C.word_frequency(d, group="lang").where("lang is not null").groupBy("lang").agg(F.sum("count").alias("tokens"), F.count("*").alias("types"))
    return d.groupBy("lang").agg(F.count("*").alias("books")).join(counts, "lang")


@query("ascii_frequency", r"SELECT w AS word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''\-]*')) AS w FROM documents) GROUP BY w")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.ascii_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


LEXICAL = r"[\p{L}\p{Nl}\p{No}]+(?:[''’\-][\p{L}\p{Nl}\p{No}]+)*"


@query("lexical_tokens", f"SELECT replace(lower(w), 'ß', 'ss') AS token, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '{LEXICAL}')) AS w FROM documents) GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.lexical_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("count"))


DICTIONARY = f"dict AS (SELECT DISTINCT {NORMAL} AS word FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS t FROM benchmark))"


@query("rank_band", f"WITH {FREQUENCY} SELECT word, count, rank FROM ranked WHERE rank BETWEEN 100 AND 3000 AND length(word) >= 4")
def _(spark, sf_dir):
    return C.rank_band(C.ranked(frequency(spark, sf_dir)), 100, 3000, 4)


@query("dictionary_semijoin", f"WITH {FREQUENCY}, {DICTIONARY} SELECT word, count, rank FROM ranked WHERE rank <= 5000 AND word IN (SELECT word FROM dict)")
def _(spark, sf_dir):
    return C.rank_band(C.ranked(frequency(spark, sf_dir)), 1, 5000, 1, C.dictionary(table(spark, sf_dir, "benchmark")))


@query("strata_sample", f"""WITH {FREQUENCY}, s(k, low, high, n) AS (VALUES {", ".join(f"({i}, {s.low}, {s.high}, {s.count})" for i, s in enumerate(STRATA))}),
o AS (SELECT low || '-' || high AS stratum, word, rank, count, n, row_number() OVER (PARTITION BY k ORDER BY md5((k + {SEED}) || '|' || word), word) AS i FROM ranked JOIN s ON rank BETWEEN low AND high)
SELECT stratum, word, rank, count FROM o WHERE i <= n""")
def _(spark, sf_dir):
    return C.strata_sample(C.ranked(frequency(spark, sf_dir)), STRATA, SEED)


TARGETS = f"targets AS (SELECT word FROM (SELECT word FROM ranked WHERE rank BETWEEN 50 AND 1500 AND length(word) >= 4 AND word IN (SELECT word FROM dict)) ORDER BY md5('{SEED}|' || word), word LIMIT 60)"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = C.rank_band(C.top_ranked(frequency(spark, sf_dir), 1500), 50, 1500, 4, C.dictionary(table(spark, sf_dir, "benchmark")))
    return C.sample_words(band, 60, SEED)


def contexts(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    words = targets(spark, sf_dir) if words is None else words
    return C.occurrences(table(spark, sf_dir, "documents"), words, CONTEXT, lowercase_only=True)


OFFSETS = rf"""tiles AS (SELECT doc_id, text, regexp_extract_all(text, '(?s){WORD}|[^\p{{L}}\p{{Nl}}\p{{No}}]+') AS x FROM documents WHERE text IS NOT NULL),
ti AS (SELECT doc_id, unnest(x) AS tok, unnest(range(1, len(x) + 1)) AS k FROM tiles),
off AS (SELECT doc_id, tok, k, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM ti),
wo AS (SELECT doc_id, tok, e - length(tok) AS s, e, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM off WHERE regexp_matches(tok, '^[\p{{L}}\p{{Nl}}\p{{No}}]')),
wl AS (SELECT *, lag(s, {CONTEXT}) OVER (PARTITION BY doc_id ORDER BY i) AS f FROM wo),
hits AS (SELECT coalesce(a.word, b.word) AS word, wl.* FROM wl LEFT JOIN targets AS a ON lower(tok) = a.word LEFT JOIN targets AS b ON regexp_replace(lower(tok), '[''’\-]+$', '') = b.word
  WHERE i >= {CONTEXT} AND (a.word IS NOT NULL OR b.word IS NOT NULL) AND NOT regexp_matches(tok, '^\p{{Lu}}')),
ctx AS (SELECT h.word, h.doc_id, cast(s AS BIGINT) AS start, cast(e AS BIGINT) AS "end", tok AS matched, regexp_replace(substr(text, cast(f AS BIGINT) + 1, cast(s - f AS BIGINT)), '^\s+|\s+$', '', 'g') AS prefix FROM hits AS h JOIN documents AS d ON d.doc_id = h.doc_id)"""
CONTEXTS = f"{FREQUENCY}, {DICTIONARY}, {TARGETS}, {OFFSETS}"


@query("token_offsets", f"WITH targets AS (SELECT '' AS word), {OFFSETS} SELECT doc_id, i AS index, tok AS token, cast(s AS BIGINT) AS start, cast(e AS BIGINT) AS \"end\" FROM wo")
def _(spark, sf_dir):
    return C.token_offsets(table(spark, sf_dir, "documents"))


@query("context_windows", f"WITH {CONTEXTS} SELECT * FROM ctx")
def _(spark, sf_dir):
    return contexts(spark, sf_dir).drop("excerpt")


@query("quota_contexts", f"WITH {CONTEXTS} SELECT word, doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY md5('{SEED}|' || word || '|' || doc_id || '|' || start)) AS n FROM ctx) WHERE n <= 10")
def _(spark, sf_dir):
    c = contexts(spark, sf_dir).select("word", "doc_id", "start")
    return C.per_word(c, 10, [C.order_key(SEED, F.col("word"), F.col("doc_id"), F.col("start"))])


@query("missing_words", f"WITH {CONTEXTS} SELECT t.word, count(c.word) AS found FROM targets AS t LEFT JOIN ctx AS c ON c.word = t.word GROUP BY t.word HAVING count(c.word) < 25")
def _(spark, sf_dir):
    words = stored.written(targets(spark, sf_dir))
    return C.missing_words(words, contexts(spark, sf_dir, words), 25)


@query("circular_order", f"WITH {CONTEXTS} SELECT word, doc_id, start, row_number() OVER (PARTITION BY word ORDER BY doc_id * 100000 + start < 50000000, doc_id * 100000 + start) AS turn FROM ctx")
def _(spark, sf_dir):
    c = contexts(spark, sf_dir).select("word", "doc_id", "start").withColumn("at", F.col("doc_id") * 100000 + F.col("start"))
    return C.circular_order(c, F.lit(50_000_000), "at").select("word", "doc_id", "start", "turn")


@query("accepted_contexts", f"""WITH {CONTEXTS}, j AS (SELECT c.word, c.doc_id, c.start, row_number() OVER (PARTITION BY c.word ORDER BY c.doc_id, c.start) AS n FROM ctx AS c JOIN labels AS l ON l.doc_id = c.doc_id AND l.quality = 1 AND l.toxic = 0),
f AS (SELECT word FROM j WHERE n <= 3 GROUP BY word HAVING count(*) = 3 ORDER BY md5('{SEED}|' || word), word LIMIT 20)
SELECT word, doc_id, start, 'sample-' || lpad(cast(row_number() OVER (ORDER BY md5('{SEED}|' || word), word, doc_id, start) AS VARCHAR), 6, '0') AS sample_id FROM j WHERE n <= 3 AND word IN (SELECT word FROM f)""")
def _(spark, sf_dir):
    decisions = table(spark, sf_dir, "labels").select("doc_id", (F.expr("quality = 1 and toxic = 0")).alias("accepted"))
    c = contexts(spark, sf_dir).select("word", "doc_id", "start").join(decisions, "doc_id", "left").withColumn("w", C.order_key(SEED, F.col("word")))
    out = C.accept(c, F.coalesce("accepted", F.lit(False)), 3, 20, [F.col("doc_id"), F.col("start")], [F.col("w")])
    return out.select("word", "doc_id", "start", "sample_id")


@query("generation_seed", "SELECT doc_id, (13 + cast('0x' || substr(sha256('13|' || source || '|' || doc_id || '|0.7'), 1, 8) AS BIGINT)) % 2147483648 AS seed FROM documents")
def _(spark, sf_dir):
    h = F.sha2(F.concat_ws("|", F.lit("13"), "source", F.col("doc_id").cast("string"), F.lit("0.7")), 256)
    return table(spark, sf_dir, "documents").select("doc_id", ((F.lit(13) + F.conv(F.substring(h, 1, 8), 16, 10).cast("long")) % 2147483648).alias("seed"))


@query("language_names", "SELECT CASE lower(lang) WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' ELSE coalesce(nullif(trim(lang), ''), 'English') END AS language, count(*) AS documents FROM documents GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.normalize_language(F.col("lang")).alias("language")).agg(F.count("*").alias("documents"))


@query("slugs", "SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'words') AS slug FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("html_text")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("boilerplate_strip", "SELECT doc_id, md5(chr(10) || text || chr(10)) AS text_md5 FROM documents WHERE text IS NOT NULL")
def _(spark, sf_dir):
    marked = F.concat(F.lit("licence\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), F.col("text"), F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nmore"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.strip_boilerplate(marked)).alias("text_md5"))


# ---- diversity and statistics --------------------------------------------------------------------

TOKENS = f"list_transform(regexp_extract_all(text, '{LEXICAL}'), lambda x: replace(lower(x), 'ß', 'ss'))"


def mtld_sql(tokens: str) -> str:
    """MTLD of a list of tokens: a fold over (full factors, types and tokens of the factor that has begun)."""
    empty = "{'f': 0::DOUBLE, 'types': []::VARCHAR[], 'n': 0}"
    types = "CASE WHEN list_contains(a.types, x.types[1]) THEN a.types ELSE list_append(a.types, x.types[1]) END"
    fold = f"""list_reduce(list_prepend({empty}, list_transform({tokens}, lambda t: {{'f': 0::DOUBLE, 'types': [t], 'n': 1}})),
  lambda a, x: CASE WHEN len({types}) / (a.n + 1) <= 0.72::DOUBLE THEN {{'f': a.f + 1, 'types': []::VARCHAR[], 'n': 0}} ELSE {{'f': a.f, 'types': {types}, 'n': a.n + 1}} END)"""
    part = "CASE WHEN r.n > 0 THEN (1.0::DOUBLE - len(r.types) / r.n) / (1.0::DOUBLE - 0.72::DOUBLE) ELSE 0 END"
    score = f"CASE WHEN r.f + {part} > 0 THEN len({tokens}) / (r.f + {part}) ELSE len({tokens})::DOUBLE END"
    return f"list_transform([{fold}], lambda r: {score})[1]"


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as generations: each source is a model, each id a configuration and a sample."""
    stored.small_batches(spark)
    d = stored.spread(table(spark, sf_dir, "documents").where("text is not null")).withColumn("tokens", T.lexical_tokens(F.col("text")))
    rows = d.select(
        F.concat(F.lit("m"), F.expr("doc_id % 3")).alias("model"), F.expr("doc_id div 18").alias("sample_id"), F.when(F.expr("doc_id % 18 div 3 < 2"), "top_k").when(F.expr("doc_id % 18 div 3 < 4"), "top_p").otherwise("min_p").alias("decoder"),
        F.expr("doc_id % 18 div 3 % 2").alias("end"), (F.size("tokens") >= 200).alias("reached"), diversity.type_token_ratio(F.col("tokens")).alias("ttr"), diversity.mtld(F.col("tokens")).alias("mtld"), "text")
    first = {d: (lo, hi) for d, lo, hi in grids.ENDPOINTS}
    parameter = F.lit(None).cast("double")
    for name, (lo, hi) in first.items():
        parameter = F.when(F.col("decoder") == name, F.when(F.col("end") == 0, F.lit(lo)).otherwise(F.lit(hi))).otherwise(parameter)
    return rows.withColumn("parameter", parameter).drop("end")


GENERATIONS = f"""gt AS (SELECT *, {TOKENS} AS tokens, doc_id % 18 // 3 AS c FROM documents WHERE text IS NOT NULL),
gen AS (SELECT 'm' || (doc_id % 3) AS model, doc_id // 18 AS sample_id, CASE WHEN c < 2 THEN 'top_k' WHEN c < 4 THEN 'top_p' ELSE 'min_p' END AS decoder,
  cast(CASE c WHEN 0 THEN 10 WHEN 1 THEN 80 WHEN 2 THEN 0.8 WHEN 3 THEN 0.99 WHEN 4 THEN 0.1 ELSE 0.01 END AS DOUBLE) AS parameter, len(tokens) >= 200 AS reached,
  CASE WHEN len(tokens) > 0 THEN len(list_distinct(tokens)) / len(tokens) ELSE 0.0 END AS ttr, {mtld_sql("tokens")} AS mtld, text FROM gt)"""
GEN_SUMMARY = f"""{GENERATIONS}, gs AS (SELECT model, decoder, parameter, count(*) AS contexts, count(*) FILTER (reached) AS completed, count(*) FILTER (reached) / count(*) AS completion_rate,
{", ".join(f"coalesce(avg({m}) FILTER (reached), 0) AS mean_{m}, coalesce(median({m}) FILTER (reached), 0) AS median_{m}, coalesce(stddev_pop({m}) FILTER (reached), 0) AS sd_{m}" for m in S.METRICS)} FROM gen GROUP BY ALL)"""


@query("ttr", f"WITH {GENERATIONS} SELECT model, sample_id, decoder, parameter, round(ttr, 9) AS ttr FROM gen")
def _(spark, sf_dir):
    return generations(spark, sf_dir).select("model", "sample_id", "decoder", "parameter", "ttr")


@query("mtld", f"SELECT conv_id, turn, round({mtld_sql('tokens')}, 9) AS mtld FROM (SELECT conv_id, turn, {TOKENS} AS tokens FROM conversations WHERE text IS NOT NULL)")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", diversity.mtld(T.lexical_tokens(F.col("text"))).alias("mtld"))


@query("mtld_bidirectional", f"""SELECT doc_id, round(({mtld_sql("tokens")} + {mtld_sql("list_reverse(tokens)")}) / 2, 9) AS mtld
FROM (SELECT doc_id, {TOKENS} AS tokens FROM documents WHERE text IS NOT NULL)""")
def _(spark, sf_dir):
    d = stored.spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))
    return d.select("doc_id", diversity.mtld(T.lexical_tokens(F.col("text")), bidirectional=True).alias("mtld"))


@query("generation_summary", f"""WITH {GEN_SUMMARY} SELECT model, decoder, parameter, contexts, completed, round(completion_rate, 9) AS completion_rate,
{", ".join(f"round(mean_{m}, 9) AS mean_{m}, round(median_{m}, 9) AS median_{m}, round(sd_{m}, 9) AS sd_{m}, round(CASE WHEN completed < 2 THEN mean_{m} ELSE mean_{m} - 1.96 * sd_{m} / sqrt(completed) END, 9) AS {m}_low, round(CASE WHEN completed < 2 THEN mean_{m} ELSE mean_{m} + 1.96 * sd_{m} / sqrt(completed) END, 9) AS {m}_high" for m in S.METRICS)} FROM gs""")
def _(spark, sf_dir):
    return S.generation_summary(generations(spark, sf_dir), ["model", "decoder", "parameter"])


@query("completion_summary", f"""WITH {GEN_SUMMARY}, o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY completion_rate, decoder, parameter) AS i FROM gs)
SELECT model, count(*) AS configurations, round(avg(completion_rate), 9) AS mean_rate, round(min(completion_rate), 9) AS min_rate, round(max(completion_rate), 9) AS max_rate, max(decoder) FILTER (i = 1) AS lowest_decoder, max(parameter) FILTER (i = 1) AS lowest_parameter FROM o GROUP BY model""")
def _(spark, sf_dir):
    return S.completion_summary(S.generation_summary(generations(spark, sf_dir), ["model", "decoder", "parameter"]), ["model"])


@query("metric_outliers", f"""WITH {GENERATIONS}, m AS (SELECT *, 'ttr' AS metric, ttr AS value FROM gen WHERE reached UNION ALL SELECT *, 'mtld', mtld FROM gen WHERE reached),
o AS (SELECT *, row_number() OVER (PARTITION BY model, metric ORDER BY value DESC, sample_id, decoder, parameter) AS i FROM m)
SELECT model, metric, round(value, 9) AS maximum, sample_id, decoder, parameter, left(text, 300) AS text_preview FROM o WHERE i = 1""")
def _(spark, sf_dir):
    return S.outliers(generations(spark, sf_dir), ["model"])


RANK = "rank() OVER (PARTITION BY {b} ORDER BY {v}) + (count(*) OVER (PARTITION BY {b}, {v}) - 1) / 2.0"
PEARSON = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"
COV_JOIN = f"""{CONTEXT_SQL}, {GEN_SUMMARY}, j AS (SELECT 'model-' || right(gs.model, 1) AS model, temperature, gs.decoder, gs.parameter, mean_ttr, mean_mtld, coverage FROM gs JOIN cov ON cov.model = 'model-' || right(gs.model, 1) AND cov.decoder = gs.decoder AND cov.parameter = gs.parameter)"""
JOIN_SQL = f"""{COV_JOIN},
k AS (SELECT model, temperature, 'all_filters' AS filters, * EXCLUDE (model, temperature) FROM j UNION ALL SELECT model, temperature, decoder, * EXCLUDE (model, temperature) FROM j),
v AS (SELECT model, temperature, filters, 'mean_ttr' AS metric, coverage AS x, mean_ttr AS y FROM k UNION ALL SELECT model, temperature, filters, 'mean_mtld', coverage, mean_mtld FROM k),
rk AS (SELECT *, {RANK.format(b="model, temperature, filters, metric", v="x")} AS rx, {RANK.format(b="model, temperature, filters, metric", v="y")} AS ry FROM v)"""


def _joined_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = S.generation_summary(generations(spark, sf_dir), ["model", "decoder", "parameter"]).withColumn("model", F.concat(F.lit("model-"), F.right("model", F.lit(1))))
    return S.with_coverage(summary, context_coverage(spark, sf_dir), ["model", "decoder", "parameter"], extra=["temperature"])


@query("diversity_with_coverage", f"WITH {COV_JOIN} SELECT model, temperature, decoder, parameter, round(mean_ttr, 9) AS mean_ttr, round(mean_mtld, 9) AS mean_mtld, round(coverage, 9) AS coverage FROM j")
def _(spark, sf_dir):
    return _joined_t(spark, sf_dir).select("model", "temperature", "decoder", "parameter", "mean_ttr", "mean_mtld", "coverage")


@query("coverage_correlations", f"""WITH {JOIN_SQL} SELECT model, temperature, filters, metric, count(*) AS n, round({PEARSON.format(x="x", y="y")}, 9) + 0::DOUBLE AS pearson, round({PEARSON.format(x="rx", y="ry")}, 9) + 0::DOUBLE AS spearman
FROM rk GROUP BY model, temperature, filters, metric HAVING count(*) >= 3""")
def _(spark, sf_dir):
    return S.filter_correlations(_joined_t(spark, sf_dir), ["model", "temperature"], ["mean_ttr", "mean_mtld"])


ORDERS = "o AS (SELECT o_orderpriority AS g, cast(o_custkey AS DOUBLE) AS x, o_totalprice AS y, o_orderkey AS k FROM orders)"


@query("group_correlations", f"""WITH {ORDERS}, r AS (SELECT g, x, y, {RANK.format(b="g", v="x")} AS rx, {RANK.format(b="g", v="y")} AS ry FROM o)
SELECT g, 'y' AS metric, count(*) AS n, round({PEARSON.format(x="x", y="y")}, 9) + 0::DOUBLE AS pearson, round({PEARSON.format(x="rx", y="ry")}, 9) + 0::DOUBLE AS spearman FROM r GROUP BY g""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return stats.correlations(o, ["g"], "x", ["y"])


@query("holm", """WITH p AS (SELECT c_nationkey, c_custkey, abs(c_acctbal) / 100000 AS p FROM customer), s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY c_nationkey) AS m FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY p, c_custkey))
SELECT c_nationkey, c_custkey, round(p, 9) AS p, round(least(1, max((m - i + 1) * p) OVER (PARTITION BY c_nationkey ORDER BY i)), 9) AS adjusted FROM s""")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.abs("c_acctbal") / 100000).alias("p"))
    return stats.holm(p, "p", ["c_nationkey"], ["c_custkey"], "adjusted")


#: Wilcoxon's p: exact up to 50 differences without zeros or ties, else normal with a correction for ties.
EXACT_P = """2 * list_sum(list_transform(range(0, cast(floor(s) AS BIGINT) + 1), lambda j: list_reduce(list_prepend(list_prepend(1::DOUBLE, list_transform(range(1, n * (n + 1) // 2 + 1), lambda z: 0::DOUBLE)),
  list_transform(range(1, n + 1), lambda k: [k::DOUBLE])), lambda c, k: list_transform(range(1, len(c) + 1), lambda i: c[i] + CASE WHEN i > k[1] THEN c[i - cast(k[1] AS BIGINT)] ELSE 0 END))[j + 1])) / pow(2::DOUBLE, n)"""
SERIES = "list_sum(list_transform(range(0, 60), lambda k: pow(-1, k) * pow(x, 2 * k + 1) / gamma(k + 1) / (2 * k + 1)))"
FRACTION = "list_reduce(list_prepend(x, list_transform(range(59, 0, -1), lambda k: k::DOUBLE)), lambda f, k: x + k / 2.0::DOUBLE / f)"
ERFC = f"CASE WHEN x < 2.5 THEN 1 - 2 / sqrt(pi()) * {SERIES} ELSE exp(-x * x) / {FRACTION} / sqrt(pi()) END"
PAIRED = f"""{GENERATIONS}, e AS (SELECT a.model, a.decoder, b.ttr - a.ttr AS d1, b.mtld - a.mtld AS d2 FROM gen AS a JOIN gen AS b USING (model, sample_id, decoder) WHERE a.reached AND b.reached
  AND (a.decoder, a.parameter, b.parameter) IN (('top_k', 10, 80), ('top_p', cast(0.8 AS DOUBLE), cast(0.99 AS DOUBLE)), ('min_p', cast(0.1 AS DOUBLE), cast(0.01 AS DOUBLE)))),
d AS (SELECT model, decoder, 'ttr' AS metric, d1 AS d FROM e UNION ALL SELECT model, decoder, 'mtld', d2 FROM e),
r AS (SELECT model, decoder, metric, d, {RANK.format(b="model, decoder, metric", v="abs(d)")} AS r, count(*) OVER (PARTITION BY model, decoder, metric, abs(d)) AS t FROM d WHERE d <> 0),
w AS (SELECT model, decoder, metric, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS s, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY ALL),
g AS (SELECT model, decoder, metric, count(*) AS pairs, avg(d) AS mean_difference, median(d) AS median_difference FROM d GROUP BY ALL),
z AS (SELECT *, abs(s - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) / sqrt(2) AS x FROM g LEFT JOIN w USING (model, decoder, metric)),
pe AS (SELECT model, decoder, metric, pairs, mean_difference, median_difference, coalesce(s, 0) AS statistic,
  least(1, CASE WHEN n IS NULL THEN 1 WHEN pairs = n AND ties = 0 AND n <= 50 THEN {EXACT_P} ELSE {ERFC} END) AS p FROM z)"""


@query("paired_effects", f"WITH {PAIRED} SELECT model, decoder, metric, pairs, round(mean_difference, 9) AS mean_difference, round(median_difference, 9) AS median_difference, round(statistic, 9) AS statistic, round(p, 9) AS p FROM pe")
def _(spark, sf_dir):
    e = S.paired_effects(generations(spark, sf_dir), ["model"], grids.ENDPOINTS)
    return e.select("model", "decoder", "metric", "pairs", "mean_difference", "median_difference", "statistic", "p")


@query("paired_effects_holm", f"""WITH {PAIRED}, s AS (SELECT *, row_number() OVER (ORDER BY p, model, decoder, metric) AS i, count(*) OVER () AS m FROM pe)
SELECT model, decoder, metric, pairs, round(mean_difference, 9) AS mean_difference, round(median_difference, 9) AS median_difference, round(statistic, 9) AS statistic, round(p, 9) AS p,
  round(least(1, max((m - i + 1) * p) OVER (ORDER BY i)), 9) AS p_holm FROM s""")
def _(spark, sf_dir):
    e = S.paired_effects(generations(spark, sf_dir), ["model"], grids.ENDPOINTS)
    e = e.select("model", "decoder", "metric", "pairs", "mean_difference", "median_difference", "statistic", "p")
    return stats.holm(e, "p", [], ["model", "decoder", "metric"], "p_holm")


@query("pooled_spearman", f"""WITH {COV_JOIN}, pr AS (SELECT model, temperature, {RANK.format(b="model, temperature", v="coverage")} AS rx, {RANK.format(b="model, temperature", v="mean_ttr")} AS ry FROM j),
c AS (SELECT model, rx - avg(rx) OVER (PARTITION BY model, temperature) AS x, ry - avg(ry) OVER (PARTITION BY model, temperature) AS y FROM pr),
sums AS (SELECT model, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, row_number() OVER (ORDER BY model) - 1 AS k FROM c GROUP BY model), z AS (SELECT count(*) AS m FROM sums),
dr AS (SELECT d, cast('0x' || substr(md5('10298|' || d || '|' || q), 1, 8) AS BIGINT) % m AS k FROM z, range(1, 10001) AS a(d), range(1, 101) AS b(q) WHERE q <= m),
st AS (SELECT d, sum(xy) / nullif(sqrt(sum(xx) * sum(yy)), 0) AS v FROM dr JOIN sums USING (k) GROUP BY d)
SELECT round(sum(xy) / nullif(sqrt(sum(xx) * sum(yy)), 0), 9) AS rho, count(*) AS clusters, (SELECT round(quantile_cont(v, 0.025), 9) FROM st) AS low, (SELECT round(quantile_cont(v, 0.975), 9) FROM st) AS high FROM sums""")
def _(spark, sf_dir):
    return S.pooled_spearman(S.panel_ranks(_joined_t(spark, sf_dir), ["model", "temperature"], "mean_ttr"), "model", 10_000)


@query("cluster_bootstrap", """WITH s AS (SELECT o_orderpriority AS g, o_custkey % 40 AS k, sum(o_totalprice) AS t, cast(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS i FROM s), z AS (SELECT g, count(*) AS m FROM s GROUP BY g),
dr AS (SELECT g, d, cast('0x' || substr(md5('7|' || d || '|' || q), 1, 8) AS BIGINT) % m AS i FROM z, range(1, 2001) AS a(d), range(1, 41) AS b(q) WHERE q <= m),
st AS (SELECT dr.g, d, sum(t) / sum(n) AS v FROM dr JOIN num ON num.g = dr.g AND num.i = dr.i GROUP BY ALL)
SELECT g, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM st GROUP BY g""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 40).alias("k")).agg(F.sum("o_totalprice").alias("t"), F.count("*").cast("double").alias("n"))
    b = stats.cluster_bootstrap(o, ["g"], "k", ["t", "n"], F.col("t") / F.col("n"), 2_000, 7)
    return b.select("g", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("permutation_p", f"""WITH {COV_JOIN}, po AS (SELECT model, temperature, coverage AS x, mean_ttr AS y, row_number() OVER (PARTITION BY model, temperature ORDER BY decoder || '|' || printf('%08.3f', parameter)) AS i FROM j),
ob AS (SELECT model, temperature, {PEARSON.format(x="x", y="y")} AS observed FROM po GROUP BY ALL),
pk AS (SELECT model, temperature, d, y, row_number() OVER (PARTITION BY model, temperature, d ORDER BY cast('0x' || substr(md5('13|' || d || '|' || i), 1, 8) AS BIGINT), i) AS i FROM po, range(1, 10001) AS a(d)),
pr AS (SELECT pk.model, pk.temperature, d, {PEARSON.format(x="po.x", y="pk.y")} AS r FROM pk JOIN po USING (model, temperature, i) GROUP BY ALL)
SELECT ob.model, ob.temperature, round(observed, 9) AS observed, round((count(*) FILTER (abs(r) >= abs(observed) - 1e-12) + 1) / 10001.0, 9) AS p FROM ob JOIN pr ON pr.model = ob.model AND pr.temperature = ob.temperature GROUP BY ob.model, ob.temperature, observed""")
def _(spark, sf_dir):
    j = _joined_t(spark, sf_dir).withColumn("o", F.concat_ws("|", "decoder", F.format_string("%08.3f", F.col("parameter"))))
    return stats.permutation_p(j, ["model", "temperature"], "o", "coverage", "mean_ttr", 10_000)


# ---- maintenance ---------------------------------------------------------------------------------

def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return d.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("lang", F.lit("xx"))


@query("changed_samples", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL")
def _(spark, sf_dir):
    return R.changed(table(spark, sf_dir, "documents"), edited(spark, sf_dir), "doc_id", ["text", "source"])


@query("merged_audit", f"WITH {AUDIT} SELECT sample_id, temperature, word_token_index, CASE WHEN sample_id % 5 = 0 THEN rank + 1000 ELSE rank END AS rank FROM audit WHERE NOT (sample_id % 5 = 0 AND word_token_index = 1)")
def _(spark, sf_dir):
    a = audit(spark, sf_dir).select("sample_id", "temperature", "word_token_index", F.col("rank").cast("long").alias("rank"))
    delta = a.where("sample_id % 5 = 0 and word_token_index = 0").withColumn("rank", F.col("rank") + 1000)
    return R.merged(a, delta, delta.select("sample_id").distinct(), "sample_id")


@query("replacement_match", """WITH d AS (SELECT d.doc_id, d.source AS word, d.n_chars, l.doc_id IS NOT NULL AS labelled, coalesce(l.quality = 1 AND l.toxic = 0, false) AS accepted FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id),
rej AS (SELECT doc_id AS sample_id, word, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS turn FROM d WHERE labelled AND NOT accepted),
c AS (SELECT doc_id AS candidate, word, n_chars FROM d WHERE NOT labelled AND n_chars NOT IN (SELECT n_chars FROM d WHERE accepted AND n_chars IS NOT NULL)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n_chars ORDER BY candidate) AS k FROM c) WHERE k = 1), t AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY candidate) AS turn FROM u)
SELECT sample_id, word, candidate, n_chars FROM rej JOIN t USING (word, turn)""")
def _(spark, sf_dir):
    decisions = table(spark, sf_dir, "labels").select("doc_id", F.coalesce(F.expr("quality = 1 and toxic = 0"), F.lit(False)).alias("accepted"))
    d = table(spark, sf_dir, "documents").join(decisions, "doc_id", "left")
    rejected = d.where("not accepted").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("word"))
    candidates = d.where("accepted is null").select(F.col("doc_id").alias("candidate"), F.col("source").alias("word"), "n_chars")
    return R.replacements(rejected, candidates, d.where("accepted").select("n_chars"), ["n_chars"], [F.col("candidate")]).select("sample_id", "word", "candidate", "n_chars")


REASON = "CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low_quality' END"


@query("decision_reasons", f"SELECT reason, count(*) AS decisions, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' ELSE {REASON} END AS reason FROM labels) GROUP BY reason")
def _(spark, sf_dir):
    return R.decision_reasons(table(spark, sf_dir, "labels"), F.expr("quality = 1 and toxic = 0"), F.expr(REASON))


@query("rejection_examples", f"""WITH r AS (SELECT l.doc_id, {REASON} AS reason, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM labels AS l JOIN documents AS d ON d.doc_id = l.doc_id WHERE NOT (quality = 1 AND toxic = 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS n FROM r) SELECT reason, n, doc_id, CASE WHEN length(x) > 80 THEN '…' || right(x, 80) ELSE x END AS excerpt FROM n WHERE n <= 5""")
def _(spark, sf_dir):
    log = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return R.rejection_examples(log, F.expr("quality = 1 and toxic = 0"), F.expr(REASON), 5, [F.col("doc_id")], "text", 80).select("reason", "n", "doc_id", "excerpt")


# ---- selection and resumption --------------------------------------------------------------------

SAMPLES = "sam AS (SELECT doc_id AS sample_id, coalesce(source, '') AS word, n_chars FROM documents)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples; the source is the word."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.coalesce("source", F.lit("")).alias("word"), "n_chars")


@query("resume_skip", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, sf_dir):
    return L.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("full_groups", f"WITH {CONTEXTS}, q AS (SELECT word, doc_id, start, row_number() OVER (PARTITION BY word ORDER BY doc_id, start) AS n FROM ctx) SELECT word, doc_id, start FROM q WHERE n <= 40 AND word IN (SELECT word FROM q WHERE n <= 40 GROUP BY word HAVING count(*) = 40)")
def _(spark, sf_dir):
    c = contexts(spark, sf_dir).select("word", "doc_id", "start")
    return L.full_groups(stored.written(C.per_word(c, 40, [F.col("doc_id"), F.col("start")])), "word", 40)


@query("in_all_temperatures", f"WITH {PATHS} SELECT sample_id FROM checked WHERE survives AND decoder = 'top_p' AND parameter = 0.9 GROUP BY sample_id HAVING count(DISTINCT temperature) = 3")
def _(spark, sf_dir):
    kept = V.on_grid(paths(spark, sf_dir), grids.grid(spark)).where("survives and decoder = 'top_p' and parameter = 0.9D")
    return L.in_all(kept, "sample_id", "temperature", TEMPERATURES)


@query("audit_with_samples", f"WITH {AUDIT}, {SAMPLES} SELECT a.sample_id, a.temperature, a.word_token_index, a.rank, a.word, s.n_chars FROM audit AS a JOIN sam AS s ON s.sample_id = a.sample_id")
def _(spark, sf_dir):
    a = audit(spark, sf_dir).select("sample_id", "temperature", "word_token_index", "rank", "word")
    return L.with_samples(a, samples(spark, sf_dir))


@query("word_metadata", f"WITH {SAMPLES}, w AS (SELECT word, min(sample_id) AS first_order, count(*) AS contexts FROM sam GROUP BY word) SELECT *, dense_rank() OVER (ORDER BY first_order) AS word_order FROM w")
def _(spark, sf_dir):
    return L.word_metadata(samples(spark, sf_dir), "sample_id")


@query("first_words", f"WITH {SAMPLES}, w AS (SELECT word FROM sam GROUP BY word ORDER BY min(sample_id), word LIMIT 3) SELECT * FROM sam WHERE word IN (SELECT word FROM w)")
def _(spark, sf_dir):
    return L.first_words(samples(spark, sf_dir), "sample_id", 3)


@query("select_rows", f"WITH {AUDIT} SELECT model, temperature, sample_id, word_token_index, rank FROM audit WHERE model IN ('model-0', 'model-1') AND model <> 'model-1' AND word IN (SELECT 'w' || n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(spark, sf_dir):
    words = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.concat(F.lit("w"), "n_nationkey").alias("word"))
    return L.select_rows(audit(spark, sf_dir), ["model-0", "model-1"], ["model-1"], words).select("model", "temperature", "sample_id", "word_token_index", "rank")


@query("rank_band_found", "SELECT coalesce(first(n_chars ORDER BY doc_id) FILTER (n_chars IS NOT NULL AND quality_min IS NOT NULL), min(n_chars)) AS low, max(n_chars) AS high FROM (SELECT d.doc_id, n_chars, l.quality AS quality_min FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id)")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = d.select(F.col("doc_id").alias("position"), F.when(F.col("quality").isNotNull(), F.col("n_chars")).alias("rank_min"), F.lit(None).cast("long").alias("rank_max"), F.col("n_chars").alias("rank"))
    return L.band_of(rows)


@query("audit_identity", f"WITH {AUDIT} SELECT array_to_string(list_sort(list(DISTINCT model)), ',') AS models, count(DISTINCT sample_id) AS samples, count(DISTINCT model) = 3 AND count(DISTINCT temperature) = 3 AS valid FROM audit")
def _(spark, sf_dir):
    return L.audit_identity(audit(spark, sf_dir), "sample_id", 3, TEMPERATURES).select(F.array_join("models", ",").alias("models"), "samples", "valid")


@query("word_order", f"WITH {SAMPLES} SELECT word, row_number() OVER (ORDER BY lower(word), word) AS place FROM (SELECT DISTINCT word FROM sam)")
def _(spark, sf_dir):
    return L.word_order(samples(spark, sf_dir).select("word").distinct())


@query("renamed_predictions", f"""WITH {AUDIT}, x AS (SELECT sample_id, word_token_index, temperature, unnest(p) AS v, unnest(range(0, len(p))) AS id FROM audit),
o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, word_token_index, temperature ORDER BY v DESC, id) AS place FROM x)
SELECT sample_id, word_token_index, temperature, place AS rank, id, round(v, 9) AS p FROM o WHERE place <= 5""")
def _(spark, sf_dir):
    a = audit(spark, sf_dir).select("sample_id", "word_token_index", "temperature", F.explode(L.renamed_predictions(F.col("top_tokens"))).alias("x"))
    return a.select("sample_id", "word_token_index", "temperature", "x.*")


@query("expected_samples", "SELECT least(count(*), 700) AS expected FROM documents")
def _(spark, sf_dir):
    return L.expected_samples(samples(spark, sf_dir), 700)


@query("compact_extremes", f"""WITH {AUDIT} SELECT model, temperature, sample_id, max(rank) AS worst_rank, printf('%.7e', max(cumulative - probability)) AS mass_above,
printf('%.7e', min(ratio)) AS min_ratio, printf('%.7e', product(probability)) AS path_probability, count(*) AS n_tokens FROM audit GROUP BY ALL""")
def _(spark, sf_dir):
    # As text, so that all eight digits are compared, however small a number is.
    c = L.compact_extremes(audit(spark, sf_dir), ["model", "temperature", "sample_id"])
    return c.withColumns({x: F.format_string("%.7e", x) for x in ("mass_above", "min_ratio", "path_probability")})


@query("running_offsets", "SELECT page_id, length(html) AS size, coalesce(sum(length(html) + 1) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM pages")
def _(spark, sf_dir):
    return L.running_offsets(table(spark, sf_dir, "pages"), "page_id", F.length("html"))


@query("frequency_curve", f"WITH {FREQUENCY} SELECT rank, word, count, round(log10(rank), 9) AS log_rank, round(log10(count), 9) AS log_count FROM ranked WHERE (rank - 1) % 50 = 0 OR rank = (SELECT max(rank) FROM ranked)")
def _(spark, sf_dir):
    curve = L.every_kth(C.ranked(frequency(spark, sf_dir)), "rank", 50)
    return curve.select("rank", "word", "count", F.log10("rank").alias("log_rank"), F.log10("count").alias("log_count"))


@query("repaired_prefixes", f"WITH {CONTEXTS} SELECT word, doc_id, start, prefix FROM ctx")
def _(spark, sf_dir):
    broken = stored.written(contexts(spark, sf_dir).select("word", "doc_id", "start"))
    return L.repaired_prefixes(broken, table(spark, sf_dir, "documents"), CONTEXT).select("word", "doc_id", "start", "prefix")


@query("suite_manifest", f"WITH {AUDIT}, m AS (SELECT 'model-' || r_regionkey AS model FROM region), c AS (SELECT model, count(DISTINCT sample_id) AS samples FROM audit GROUP BY model) SELECT m.model, coalesce(c.samples, 0) AS samples, coalesce(c.samples, 0) >= 84 AS complete FROM m LEFT JOIN c ON c.model = m.model")
def _(spark, sf_dir):
    suite = table(spark, sf_dir, "region").select(F.concat(F.lit("model-"), "r_regionkey").alias("model"))
    return L.suite_manifest(suite, audit(spark, sf_dir), 84)


@query("corpus_fallback", """WITH n AS (SELECT source AS word, 5 AS lack FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 5),
c AS (SELECT d.source AS word, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS i FROM documents AS d JOIN n ON n.word = d.source) SELECT word, doc_id FROM c WHERE i <= 5""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("word"), "doc_id").where("word is not null")
    short = d.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5").select("word", F.lit(6).alias("needed"), F.lit(1).alias("found"))
    return L.fallback(short, d, [F.col("doc_id")])


TALK = f"talk AS (SELECT role, conv_id, turn, {TOKENS} AS tokens FROM conversations WHERE text IS NOT NULL)"


@query("open_generation_summary", f"""WITH {TALK}, each AS (SELECT role, conv_id, turn, tokens, CASE WHEN len(tokens) > 0 THEN len(list_distinct(tokens)) / len(tokens) ELSE 0 END AS r, {mtld_sql("tokens")} AS m FROM talk),
g AS (SELECT role, count(*) AS samples, avg(r) AS mean_ttr, avg(m) AS mean_mtld, flatten(list(tokens ORDER BY conv_id, turn)) AS tokens FROM each GROUP BY role)
SELECT role, samples, len(tokens) AS tokens, round(mean_ttr, 9) AS mean_ttr, round(mean_mtld, 9) AS mean_mtld, round(len(list_distinct(tokens)) / len(tokens), 9) AS pooled_ttr, round({mtld_sql("tokens")}, 9) AS pooled_mtld FROM g""")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").withColumn("tokens", T.lexical_tokens(F.col("text")))
    return S.open_generation_summary(c, ["role"], ["conv_id", "turn"], "tokens")


@query("coverage_ci_by_tokens", f"""WITH {PATHS}, c AS (SELECT *, 2 + sample_id % 2 AS nt FROM checked WHERE (decoder, parameter) IN (('top_k', 20), ('top_p', cast(0.9 AS DOUBLE)), ('min_p', cast(0.05 AS DOUBLE)))),
s AS (SELECT model, temperature, decoder, parameter, t AS n_tokens, word, cast(count(*) FILTER (survives) AS DOUBLE) AS covered, cast(count(*) AS DOUBLE) AS total FROM (SELECT *, unnest([0, nt]) AS t FROM c) GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY model, temperature, decoder, parameter, n_tokens ORDER BY word) - 1 AS i FROM s),
z AS (SELECT model, temperature, decoder, parameter, n_tokens, count(*) AS m, sum(covered) AS covered, sum(total) AS total FROM s GROUP BY ALL),
dr AS (SELECT z.* EXCLUDE (covered, total), d, cast('0x' || substr(md5('13|' || d || '|' || q), 1, 8) AS BIGINT) % m AS i FROM z, range(1, 2001) AS a(d), range(1, 101) AS b(q) WHERE q <= m),
st AS (SELECT model, temperature, decoder, parameter, n_tokens, d, sum(covered) / sum(total) AS v FROM dr JOIN num USING (model, temperature, decoder, parameter, n_tokens, i) GROUP BY ALL),
ci AS (SELECT model, temperature, decoder, parameter, n_tokens, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM st GROUP BY ALL)
SELECT z.model, z.temperature, z.decoder, z.parameter, z.n_tokens, z.covered, z.total, round(z.covered / z.total, 9) AS coverage, round(low, 9) AS low, round(high, 9) AS high
FROM z JOIN ci USING (model, temperature, decoder, parameter, n_tokens)""")
def _(spark, sf_dir):
    p = paths(spark, sf_dir).withColumn("n_tokens", F.expr("2 + sample_id % 2"))
    points = grids.grid(spark, [("top_k", 20.0), ("top_p", 0.9), ("min_p", 0.05)])
    return S.coverage_by_tokens(p, points, ["model", "temperature"], 2_000, 13)


WORD_COUNTS = "wc AS (SELECT 'w' || (o_custkey % 20) AS word, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, 'w' || (o_custkey % 20)) AS rank FROM orders GROUP BY o_custkey % 20)"


@query("rank_correlations", f"""WITH {PATHS}, {WORD_COUNTS}, m AS (SELECT model, temperature, word, avg(cast(survives AS INT)) AS score FROM checked GROUP BY ALL),
j AS (SELECT model, temperature, score, cast(rank AS DOUBLE) AS r, log10(count) AS c FROM m JOIN wc USING (word)),
v AS (SELECT model, temperature, 'rank' AS metric, score AS x, r AS y FROM j UNION ALL SELECT model, temperature, 'log_count', score, c FROM j),
rk AS (SELECT *, {RANK.format(b="model, temperature, metric", v="x")} AS rx, {RANK.format(b="model, temperature, metric", v="y")} AS ry FROM v)
SELECT model, temperature, metric, count(*) AS n, round({PEARSON.format(x="x", y="y")}, 9) + 0::DOUBLE AS pearson, round({PEARSON.format(x="rx", y="ry")}, 9) + 0::DOUBLE AS spearman FROM rk GROUP BY model, temperature, metric""")
def _(spark, sf_dir):
    checked = V.on_grid(paths(spark, sf_dir), grids.grid(spark))
    score = checked.groupBy("model", "temperature", "word").agg(F.avg(F.col("survives").cast("int")).alias("score"))
    counts = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("w"), F.col("o_custkey") % 20).alias("word")).agg(F.count("*").alias("count"))
    j = score.join(C.ranked(counts), "word").where("count > 0").select("model", "temperature", "score", F.col("rank").cast("double").alias("rank"), F.log10("count").alias("log_count"))
    return stats.correlations(j, ["model", "temperature"], "score", ["rank", "log_count"])


FAMILY = """row_number() OVER (ORDER BY p, model, decoder, metric) AS i, count(*) OVER () AS m"""


@query("family_without_model", f"""WITH {PAIRED}, s AS (SELECT *, {FAMILY} FROM pe WHERE model <> 'm1'), h AS (SELECT *, least(1, max((m - i + 1) * p) OVER (ORDER BY i)) AS p_holm FROM s)
SELECT model, decoder, metric, round(p, 9) AS p, round(p_holm, 9) AS p_holm, p_holm < 0.05 AS significant FROM h""")
def _(spark, sf_dir):
    rows = generations(spark, sf_dir).where("model <> 'm1'")  # tests are of one model each
    e = S.paired_effects(rows, ["model"], grids.ENDPOINTS).select("model", "decoder", "metric", "p")
    return S.family(e, ["model", "decoder", "metric"], exclude=["m1"])


@query("significance_counts", f"""WITH {PAIRED}, s AS (SELECT *, {FAMILY} FROM pe), h AS (SELECT *, least(1, max((m - i + 1) * p) OVER (ORDER BY i)) AS p_holm FROM s)
SELECT metric, count(*) AS tests, count(*) FILTER (p_holm < 0.05) AS significant FROM h GROUP BY metric""")
def _(spark, sf_dir):
    e = S.paired_effects(generations(spark, sf_dir), ["model"], grids.ENDPOINTS).select("model", "decoder", "metric", "p")
    return S.significance_counts(S.family(e, ["model", "decoder", "metric"]), ["metric"])


#: Letters of a text as token ids below the length of an embedding.
LETTER_IDS = "list_transform(string_split({}, ''), lambda c: ascii(c) % 32)"


@query("forced_paths", f"""WITH s AS (SELECT c_custkey AS sample_id, {LETTER_IDS.format("c_mktsegment")} AS p, {LETTER_IDS.format("' ' || n_name")} AS w FROM customer JOIN nation ON n_nationkey = c_nationkey),
st AS (SELECT sample_id, p, w, unnest(range(0, len(w))) AS i FROM s),
c AS (SELECT sample_id, i, w[i + 1] AS token_id, list_concat(p, w[1:i]) AS context FROM st),
v AS (SELECT *, list_sum(list_transform(range(1, len(context) + 1), lambda k: k * context[k])) % (SELECT count(*) FROM embeddings) AS vec FROM c),
n AS (SELECT DISTINCT vec, token_id, temperature FROM v, (VALUES (cast(0.7 AS DOUBLE)), (cast(1.0 AS DOUBLE)), (cast(1.5 AS DOUBLE))) AS t(temperature)),
x AS (SELECT n.*, list_transform(embedding, lambda z: exp(cast(z AS DOUBLE) * 8 / temperature)) AS e FROM n JOIN embeddings ON vec_id = vec),
a AS (SELECT vec, token_id, temperature, e[token_id + 1] / list_sum(e) AS probability, len(list_filter(e, lambda z: z > e[token_id + 1])) + 1 AS rank FROM x)
SELECT sample_id, i AS word_token_index, v.token_id, temperature, rank, round(probability, 9) AS probability FROM v JOIN a ON a.vec = v.vec AND a.token_id = v.token_id""")
def _(spark, sf_dir):
    letters = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: (F.ascii(x) % 32).cast("int"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    samples = rows.select(F.col("c_custkey").alias("sample_id"), letters(F.col("c_mktsegment")).alias("prefix_ids"), letters(F.concat(F.lit(" "), "n_name")).alias("word_ids"))
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()

    def scorer(nodes: DataFrame) -> DataFrame:  # the vector whose id follows from the context stands for a model's scores
        total = F.aggregate(F.transform("context", lambda x, k: (k + 1) * x), F.lit(0), lambda a, x: a + x)
        scores = vectors.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 8).alias("logits"))
        return nodes.withColumn("_vec", total % n).join(scores, F.col("_vec") == F.col("vec_id")).drop("_vec", "vec_id")

    a = forced.forced_audit(samples, scorer, TEMPERATURES)
    return a.select("sample_id", "word_token_index", "token_id", "temperature", "rank", "probability")


# ---- streams -------------------------------------------------------------------------------------

@query("incremental_contexts", f"WITH {CONTEXTS} SELECT word, doc_id, start, prefix FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id, start) AS n FROM ctx) WHERE n <= 12")
def _(spark, sf_dir):
    # The corpus arrives in four parts by ids, some of it twice; each call takes up the stream from its checkpoint.
    found = stored.written(contexts(spark, sf_dir).select("word", "doc_id", "start", "prefix"))
    last = found.agg(F.max("doc_id")).first()[0]
    arrivals, sink, checkpoint = (stored.folder(spark) for _ in range(3))
    part = F.floor(F.col("doc_id") * 4 / (last + 1)) if last is not None else F.lit(0)
    for k in range(4):
        found.where((part == k) | (part == k - 1)).write.mode("append").parquet(arrivals)
        candidates.collect_available(spark, candidates.grown(spark, arrivals), 12, sink, checkpoint)
    return spark.read.schema(candidates.OUT).parquet(sink)


# ---- sources -------------------------------------------------------------------------------------

@query("payload_strings", """WITH s AS (SELECT conv_id, turn, unnest([1, 2]) AS k, unnest([role, text]) AS text FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS place, text FROM s WHERE text IS NOT NULL""")
def _(spark, sf_dir):
    # Each conversation as a JSON object whose turns hold a member that isn't text.
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("conv_id").alias("URL"), "text")))
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.col("conv_id").alias("id"), turns.alias("turns"))).alias("text"))
    strings = payload.json_strings(packed, "conv_id", "text")
    return strings.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("place")))


@query("numbered_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13))),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM l)
SELECT row_number() OVER (ORDER BY doc_id, i) AS row, line FROM x""")
def _(spark, sf_dir):
    # All texts as files of lines in order of ids, numbered through; texts with a carriage return would split elsewhere.
    docs = table(spark, sf_dir, "documents").where("text is not null and not contains(text, chr(13))").select("doc_id", "text")
    path = stored.folder(spark)
    docs.orderBy("doc_id").select("text").write.option("compression", "none").text(path)
    rows = readers.lines(spark, path)
    sizes = ordered.sorted_rows(rows.groupBy("path").agg(F.max("row").alias("n")), [], ["path"])
    before = ordered.plain(ordered.running(sizes, [], F.col("n"), "before", inclusive=False))
    return rows.join(before, "path").select((F.col("before") + F.col("row")).alias("row"), "line")


def saved_pages(spark: SparkSession, sf_dir: str) -> str:
    """All documents as the pages of a catalogue, 40 rows each."""
    row = F.struct(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("language"), "text")
    pages = table(spark, sf_dir, "documents").groupBy(F.expr("doc_id div 40").alias("page")).agg(F.sort_array(F.collect_list(row)).alias("results"))
    path = stored.folder(spark)
    pages.select(F.to_json(F.struct("page", "results")).alias("value")).write.option("compression", "none").text(path)
    return path


@query("paged_catalogue", "SELECT doc_id AS id, source AS title, length(text) AS size FROM documents WHERE lang IN ('es', 'fr') AND source IS NOT NULL AND doc_id > 100")
def _(spark, sf_dir):
    rows = paged.read_pages(spark, saved_pages(spark, sf_dir))
    return rows.where("language in ('es', 'fr') and title is not null and id > 100").select("id", "title", F.length("text").alias("size"))


@query("catalogue_skips", """SELECT CASE WHEN lang IS DISTINCT FROM 'es' THEN 'language' WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty' WHEN length(trim(text)) < 2000 THEN 'short' ELSE 'kept' END AS outcome, count(*) AS rows
FROM documents GROUP BY ALL""")
def _(spark, sf_dir):
    kept, skipped = readers.exportable(paged.read_pages(spark, saved_pages(spark, sf_dir)), "text", "language", 2000)
    found = kept.select(F.lit("kept").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("rows"))
    return found.union(skipped.select("skipped", "rows"))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit with what its schema records of it."""
    return audit(spark, sf_dir).withColumns({"audit_schema_version": F.lit(2), "rank_neighbor_count": F.lit(1)})


@query("audit_validity", f"""WITH {AUDIT} SELECT model, count(DISTINCT sample_id) AS samples, true AS rows_valid, count(DISTINCT sample_id) = 84 AS valid FROM audit GROUP BY model""")
def _(spark, sf_dir):
    return A.validity(recorded(spark, sf_dir), 84, 5, 1, by=["model"])


@query("published_audit", f"""WITH {AUDIT} SELECT model, temperature, sample_id, word_token_index, rank FROM audit""")
def _(spark, sf_dir):
    rows, path = stored.written(recorded(spark, sf_dir)), stored.folder(spark)
    samples = rows.select("sample_id").distinct().count()
    check = lambda df: A.validity(df, samples, 5, 1)
    publish.publish(rows, path, check)
    try:  # a version that lacks a field of one model is refused, and the first one stays
        publish.publish(rows.withColumn("audit_schema_version", F.when(F.col("model") != "model-1", 2)), path, check)
    except publish.Refused:
        pass
    return publish.read(spark, path, rows.schema).select("model", "temperature", "sample_id", "word_token_index", "rank")


@query("merged_directories", f"""WITH {AUDIT} SELECT model, temperature, sample_id, word_token_index, CASE WHEN sample_id % 5 = 0 THEN rank + 1000 ELSE rank END AS rank FROM audit""")
def _(spark, sf_dir):
    # Audits exported by temperature; a delta with all rows of each fifth sample.
    columns = ["model", "temperature", "sample_id", "word_token_index", "rank"]
    rows = stored.written(audit(spark, sf_dir).select(*columns).withColumn("audit", F.format_string("run/audit.t%.1f.jsonl", "temperature")))
    as_lines = lambda df: df.select("audit", "sample_id", "word_token_index", F.to_json(F.struct(*columns)).alias("line"))
    again = rows.where("sample_id % 5 = 0").withColumn("rank", F.col("rank") + 1000)
    base, delta, out = (stored.folder(spark) for _ in range(3))
    merge.write_audits(as_lines(rows), ["sample_id", "word_token_index"], base)
    merge.write_audits(as_lines(again), ["sample_id", "word_token_index"], delta)
    merge.merge_directories(spark, base, delta, out, again.select("sample_id"))
    schema = "model string, temperature double, sample_id long, word_token_index long, rank long"
    return merge.audit_lines(spark, out).select(F.from_json("line", schema).alias("r")).select("r.*")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
