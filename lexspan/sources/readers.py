"""Readers: frequency lists, dictionaries, corpora, books, audits, payload files, summaries."""

from __future__ import annotations

import csv
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexspan import ordered, stored
from lexspan.functions import text as T
from lexspan.sources import payload

AUDIT = (
    "sample_id string, model string, temperature double, word string, word_rank int, word_token_index int, token_id int, rank int, token_text string, source_path string, probability double, top_probability double, "
    "probability_ratio_to_top double, cumulative_probability double, context_token_count int, prefix_char_count int, word_token_count int, audit_schema_version int, rank_neighbor_count int, "
    "top_5_tokens array<string>, top_5_probs array<double>")
GENERATION = "sample_id string, model string, model_slug string, temperature double, decoder string, parameter double, reached_target_words boolean, ttr double, mtld double, text string"
SAMPLE = "id string, word string, rank int, count long, prefix string, raw_excerpt string, matched_text string, source_path string, match_start_char int, match_end_char int, context_token_count int, search_start_char long, metadata map<string,string>"
#: Names that columns of book tables go by.
TEXT_COLUMNS, LANGUAGE_COLUMNS, ID_COLUMNS = ("text", "content", "body"), ("real_lang", "lang", "language"), ("identifier", "id", "title")


def lines(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """path, row (from 1), line of text files of any size, a byte order mark before the first line left out.

    Files are read in splits. Each split's lines are counted, the counts before it in its file are added
    up, and lines are numbered within it: only one number for each split is shuffled, never a line.
    """
    raw = spark.read.options(**options).text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    splits = stored.small(splits.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n"))
    out = rows.join(splits, ["path", "_block"]).withColumn("row", (F.col("_before") + F.col("_id") - F.col("_first") + 1))
    line = F.when(F.col("row") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return out.select("path", "row", line.alias("line"))


def frequency_fields(line: Column) -> Column:
    """rank, word, count of a line, by its shape; a null word where it has none (a header)."""
    cut = F.when(line.contains(","), F.split(F.replace(line, F.lit('"'), F.lit("")), ",")).when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, r"(?U)\s+"))
    f = F.filter(F.transform(cut, T.strip), lambda x: x != "")
    low = F.transform(f, F.lower)
    header = F.array_contains(low, "word") & (F.array_contains(low, "rank") | F.array_contains(low, "count"))
    number = lambda c: F.coalesce(c.rlike(r"^\d+$"), F.lit(False))
    a, b, c = (F.get(f, F.lit(i)) for i in range(3))
    n = F.size(f)
    ranked = (n >= 2) & number(a)
    word = F.when(ranked, b).otherwise(a)
    count = F.when(ranked, F.when(number(c), c)).otherwise(F.when((n >= 2) & number(b), b))
    return F.struct(F.when(ranked, a.try_cast("int")).alias("rank"), F.when(~header & (n > 0), T.normalize_word(word)).alias("word"), count.try_cast("long").alias("count"))


def read_frequency(spark: SparkSession, path: str) -> DataFrame:
    """rank, word, count of a list; lines without a rank take their place among the list's lines, others fail the query."""
    rows = lines(spark, path).withColumn("line", T.strip(F.col("line"))).where("line <> '' and line not like '#%'").withColumn("f", frequency_fields(F.col("line")))
    bad = F.raise_error(F.concat(F.lit("could not parse frequency row "), F.col("row").cast("string"))).cast("string")
    # A list's lines are counted in ranges; no task sorts a whole list.
    rows = ordered.plain(ordered.running(ordered.sorted_rows(rows, ["path"], ["row"]), ["path"], F.lit(1).cast("long"), "place"))
    place = F.col("place").cast("int")
    word = F.when(F.coalesce(F.col("f.word"), F.lit("")) == "", bad).otherwise(F.col("f.word"))
    return rows.select(F.coalesce(F.nullif(F.col("f.rank"), F.lit(0)), place).alias("rank"), word.alias("word"), F.col("f.count").alias("count"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(T.normalize_word(F.col("line")).alias("word")).where("word <> ''").distinct()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """source_path, text of all .txt and .text files below a path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,text}").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def _first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.nullif(T.strip(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def read_books(spark: SparkSession, path: str, spanish_only: bool = True, min_words: int = 0) -> DataFrame:
    """book_id, language, text of Parquet shards, whatever their columns are called."""
    raw = spark.read.parquet(path)
    shard = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)[^/\d]*\.parquet$", 1)
    rows = raw.select(
        F.coalesce(_first_of(raw, ID_COLUMNS), F.concat_ws("-", shard, F.col("_metadata.row_index").cast("string"))).alias("book_id"),
        _first_of(raw, LANGUAGE_COLUMNS).alias("language"), _first_of(raw, TEXT_COLUMNS).alias("text")).where("text is not null")
    rows = rows.where(T.is_spanish(F.col("language"))) if spanish_only else rows
    return rows.where(F.size(T.words(F.col("text"))) >= min_words) if min_words else rows


#: The columns of a web corpus.
WEB = "text string, id string, url string, dump string, language_score double, token_count long"


def read_web(spark: SparkSession, path: str, most: int = 0, seed: int = 13) -> DataFrame:
    """Rows of a web corpus's Parquet shards with `shard`, their number; `most` takes so many by a random, fixed order of ids."""
    shard = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)[^/\d]*\.parquet$", 1).try_cast("long")
    rows = spark.read.schema(WEB).parquet(path).select("*", shard.alias("shard")).where("text is not null")
    if not most:
        return rows
    # Ids are ordered alone, texts follow; the sort keeps `most` rows a task.
    chosen = rows.select("id").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "id")), "id").limit(most)
    return rows.join(chosen, "id", "left_semi")


def shards_in_order(spark: SparkSession, path: str) -> list[str]:
    """The files of a sharded table, by their numbers and then their names; a list of files is small."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path")
    number = F.regexp_extract("path", r"(\d+)[^/\d]*\.parquet$", 1).try_cast("long")
    return [r.path for r in files.orderBy(number.asc_nulls_last(), "path").collect()]


def read_curve(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """rank (the number of the line) and count (its last field) of a list of frequencies, up to a rank."""
    fields = F.split(T.strip(F.col("line")), r"(?U)\s+")
    rows = lines(spark, path).select(F.col("row").cast("long").alias("rank"), F.element_at(fields, -1).try_cast("long").alias("count"))
    return rows.where(F.col("rank") <= most) if most else rows


def read_audits(spark: SparkSession, *paths: str) -> DataFrame:
    """Audit rows of JSON-lines files below some paths, with their file; a missing temperature is 1."""
    rows = spark.read.schema(AUDIT).option("recursiveFileLookup", True).option("pathGlobFilter", "*audit*.jsonl*").json(list(paths))
    return rows.withColumn("temperature", F.coalesce("temperature", F.lit(1.0))).withColumn("audit_path", F.col("_metadata.file_path"))


def read_samples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(SAMPLE).json(path)
    return rows.orderBy("id").limit(limit) if limit else rows


def read_generations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of generation.*.jsonl; FileNotFoundError if there are none."""
    try:
        return spark.read.schema(GENERATION).json(f"{folder}/generation.*.jsonl")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no generation files below {folder}") from e
        raise


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def table_strings(payload: str) -> Iterator[str]:
    """Text of a CSV or TSV payload: its column of lyrics, or all its columns."""
    head = payload.split("\n", 1)[0]
    rows = csv.DictReader(io.StringIO(payload.replace("\r\n", "\n")), delimiter="\t" if head.count("\t") > head.count(",") else ",")
    for row in rows:
        yield from [row["lyrics"] or ""] if "lyrics" in row else (str(v) for v in row.values() if v)


@F.pandas_udf(StringType())
def table_text(raw: pd.Series) -> pd.Series:
    """The strings of CSV and TSV payloads, one to a line."""
    return pd.Series([None if p is None else "\n".join(table_strings(p)) for p in raw])


def read_payloads(spark: SparkSession, path: str, strip_boilerplate: bool = False) -> DataFrame:
    """group, source_path, text of text, JSON, CSV and TSV files; the group is a file's name or its folder's below the path."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("source_path"), F.regexp_replace("value", "^﻿", "").alias("raw"))
    kind = F.lower(F.regexp_extract("source_path", r"\.([^./]+)$", 1))
    rows = rows.withColumn("kind", kind)
    strings = payload.joined_strings(payload.json_strings(rows.where("kind = 'json'"), "source_path", "raw"), "source_path", "raw").withColumnRenamed("raw", "json")
    rows = rows.join(strings, "source_path", "left")
    text = F.when(F.col("kind") == "json", F.coalesce("json", F.lit(""))).when(F.col("kind").isin("csv", "tsv"), table_text("raw")).otherwise(F.col("raw"))
    text = T.strip_boilerplate(text) if strip_boilerplate else text
    root = re.escape(path.rstrip("/").rpartition("/")[2])
    below = F.regexp_extract("source_path", rf"/{root}/(.*)$", 1)
    group = F.regexp_replace(F.element_at(F.split(F.when(below == "", F.regexp_extract("source_path", r"([^/]+)$", 1)).otherwise(below), "/"), 1), r"\.[^.]*$", "")
    return rows.select(group.alias("group"), "source_path", text.alias("text"))


@F.pandas_udf(StringType())
def _word_member(archives: pd.Series) -> pd.Series:
    def one(data: bytes) -> str:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
            for m in tar:
                if m.name.endswith("_words.txt"):
                    return tar.extractfile(m).read().decode("utf-8", "replace")
        raise ValueError("an archive holds no word list")

    return archives.map(one)


def read_word_archive(spark: SparkSession, path: str) -> DataFrame:
    """word, count of tar archives with a member *_words.txt (id, word, count by tabs)."""
    text = spark.read.format("binaryFile").load(path).select(_word_member(F.col("content")).alias("t"))
    f = F.split("line", "\t")
    rows = text.select(F.explode(F.split("t", r"\r?\n")).alias("line")).where(F.size(f) >= 3)
    rows = rows.select(T.normalize_word(F.get(f, F.lit(1))).alias("word"), F.get(f, F.lit(2)).try_cast("long").alias("count")).where("word <> '' and count is not null")
    return rows.groupBy("word").agg(F.sum("count").alias("count"))


class _Blocks(HTMLParser):
    KEEP, SKIP = {"h1", "h2", "h3", "p", "blockquote", "li"}, {"script", "style", "nav"}

    def __init__(self):
        super().__init__()
        self.out, self.depth, self.skip = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.KEEP:
            self.depth += 1
            self.out.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        self.depth -= tag in self.KEEP and self.depth > 0

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.out[-1] += data


def epub_text(data: bytes) -> str:
    """Blocks of an EPUB's chapters in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e for e in container.iter() if e.tag.endswith("rootfile")).get("full-path")
        package = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        base, chapters = opf.rpartition("/")[0], []
        for ref in (e.get("idref") for e in package.iter() if e.tag.endswith("itemref")):
            parser = _Blocks()
            parser.feed(z.read(f"{base}/{items[ref]}" if base else items[ref]).decode("utf-8", "replace"))
            chapters += [" ".join(b.split()) for b in parser.out if b.strip()]
    return "\n".join(chapters)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True).load(path)
    read = F.pandas_udf(lambda s: s.map(epub_text), "string")
    return files.select(F.col("path").alias("source_path"), read(F.col("content")).alias("text"))


def read_lyrics(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """text of lyric collections: latin1 TSV with a lyrics column, JSON lists or lines with lyrics, or text files."""
    if kind == "tsv":
        return spark.read.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path).select(F.col("lyrics").alias("text")).where("text is not null")
    if kind == "json":
        whole = spark.read.text(path, wholetext=True)
        whole = whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        return payload.joined_strings(payload.json_strings(whole, "path", "text"), "path", "text").select("text")
    if kind == "jsonl":
        return spark.read.schema("lyrics string, text string").json(path).select(F.coalesce("lyrics", "text").alias("text")).where("text is not null")
    return read_corpus(spark, path).select("text")


def exportable(rows: DataFrame, text: str, language: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Rows of Spanish with a long enough cleaned text, and counts of why others are skipped."""
    clean = F.trim(T.strip_boilerplate(F.col(text)))
    why = F.when(~T.is_spanish(F.col(language), missing=False), "language").when(F.coalesce(F.length(clean), F.lit(0)) == 0, "empty").when(F.length(clean) < min_chars, "short")
    tagged = rows.withColumn("skipped", why).withColumn(text, clean)
    return tagged.where("skipped is null").drop("skipped"), tagged.where("skipped is not null").groupBy("skipped").agg(F.count("*").alias("rows"))
