"""Readers of corpora and rule tables. Every schema is stated; nothing is inferred or collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions import text as X
from prosemill.functions import udfs
from prosemill.operators.retention import numbered, within_budget

DOCUMENT = "doc_id string, source string, text string, pub_year int, title string"
ITEM = "item_id string, kind string, source string, sentence string, span string, blanked string, hard_word string, gloss string, sense string, pos string, veto_reason string, candidates array<struct<text: string, origin: string>>, grades map<string, string>, grade_values map<string, double>, identity_target double"
RULE = "trigger string, replacement string, hard_word string, pos string, trigger_sense string, block_context string, require_context string, note string"
LEAST_CHARS = 2000


def _documents(df: DataFrame, **columns) -> DataFrame:
    known = {"pub_year": F.lit(None).cast("int"), "title": F.lit(None).cast("string")} | columns
    return df.select(*(known[c.split()[0]].alias(c.split()[0]) for c in DOCUMENT.split(", ")))


def _path() -> F.Column:
    return F.col("_metadata.file_path")


def _row_numbers(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` plus ``nth``, the row's number in the order of files and of rows in them; only the first ``limit`` rows, if that is given."""
    placed = df.select("*", _path().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("in_scan"))
    return numbered(placed if limit is None else placed.orderBy("file", "block", "in_scan").limit(limit), ["file", "block", "in_scan"]).withColumnRenamed("pos", "nth").drop("file", "block", "in_scan")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def books(spark: SparkSession, root: str) -> DataFrame:
    """Plain-text books under ``root``: old and re-encoded copies and short files are left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("value").alias("raw"), _path().alias("path"))
    stem = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    kept = files.filter(~F.col("path").contains("/old/") & ~stem.rlike("-[08]$") & (F.length("raw") >= LEAST_CHARS))
    clean = X.unwrap_paragraphs(X.strip_emphasis(X.rejoin_hyphenation(X.drop_frontmatter(X.strip_book_marks(F.col("raw"))))))
    return _documents(kept, doc_id=F.concat(F.lit("pg:"), stem), source=F.lit("gutenberg"), text=clean, pub_year=X.guess_year(F.substring("raw", 1, 3000)))


def packaged_books(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Books as a table of ``TEXT`` and a JSON column ``METADATA``; bad JSON counts as empty, and a book without an id is called by its row number."""
    raw = F.replace(F.replace("TEXT", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    df = _row_numbers(spark.read.schema("TEXT string, METADATA string").parquet(path), limit).select("nth", raw.alias("raw"), F.get_json_object("METADATA", "$.text_id").alias("id"), F.get_json_object("METADATA", "$.authors").alias("authors"), F.get_json_object("METADATA", "$.title").alias("title"))
    clean = X.unwrap_paragraphs(X.strip_emphasis(X.rejoin_hyphenation(X.collapse_double_spacing(X.drop_frontmatter(X.strip_book_marks(F.col("raw")))))))
    known = df.filter(F.length("raw") >= LEAST_CHARS)
    return _documents(known, doc_id=F.concat(F.lit("pg:"), F.coalesce("id", F.col("nth").cast("string"))), source=F.lit("gutenberg"), text=clean, pub_year=X.author_year(F.col("authors")), title=F.col("title"))


def encyclopaedia(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows ``id, title, text`` without their apparatus sections. (JSON lines of texts that are cleaned already: ``jsonl``.)"""
    df = spark.read.schema("id string, title string, text string").parquet(path)
    df = df if limit is None else df.limit(limit)
    return _documents(df, doc_id=F.concat(F.lit("wiki:"), "id"), source=F.lit("wikipedia"), text=X.drop_tail_sections(F.col("text")), title=F.col("title"))


def news(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows ``url, timestamp, text``, called by their row number; the year is the first plausible one in the timestamp."""
    df = _row_numbers(spark.read.schema("url string, timestamp string, text string").json(path), limit)
    year = F.nullif(F.regexp_extract("timestamp", r"(1[6-9]\d{2}|20[0-2]\d)", 1), F.lit("")).cast("int")
    return _documents(df, doc_id=F.concat(F.lit("c4:"), F.col("nth").cast("string")), source=F.lit("c4news"), text=F.col("text"), pub_year=year)


def questions(spark: SparkSession, root: str) -> DataFrame:
    """Posts of Q&A dumps, a ``Posts.xml`` a site; empty bodies are left out and HTML is cleaned."""
    schema = "_Id string, _Body string, _CreationDate string"
    df = spark.read.format("xml").schema(schema).option("rowTag", "row").option("recursiveFileLookup", True).option("pathGlobFilter", "Posts.xml").load(root)
    df = df.withColumn("path", _path()).filter(F.length("_Body") > 0)
    site = F.regexp_extract("path", r"([^/]+)/Posts\.xml$", 1)
    # Entities are decoded once: texts that hold one go to Python, the others have nothing to decode.
    tagless = X.strip_tags(F.col("_Body"))
    body = F.coalesce(udfs.unescape(F.when(tagless.contains("&"), tagless)), tagless)
    return _documents(df, doc_id=F.concat_ws(":", F.lit("se"), site, "_Id"), source=F.lit("stackexchange"), text=body, pub_year=F.substring("_CreationDate", 1, 4).try_cast("int"))


def jsonl(spark: SparkSession, path: str, source: str) -> DataFrame:
    df = spark.read.schema(DOCUMENT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    return df.withColumn("source", F.coalesce("source", F.lit(source)))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"gutenberg": books, "gutenberg_table": packaged_books, "wikipedia": encyclopaedia, "c4news": news, "stackexchange": questions}


def documents(spark: SparkSession, paths: dict[str, str], budget: int | None = None) -> DataFrame:
    """The union of the sources named, each from its path and, with a ``budget``, until it has given as many words."""
    out = None
    for name, path in paths.items():
        df = READERS[name](spark, path) if name in READERS else jsonl(spark, path, name)
        if budget is not None:
            df = within_budget(df.withColumn("n_words", F.size(X.words(F.col("text"))).cast("long")), "source", "doc_id", "n_words", budget).drop("n_words")
        out = df if out is None else out.unionByName(df)
    return out


def rule_table(spark: SparkSession, path: str, deferred: DataFrame | None = None) -> DataFrame:
    """Substitution rules of a TSV with comment lines; rows without a trigger and deferred words are left out; contexts become arrays."""
    df = spark.read.option("sep", "\t").option("comment", "#").option("header", True).schema(RULE).csv(path).filter("trigger is not null and trigger <> ''")
    if deferred is not None:
        df = df.join(deferred.select("word"), F.col("hard_word") == F.col("word"), "left_anti")
    terms = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return df.withColumns({c: terms(F.col(c)) for c in ("block_context", "require_context")})


def deferred_words(spark: SparkSession, path: str) -> DataFrame:
    """Words that rules leave out for now; a missing file is an empty list."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "word string, reason string, dominant_untaught_sense string, taught_gloss string")
    return spark.read.option("sep", "\t").option("comment", "#").option("header", True).schema("word string, reason string, dominant_untaught_sense string, taught_gloss string").csv(path)


def items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON lines, labelled or not."""
    return spark.read.schema(ITEM).json(path)


def word_list(spark: SparkSession, path: str, lines: int | None = None) -> DataFrame:
    """One word a line, trimmed and lower-cased, of the first ``lines`` lines if that is given; a missing file is an empty list."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "word string")
    df = spark.read.text(path)
    df = df if lines is None else _row_numbers(df, lines)
    return df.select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def stored_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a stored table of fixed phrases."""
    return spark.read.parquet(path).select("w1", "w2").distinct()


def stored_band(spark: SparkSession, frequencies: str, low: float, high: float, priority: DataFrame | None = None) -> DataFrame:
    """``form, forced``: the forms of a stored frequency table whose rate per million is in the band, and priority words, which are forced if they are outside it."""
    c = spark.read.schema("form string, n long").parquet(frequencies)
    total = c.agg(F.sum("n").alias("total"))  # one row
    band = c.join(F.broadcast(total)).filter((F.col("n") / F.col("total") * 1e6).between(low, high)).select("form", F.lit(False).alias("forced"))
    if priority is None:
        return band
    return band.unionByName(priority.select(F.col("word").alias("form"), F.lit(True).alias("forced"))).groupBy("form").agg(F.min("forced").alias("forced"))
