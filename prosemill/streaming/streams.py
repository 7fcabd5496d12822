"""Streams over document files. Each gives what its batch twin gives over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.functions import text as X
from prosemill.operators.scratch import new_path


def documents(spark: SparkSession, sf_dir: str, name: str = "documents", files_per_trigger: int = 64) -> DataFrame:
    """The files of a table as a stream, a bounded number of them a trigger."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet")


def word_counts(stream: DataFrame) -> DataFrame:
    return stream.select(F.explode_outer(X.words(F.col("text"))).alias("form")).filter("form is not null").groupBy("form").agg(F.count("*").alias("n"))


def distinct_texts(stream: DataFrame) -> DataFrame:
    """The key of each distinct text, once over the whole stream; the state store keeps the keys and spills."""
    return stream.select(X.exact_key(F.col("text")).alias("key")).dropDuplicates(["key"])


def windowed_events(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by type in windows of event time; rows later than the watermark are left out."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def _empty(spark: SparkSession, schema, path: str) -> None:
    """A first, empty part, so that a stream without rows still has a result with its schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def collected(stream: DataFrame, mode: str) -> DataFrame:
    """All available input run through the stream; the result as a table of the shared folder."""
    spark = stream.sparkSession
    at = new_path(spark, "stream")
    _empty(spark, stream.schema, f"{at}/out" if mode == "complete" else f"{at}/out/epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        # In complete mode the last batch holds all; a repeated epoch overwrites its own folder, so a retry adds nothing.
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/epoch={epoch}")

    _run(stream, write, f"{at}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{at}/out") if mode == "complete" else _epochs(spark, f"{at}/out", stream.schema).drop("epoch")


def _run(stream: DataFrame, step, state: str, mode: str = "append") -> list[dict]:
    """Runs the available input in micro-batches, one at a time, and gives the progress of each."""
    q = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in q.recentProgress]


def _epochs(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """The parts of a table that epochs wrote, those before ``before`` alone if it is given."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(path)
    return df if before is None else df.filter(F.col("epoch") < before)


def progress(stream: DataFrame) -> DataFrame:
    """``batch, rows`` of each micro-batch of the available input: marks of how far a run has come."""
    spark = stream.sparkSession
    rows = _run(stream, lambda batch, epoch: batch.write.format("noop").mode("overwrite").save(), f"{new_path(spark, 'stream')}/state")
    return spark.createDataFrame([(r["batch"], r["rows"]) for r in rows if r["rows"]], "batch long, rows long")


def stored(stream: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """The stream's rows as a sentence store: files of at most ``rows_per_file`` rows, an epoch a folder, which a retry overwrites."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/epoch={epoch}")

    _run(stream, write, f"{new_path(stream.sparkSession, 'stream')}/state")


_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()
_schema = lambda **fields: T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
_KEPT = _schema(doc_id=_LONG, source=_STRING, lang=_STRING, sent_no=_INT, sentence=_STRING, n_tok=_INT, key=_STRING)


def coverage(spark: SparkSession, stream: DataFrame, words: DataFrame, cap: int) -> DataFrame:
    """Coverage-capped retention batch by batch: each batch ranks its sentences after the contexts that earlier ones have kept.

    All state is tables by epoch: an epoch reads those of the epochs before it and overwrites its own, so a repeated one changes nothing, and a
    restarted driver finds them.
    """
    from prosemill.operators import retention
    from prosemill.operators.scratch import written
    from prosemill.plans.text_queries import first_of_key, good_sentences

    at = new_path(spark, "stream")
    band = written(words)
    key_type, count_type = _schema(key=_STRING), _schema(form=_STRING, k=_LONG)
    for name, schema in (("keys", key_type), ("counts", count_type), ("out", _KEPT)):
        _empty(spark, schema, f"{at}/{name}/epoch=-1")

    def step(batch: DataFrame, epoch: int) -> None:
        def put(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{at}/{name}/epoch={epoch}")
            return spark.read.schema(df.schema).parquet(f"{at}/{name}/epoch={epoch}")

        seen = _epochs(spark, f"{at}/keys", key_type, epoch).select("key")
        sentences = put(first_of_key(good_sentences(batch)).join(seen, "key", "left_anti").select(*_KEPT.names), "sentences")
        put(sentences.select("key"), "keys")
        have = _epochs(spark, f"{at}/counts", count_type, epoch).groupBy("form").agg(F.sum("k").alias("n"))
        rank = F.row_number().over(Window.partitionBy("form").orderBy("doc_id", "sent_no"))
        hit = retention.hits(sentences, band).withColumn("rn", rank).filter(F.col("rn") <= cap).join(have, "form", "left")
        first = hit.filter(F.col("rn") + F.coalesce("n", F.lit(0)) <= cap).select("doc_id", "sent_no").distinct()
        kept = put(sentences.join(first, ["doc_id", "sent_no"], "left_semi").select(*_KEPT.names), "out")
        put(retention.hits(kept, band).groupBy("form").agg(F.count("*").alias("k")), "counts")

    _run(stream, step, f"{at}/state")
    return _epochs(spark, f"{at}/out", _KEPT).drop("epoch")
