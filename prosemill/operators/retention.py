"""Order-dependent retention as windows, none of them over all rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as X
from prosemill.operators.scratch import written


def hits(sentences: DataFrame, words: DataFrame, order=("doc_id", "sent_no"), extra=()) -> DataFrame:
    """The distinct wanted words of each sentence; common words leave before any window."""
    tokens = sentences.select(*order, *extra, F.explode_outer(F.array_distinct(X.words(F.col("sentence")))).alias("form"))
    return tokens.join(words.select("form"), "form", "left_semi")


def coverage_capped(sentences: DataFrame, words: DataFrame, cap: int, order=("doc_id", "sent_no"), per: list[str] | None = None) -> DataFrame:
    """Sentences that a scan in ``order`` keeps, if it keeps one while any of its wanted words has under ``cap`` contexts.

    A word's first ``cap`` sentences are always kept and later ones see it covered, so the scan
    is a rank within each word (and within each value of ``per``).
    """
    per = per or []
    rank = F.row_number().over(Window.partitionBy(*per, "form").orderBy(*order))
    chosen = hits(sentences, words, order, per).withColumn("rn", rank).filter(F.col("rn") <= cap).select(*order).distinct()
    return sentences.join(chosen, list(order), "left_semi")


def coverage_hits(sentences: DataFrame, words: DataFrame, cap: int, order=("doc_id", "sent_no")) -> DataFrame:
    """The ``hits`` of the sentences that ``coverage_capped`` keeps. They are written, so that the sentences are made once."""
    every = written(hits(sentences, words, order))
    rank = F.row_number().over(Window.partitionBy("form").orderBy(*order))
    return every.join(every.withColumn("rn", rank).filter(F.col("rn") <= cap).select(*order).distinct(), list(order), "left_semi")


def running(df: DataFrame, by: str, order: str, value: Column | str, out: str) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` over the earlier rows of the same ``by``, in the order of ``order``.

    Range partitions are written, summed a group each, and these few sums are added up; so a group of any size is spread over the cluster.
    """
    parts = written(df.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("part", F.spark_partition_id()).withColumn("value", F.col(value) if isinstance(value, str) else value))
    sums = parts.groupBy(F.col(by).alias("group"), F.col("part").alias("in_part")).agg(F.sum("value").alias("sum"))
    start = sums.select("group", "in_part", F.coalesce(F.sum("sum").over(Window.partitionBy("group").orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum("value").over(Window.partitionBy("part", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("inner", inner).join(start, F.col(by).eqNullSafe(F.col("group")) & (F.col("part") == F.col("in_part")))
    return placed.select(*df.columns, (F.col("start") + F.col("inner")).alias(out))


def within_budget(df: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each group until their running size reaches the budget, the row that crosses it included."""
    return running(df, by, order, size, "before").filter(F.col("before") < budget).drop("before")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` plus ``pos``, its place from 0 in the order: range partitions are written, counted and numbered each by itself."""
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    start = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("rn", place).join(F.broadcast(start), "part").withColumn("pos", F.col("start") + F.col("rn") - 1).drop("part", "rn", "start")


def interleave(df: DataFrame, by: str, order: str, run: int = 25) -> DataFrame:
    """``df`` plus ``pos``: ``run`` rows of each group in turn; groups that have ended drop out."""
    nth = running(df, by, order, F.lit(1), "nth")
    return numbered(nth.withColumn("turn", F.floor(F.col("nth") / run)), ["turn", by, "nth"]).drop("nth", "turn")
