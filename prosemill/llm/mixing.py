"""Mixing sources to target weights.

Documents lie in a hash-random order within their source; running sums of their sizes are made
in two levels (hash-prefix bins, then rows of a bin), and each source is cut at its budget, after
as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, materialise, table, word_count

#: A source's words are taken this often at most.
MAX_EPOCHS = 3
#: Leading hex digits of the hash key that make a bin: 4,096 bins a source.
BIN_DIGITS = 3
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target``, budgets that share the sum of all sizes by weight.

    ``sizes`` has one row for each ``source`` with ``source_size``. Weights repeat along the
    sources in code point order, null last. A target stops at ``max_epochs`` times its source's
    size and what is over is shared again by weight, until none is above. Each round is one
    aggregate whose single row comes to the driver.
    """
    # Numbered without a window over all sources: a range-sorted, written table keeps its partitions.
    ordered = sizes.withColumn("is_null", F.col("source").isNull()).repartitionByRange(8, "is_null", "source").sortWithinPartitions("is_null", "source")
    ordered = materialise(ordered.withColumn("part", F.spark_partition_id()))
    per_part = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most 8 rows
    start, at = {}, 0
    for part in sorted(per_part):
        start[part], at = at, at + per_part[part]
    base = F.coalesce(*(F.when(F.col("part") == p, F.lit(n)) for p, n in start.items()), F.lit(0)) if start else F.lit(0)
    nth = base + F.row_number().over(Window.partitionBy("part").orderBy("is_null", "source")) - 1
    known = materialise(ordered.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).alias("weight")))
    cap = F.col("source_size") * max_epochs
    total = known.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    while total:
        full = cap <= F.col("weight") * F.lit(rate)
        fixed, free = known.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (fixed or 0)) / free if free else rate
        if new <= rate:
            break
        rate = new
    return known.select("source", "source_size", F.round(F.least(cap.cast("double"), F.col("weight") * F.lit(rate)), 6).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` (``doc_id, source, text`` or ``size``) plus ``size, source_size, target, taken``.

    ``taken`` counts the words of a document that the mix holds: its size for each whole epoch,
    and in the last one all, none or (the document at the cut) a part. A null text has size 0.
    The order is that of the id's MD5; rows that share an id lie in the order of their size and of a hash of their
    text, and equal rows are interchangeable. An empty table gives an empty result. Input columns that clash with the new names are replaced.
    """
    if "text" in docs.columns:
        docs = docs.drop("size").withColumn("size", word_count(F.col("text")))
    docs = docs.drop("source_size", "target", "taken")
    key, bin_, base, before, s, b = free_name(docs, "key", "bin", "base", "before", "src", "bin_id")
    keyed = docs.withColumn(key, F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    keyed = keyed.withColumn(bin_, F.substring(key, 1, BIN_DIGITS))
    bins = materialise(keyed.groupBy(F.col("source").alias(s), F.col(bin_).alias(b)).agg(F.sum("size").alias("n")))
    goals = targets(bins.groupBy(F.col(s).alias("source")).agg(F.sum("n").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn(base, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    starts = materialise(starts.join(goals.withColumnRenamed("source", "goal_source"), F.col(s).eqNullSafe(F.col("goal_source"))).drop("goal_source"))
    tie = [F.xxhash64("text")] if "text" in docs.columns else []
    inner = Window.partitionBy("source", bin_).orderBy(key, "doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn(before, F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col(s)) & (F.col(bin_) == F.col(b)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col(base) - F.col(before)
    rows = rows.withColumn("taken", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))).cast("long"))
    return rows.select(*docs.columns, "source_size", "target", "taken")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sizes = materialise(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken", "source")


#: Water-filling in one pass: sources by the rate at which they fill, and the first rate that all sources not yet full can share.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), w AS (
  SELECT *, 3 * source_size / CAST(weight AS DOUBLE) AS fills,
         coalesce(sum(3 * source_size) OVER o, 0) AS fixed, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS free, sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (SELECT coalesce(max((total - fixed) / CAST(free AS DOUBLE)) FILTER (WHERE (total - fixed) / CAST(free AS DOUBLE) <= fills), 0) AS rate FROM w
), t AS (
  SELECT source, source_size, round(least(CAST(3 * source_size AS DOUBLE), weight * rate), 6) AS target FROM s, r
), c AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM c)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(budget - epochs * source_size - before, size)) AS BIGINT) AS taken, source
FROM e
"""


def mixed(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: each document as often as it was taken; the one at the cut ends at its last word taken.

    A document without words is kept once, since it weighs nothing.
    """
    whole = docs.columns
    out = mix(docs)
    times, nth = free_name(out, "times", "nth")
    out = out.withColumn(times, F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int"))
    out = out.filter(F.col(times) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times))))
    words = F.col("taken") - F.col("size") * (F.col(nth) - 1)
    part = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(words, F.lit(0)).cast("int")))
    cut = (F.col("size") > 0) & (words < F.col("size"))
    text = F.when(cut, part).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in whole:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*whole)
