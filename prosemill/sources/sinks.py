"""Writers. Each is one distributed write; only what must be one file is brought to one task, and it is small by its definition."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sentence_store(df: DataFrame, path: str, rows_per_file: int = 500_000) -> dict[str, float]:
    """Files of at most ``rows_per_file`` rows by source; what they hold: rows, bytes, bytes a row."""
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("source").parquet(path)
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    rows = spark.read.schema(df.schema).parquet(path).count()
    return {"rows": rows, "bytes": size, "bytes_per_row": size / rows if rows else 0.0}


def frequencies(df: DataFrame, path: str) -> None:
    """Forms in descending order of their count."""
    df.orderBy(F.desc("n"), "form").write.option("compression", "zstd").parquet(path)


def table(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def names(df: DataFrame, path: str) -> None:
    """One sorted file, which is what readers of a names list expect; the list is short."""
    df.select("form").coalesce(1).sortWithinPartitions("form").write.text(path)


def jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def report(df: DataFrame, path: str) -> None:
    """A report of one row; more rows, or none, are an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report has one row")
    df.sparkSession.createDataFrame(rows, df.schema).coalesce(1).write.json(path)


def rules(df: DataFrame, path: str, about: tuple[str, ...] = ()) -> None:
    """A rule table as TSV; ``about`` are comment lines above the header. A rule table is a short list, so with comments it is one file."""
    if not about:
        df.write.option("sep", "	").option("header", True).csv(path)
        return
    line = F.concat_ws("	", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    head = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate([*(f"# {a}" for a in about), "	".join(df.columns)])], "at int, value string")
    head.unionByName(df.select(F.lit(len(about) + 1).alias("at"), line.alias("value"))).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)


def runtime_rules(df: DataFrame) -> DataFrame:
    """``trigger, entries``: a trigger's rules as one JSON array, in the order of their ordinal if there is one."""
    order = "ordinal" if "ordinal" in df.columns else "replacement"
    entry = F.struct(F.col(order).alias("o"), F.struct(F.col("replacement").alias("r"), F.col("hard_word").alias("w"), F.col("pos").alias("p"), F.col("block_context").alias("b"), F.col("require_context").alias("q")).alias("e"))
    return df.groupBy(F.lower("trigger").alias("trigger")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])).alias("entries"))


def gloss_map(df: DataFrame) -> DataFrame:
    """``word, gloss`` rows as one JSON object, the first gloss of a word in the order of the alphabet; a word list is short."""
    one = df.groupBy("word").agg(F.min("gloss").alias("gloss"))
    return one.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "gloss"))))).alias("glosses"))


def runtime_config(threshold: float, coverage: float, precision: float, **more) -> str:
    """What the page pass needs to know beside its rules, as JSON."""
    return json.dumps({"threshold": threshold, "coverage": coverage, "precision": precision, **more}, sort_keys=True)


def sample(df: DataFrame, n: int = 100, key: str = "key", seed: str = "0") -> DataFrame:
    """``n`` rows by a hash of their key: the sampling operator."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)
