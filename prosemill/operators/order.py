"""Order statistics and runs of pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as X


def at_index(df: DataFrame, keys: list[str], value: str, index: Callable[[Column], Column], bin_of: Column, out: str) -> DataFrame:
    """``keys, out``: the value at ``index(n)``, from 0, of each key's ``n`` values in ascending order; values are not interpolated.

    ``bin_of`` grows with the value and takes few values. Bins are counted first, so only the one bin that holds the index
    is sorted, and of that only its distinct values; a key with most of the rows is no burden to one task. Null values are left out.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), bin_of.alias("_bin"))
    counted = rows.groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("_n"))
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
    all_of, up_to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bin")
    placed = bins.withColumns({"_at": index(F.sum("_bn").over(all_of)), "_end": F.sum("_bn").over(up_to)}).filter("_end > _at AND _end - _bn <= _at")
    wanted = placed.select(*keys, "_bin", (F.col("_at") - F.col("_end") + F.col("_bn")).alias("_rest"))
    inside = counted.join(wanted, [*keys, "_bin"]).withColumn("_end", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v")))
    return inside.filter("_end > _rest AND _end - _n <= _rest").select(*keys, F.col("_v").alias(out))


def log_bin(value: Column) -> Column:
    """At most some thousands of bins for numbers of any size, growing with the value: 64 to each doubling of its distance from 0."""
    return F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * 64)


def quantile(df: DataFrame, keys: list[str], value: str, share: float, out: str) -> DataFrame:
    """``keys, out``: the linearly interpolated quantile of each key's values, from the values at the two places around it."""
    place = lambda n: (n - 1) * F.lit(share)
    at = lambda f, name: at_index(df, keys, value, f, log_bin(F.col(value)), name)
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    both = at(lambda n: F.floor(place(n)), "_lo").join(at(lambda n: F.ceil(place(n)), "_hi"), keys).join(n, keys)
    return both.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (place(F.col("_n")) - F.floor(place(F.col("_n"))))).alias(out))


def sentences_with_offsets(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, nth, sentence, start, end`` of a running text, line breaks included: offsets in code points, ``end`` without trailing white space but for the last sentence, which ends with the text.

    Dots at the end of the word before a boundary are dropped before it is looked up, unlike in ``text.split_sentences``.
    """
    marked = X.sub(F.col("text"), r"""(?U)([.!?]['")\]]?\s+)(?=["'(\[]?[A-Z0-9])""", "$1\u0001")
    pieces = df.select(key, F.posexplode_outer(F.split(marked, "\u0001")).alias("k", "p")).filter("p <> ''")
    head = pieces.withColumn("head", X.sub(F.col("p"), r"""(?U)[.!?]['")\]]?\s+\z""", ""))
    last = head.withColumn("last", X.sub(F.regexp_extract("head", r"([A-Za-z][A-Za-z.]*)\z", 1), r"\.+\z", ""))
    goes_on = ~F.col("head").endswith("..") & (F.col("last").isin(X.ABBREVIATIONS) | F.col("last").rlike(r"^[A-Z]\z") | F.col("last").contains("."))
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = last.withColumn("ends", (~goes_on).cast("long")).select(
        key, "k", "p", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("nth"), F.coalesce(F.sum(F.length("p")).over(before), F.lit(0)).alias("at"), F.max("k").over(Window.partitionBy(key)).alias("most")
    )
    runs = placed.groupBy(key, "nth").agg(F.min("at").alias("start"), F.max("k").alias("k"), F.max("most").alias("most"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]), "").alias("raw"))
    end = F.col("start") + F.length(F.when(F.col("k") == F.col("most"), F.col("raw")).otherwise(X.sub(F.col("raw"), r"(?U)\s+\z", "")))
    return runs.select(key, "nth", X.trim_all(F.col("raw")).alias("sentence"), "start", end.alias("end")).filter("sentence <> ''")
