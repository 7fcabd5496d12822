"""SimHash near-duplicates over a positional byte index.

A fingerprint is eight bytes. Two of them that differ in at most three bits agree in at least
five byte positions, and any five of eight positions hold exactly one of the fourteen blocks of
the Steiner system S(3, 4, 8). So the inverted index keeps one posting list for each block and
each value of its four bytes: the intersection of four positional lists. Every pair that could
reach the count meets in a list; the shared positions of a pair are then tallied, pairs under
five are dropped, and the rest is verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, table
from .components import components

MAX_BITS = 3
#: Differing bytes are at most MAX_BITS of eight.
MIN_BYTES = 8 - MAX_BITS
#: Posting lists up to this length are joined as they are, longer ones are compared in blocks.
SHORT_LIST = 16
BLOCK = 1024
HASH_SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of word shingles; no words (or null): 0."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), HASH_SEED)]
    else:
        hashes = [digest(b" ".join(s), HASH_SEED) for s in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


def blocks() -> list[tuple[int, ...]]:
    """The 14 blocks: both halves of the eight positions, and for each way to pair up a half, a pair of it beside a pair of the same way in the other half."""
    ways = [[(0, k), tuple(x for x in (1, 2, 3) if x != k)] for k in (1, 2, 3)]
    return [(0, 1, 2, 3), (4, 5, 6, 7)] + [(*a, *(x + 4 for x in b)) for way in ways for a in way for b in way]


assert all(any(set(b) <= set(five) for b in blocks()) for five in combinations(range(8), MIN_BYTES))


def _byte(c, i: int):
    return F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))


def _tally(a, b):
    """Positions at which two fingerprints hold the same byte."""
    x = a.bitwiseXOR(b)
    return sum((_byte(x, i) == 0).cast("int") for i in range(8))


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that span the components of the close pairs of two blocks of one posting list."""
    fp = np.sort(pdf["fp"].unique())
    x = fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]
    shared = sum((((x >> np.uint64(8 * i)) & np.uint64(255)) == 0).astype(np.int8) for i in range(8))
    close = (shared >= MIN_BYTES) & (np.bitwise_count(x) <= MAX_BITS)
    label = np.arange(len(fp))
    while True:
        least = np.where(close, label[None, :], len(fp)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    own = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"u": fp[own], "v": fp[label[own]]})


def links(fps: DataFrame) -> DataFrame:
    """``u, v``: enough links between the distinct fingerprints ``fp`` to connect all that a chain of close pairs connects."""
    keys = F.array(*(F.struct(F.lit(n).alias("b"), sum(F.shiftleft(_byte(F.col("fp"), p), 8 * k) for k, p in enumerate(b)).alias("k")) for n, b in enumerate(blocks())))
    index = fps.select("fp", F.explode(keys).alias("key")).select("fp", F.expr("key.k * 16 + key.b").alias("key"))
    size = index.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    lists = materialise(index.join(size, "key"))
    short = lists.filter(F.col("m") <= SHORT_LIST)
    a, b = short.select("key", F.col("fp").alias("u")), short.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, "key").filter("u < v").filter(_tally(F.col("u"), F.col("v")) >= MIN_BYTES)
    near = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS).select("u", "v")
    # A long list is cut into blocks by a hash; each pair of blocks is a task of bounded size.
    long = lists.filter(F.col("m") > SHORT_LIST).withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    dealt = long.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("key", "fp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    spanned = dealt.groupBy("key", "i", "j").applyInPandas(_forest, "u long, v long")
    return near.union(spanned).distinct()


def near_duplicates(docs: DataFrame, keep_text: bool = True, class_name: str | None = None) -> DataFrame:
    """All columns of ``docs`` (with ``doc_id``, ``text``) plus ``fingerprint`` and ``component_id``.

    Null or empty texts have fingerprint zero and are linked like any other; repeated rows stay;
    ``component_id`` is the least id that is not null among the rows reachable (null if none).
    Columns of the input that clash with the two new names are replaced. ``class_name`` names one
    more column, the fingerprint that stands for the row's component, which no other component has.
    """
    docs = docs.drop("fingerprint", "component_id")
    fp, class_fp, whole = free_name(docs, "fp", "class_fp", class_name or "class")
    known = docs.withColumn(fp, fingerprint_udf("text"))
    known = materialise(known if keep_text else known.drop("text"))
    nodes = materialise(known.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("least_id")))
    found = nodes.join(components(links(nodes.select("fp"))).withColumnRenamed("node", "fp"), "fp")
    class_id = found.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = found.join(class_id, "component").select(F.col("fp").alias("linked_fp"), "component_id", F.col("component").alias("linked_class"))
    # Written first, so that a fingerprint with a large share of the rows is an ordinary skewed join, which is split.
    classes = materialise(nodes.join(linked, F.col("fp") == F.col("linked_fp"), "left").select(F.col("fp").alias(class_fp), F.coalesce("component_id", "least_id").alias("component_id"), *([F.coalesce("linked_class", "fp").alias(whole)] if class_name else [])))
    out = known.join(classes, F.col(fp) == F.col(class_fp))
    return out.select(*(c for c in known.columns if c != fp), F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"), "component_id", *([F.col(whole).alias(class_name)] if class_name else []))


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the least id; rows of one id are told apart by their text.

    Rows whose group has no id at all keep one row of each fingerprint. Survivors are chosen on ids and hashes; texts are only
    read again and joined to them.
    """
    whole = docs.columns
    own, k, th, n, i, h = free_name(docs, "class", "class_key", "text_hash", "times", "chosen_id", "chosen_hash")
    rows = near_duplicates(docs.select("doc_id", F.xxhash64("text").alias(th), "text"), keep_text=False, class_name=own)
    # Not the least id: where an id is repeated, two components can share it.
    key = F.when(F.col("component_id").isNull(), F.concat(F.lit("fp"), "fingerprint")).otherwise(F.col(own).cast("string"))
    first = rows.filter(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).withColumn(k, key)
    times = first.groupBy(k, "doc_id", th).agg(F.count("*").alias(n))
    chosen = times.groupBy(k).agg(F.min(F.struct(F.col(th).alias(h), F.col("doc_id").alias(i), n)).alias("c")).select(f"c.{h}", f"c.{i}", f"c.{n}")
    chosen = materialise(chosen)
    out = docs.withColumn(th, F.xxhash64("text")).join(chosen, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(th) == F.col(h)))
    kept = out.filter(F.col(n) == 1).select(*whole)
    if chosen.filter(F.col(n) > 1).isEmpty():
        return kept
    # A row that stands there several times, text and id: one of them.
    again = out.filter(F.col(n) > 1).withColumn(k, F.row_number().over(Window.partitionBy(i, h).orderBy(F.length("text"))))
    return kept.unionByName(again.filter(F.col(k) == 1).select(*whole))
