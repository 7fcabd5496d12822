"""Exact and near deduplication."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.operators.scratch import written


def minhash(sh: Column, hashes: int = 128, seed: int = 1) -> Column:
    """Least value of the hashed shingles under each of ``hashes`` random linear maps of 64 bits; all the largest value for no shingles.

    ``sh`` is an array of 64-bit hashes. One Arrow batch is a few numpy calls, where a lambda would run once a shingle and seed.
    """
    least = least_maps(hashes, seed)

    @F.pandas_udf("array<long>")
    def signature(rows: pd.Series) -> pd.Series:
        return pd.Series([least(np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64)) for x in rows], dtype=object)

    return signature(sh)


def least_maps(hashes: int = 128, seed: int = 1) -> Callable[[np.ndarray], np.ndarray]:
    """The least value of an array of 64-bit hashes under each random linear map, for one array at a time."""
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, hashes, np.uint64)

    def least(x: np.ndarray, step: int = 512) -> np.ndarray:
        out, x = np.full(hashes, np.iinfo(np.uint64).max), x.view(np.uint64)
        # In steps that stay in the cache.
        for at in range(0, len(x), step):
            y = x[None, at : at + step] * a[:, None]
            y += b[:, None]
            # The high half of a product is mixed best, so it goes first.
            z = y << np.uint64(32)
            y >>= np.uint64(32)
            y |= z
            np.minimum(out, y.min(axis=1), out=out)
        return out.view(np.int64)

    return least


def minhash_md5(sh: Column, hashes: int = 16) -> Column:
    """The same with a hash that other engines have too."""
    return F.when(F.size(sh) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda k: F.array_min(F.transform(sh, lambda x: F.md5(F.concat(k.cast("string"), F.lit(":"), x).cast("binary")))))
    )


def estimate(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 for empty or unequal lengths."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), same / F.size(a)).otherwise(F.lit(0.0))


def signature_classes(signatures: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, rep`` of every row: equal signatures ``sig`` have one ``rep``, their least key."""
    least = written(signatures.groupBy("sig").agg(F.min(key).alias("rep")))
    return signatures.join(least, "sig").select(key, "rep")


def lsh_pairs(signatures: DataFrame, bands: int = 32, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """``a, b, estimate`` of pairs of signatures ``sig`` that share a band and reach the estimate.

    Equal signatures are one class, and pairs are those of the classes' least keys, so that copies do not multiply;
    ``signature_classes`` says who they stand for, other sets of an equal signature included.
    """
    classes = written(signatures.groupBy("sig").agg(F.min(key).alias("rep")))
    k = F.size("sig") / bands
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("sig", (i * k).cast("int") + 1, k.cast("int"))).alias("h")))
    # Only the keys meet in a band; signatures are joined to the distinct pairs.
    keyed = classes.select("rep", F.explode(band).alias("b")).select("rep", "b.i", "b.h")
    x, y = keyed.withColumnRenamed("rep", "ra"), keyed.withColumnRenamed("rep", "rb")
    close = x.join(y, ["i", "h"]).filter("ra < rb").select("ra", "rb").distinct()
    side = lambda r, s: classes.select(F.col("rep").alias(r), F.col("sig").alias(s))
    scored = close.join(side("ra", "sa"), "ra").join(side("rb", "sb"), "rb")
    return scored.select(F.col("ra").alias("a"), F.col("rb").alias("b"), estimate(F.col("sa"), F.col("sb")).alias("estimate")).filter(F.col("estimate") >= least)


#: Elements in a hundred, by their hash, that ``briefed`` keeps of each set.
PART = 30


def codes(sets: DataFrame) -> Column:
    """The elements of ``sh`` as distinct 64-bit hashes in ascending order; those of an array of long are taken for hashes."""
    hashed = sets.schema["sh"].dataType == T.ArrayType(T.LongType())
    return F.sort_array(F.array_distinct(F.col("sh") if hashed else F.transform("sh", lambda x: F.xxhash64(x))))


def briefed(sets: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, h, h2, n, part`` of every row whose set ``sh`` is not empty: two hashes of the set, its size, and its elements whose own hash is below ``PART`` in a hundred. Written, so that the sets are made once for it."""
    known = sets.filter(F.size("sh") > 0).select(key, codes(sets).alias("sh"))
    return written(known.select(key, F.xxhash64("sh").alias("h"), F.hash("sh").alias("h2"), F.size("sh").alias("n"), F.filter("sh", lambda x: F.pmod(x, F.lit(100)) < PART).alias("part")))


def brief_classes(brief: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, rep``: rows of equal hashes have one ``rep``, their least key."""
    return brief.select(key, "h", "h2").join(brief.groupBy("h", "h2").agg(F.min(key).alias("rep")), ["h", "h2"]).select(key, "rep")


def set_classes(sets: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, rep`` of every row whose set ``sh`` is not empty: equal sets have one ``rep``, their least key."""
    return brief_classes(briefed(sets, key), key)


def pairable(brief: DataFrame, least: float, key: str = "doc_id") -> DataFrame:
    """The representatives ``key`` that may be in a pair. One of ``n`` elements has at most ``n - ceil(least * n)`` that the other has not, so all the rest of its ``part`` are in another set, too."""
    token = brief.select("h", F.explode("part").alias("x"))
    # Copies do not count as another set, and each adds as much to its class's count.
    shared = token.groupBy("x").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("x")
    per = token.join(shared, "x", "left_semi").groupBy("h").agg(F.count("*").alias("k"))
    alone = F.col("n") - F.ceil(F.col("n") * least - 1e-9)
    classes = brief.groupBy("h", "h2").agg(F.min(key).alias(key), F.count("*").alias("copies"), F.min(F.size("part") - alone).alias("needed"))
    return classes.join(per, "h", "left").filter(F.coalesce("k", F.lit(0)) >= F.col("copies") * F.col("needed")).select(key)


def jaccard_pairs(sets: DataFrame, least: float = 0.8, key: str = "doc_id", brief: DataFrame | None = None) -> DataFrame:
    """``a, b, jaccard`` of all pairs of different sets ``sh`` with at least that similarity, exactly; each class of equal sets stands as its least key (``set_classes``).

    Sets too few of whose elements are in any other set are left out first (``pairable``). Elements are ordered by their count over the others,
    rarest first. Two sets this similar share one of the first ``n - ceil(least * n) + 1`` elements of each (prefix filter), their sizes are
    alike (length filter), and behind a shared element enough are left on both sides (positional filter). ``brief`` is that of ``briefed``, if it is known.
    """
    able = written(pairable(brief if brief is not None else briefed(sets, key), least, key))
    body = sets.select(key, "sh").join(able, key, "left_semi").select(F.col(key).alias("rep"), codes(sets).alias("sh"))
    body = written(body)
    token = body.select("rep", F.explode("sh").alias("x"))
    often = token.groupBy("x").agg(F.count("*").alias("m"))
    # A set's own element that no other set has can open no pair; in the order it comes first all the same, and so shortens the prefix.
    ordered = token.join(often, "x").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("m", "x"))).alias("o"))
    n = F.size("o")
    prefix = ordered.select("rep", n.alias("n"), F.posexplode(F.slice("o", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))).alias("i", "e")).filter("e.m > 1").select(F.col("e.x").alias("x"), "rep", "n", "i")
    a, b = (prefix.select("x", F.col("rep").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("i").alias(f"i{s}")) for s in "ab")
    needed = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    reach = F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    close = a.join(b, "x").filter("ra < rb").filter((F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na")) & (reach >= needed)).select("ra", "rb").distinct()
    side = lambda r, s: body.select(F.col("rep").alias(r), F.col("sh").alias(s))
    both = F.size(F.array_intersect("sa", "sb"))
    scored = close.join(side("ra", "sa"), "ra").join(side("rb", "sb"), "rb").select("ra", "rb", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= least).select(F.col("ra").alias("a"), F.col("rb").alias("b"), "jaccard")


def near_first_wins(sets: DataFrame, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """``key, rep, kept`` of every row: whether a scan in order keeps it, if it drops each row whose set is as similar to that of a kept earlier one.

    Only a class's first row can stay: the others equal it, or what it was dropped for. Empty sets resemble nothing and stay.
    """
    brief = briefed(sets, key)
    rep = written(brief_classes(brief, key))
    stay = first_wins(rep.filter(F.col(key) == F.col("rep")).select(key), jaccard_pairs(sets, least, key, brief), key).withColumn("stays", F.lit(True))
    known = sets.select(key).join(rep, key, "left").join(stay, key, "left")
    return known.select(key, F.coalesce("rep", key).alias("rep"), (F.col("rep").isNull() | F.coalesce("stays", F.lit(False))).alias("kept"))


def first_wins(nodes: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The nodes that a scan in order keeps, if it drops each one paired with a kept earlier one.

    Rounds decide every node whose earlier partners are all decided, until none is open; each round is written.
    """
    edges = written(pairs.select("a", "b"))
    later = edges.select("b").distinct()
    kept = written(edges.select("a").join(later, F.col("a") == F.col("b"), "left_anti").distinct())
    decided = kept.select(F.col("a").alias("id"), F.lit(True).alias("keep"))
    while True:
        dropped = edges.join(decided.filter("keep").select(F.col("id").alias("a")), "a").select("b").distinct()
        decided = written(decided.union(dropped.join(decided.select(F.col("id").alias("b")), "b", "left_anti").select(F.col("b").alias("id"), F.lit(False).alias("keep"))))
        open_ = edges.join(decided.select(F.col("id").alias("b")), "b", "left_anti")
        waits = open_.join(decided.select(F.col("id").alias("a")), "a", "left_anti").select("b").distinct()
        ready = open_.select("b").distinct().join(waits, "b", "left_anti")
        if ready.isEmpty():
            break
        decided = written(decided.union(ready.select(F.col("b").alias("id"), F.lit(True).alias("keep"))))
    return nodes.join(decided.filter("not keep").select(F.col("id").alias(key)), key, "left_anti")
