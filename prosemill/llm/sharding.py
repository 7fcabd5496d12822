"""Hilbert-curve sharding: rows sorted along a space-filling curve over several metadata
dimensions and cut into runs, so that each file covers a small box of all of them.

DataFrame functions only. No step has a window over all rows: the curve has at most
``2 ** (BITS * dims)`` cells, the cells' counts are summed in order, a cell with many rows is
split by a hash of the row's id, and rows are numbered within these bins alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, table

#: Levels of the curve; three dimensions make 4,096 cells.
BITS = 4
#: Steps of a dimension's range whose exact counts give its equal-depth levels: of a number, 64 to each doubling of its distance
#: from the least one, so that one huge value leaves the small ones apart; of a string, equally wide ones.
STEPS = 4096
#: A bin holds about this part of all rows at most, and LEAST_BIN rows at least.
BIN_PART, LEAST_BIN = 16384, 32
N_SHARDS = 24


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of integer coordinates in [0, 2**bits): the transposed-Gray-code construction."""
    n = len(levels)
    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def step(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        low = q - F.lit(1)
        swap = F.element_at(x, 1).bitwiseXOR(F.element_at(x, i + 1)).bitwiseAND(low)
        zero = F.lit(0)
        return F.when(
            F.element_at(x, i + 1).bitwiseAND(q) != 0, F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        ).otherwise(F.transform(x, lambda v, j: v.bitwiseXOR(F.when(j == 0, swap).otherwise(zero)).bitwiseXOR(F.when(j == i, swap).otherwise(zero))))

    turned = F.aggregate(steps, F.array(*(c.cast("int") for c in levels)), step)
    # Gray code: each coordinate takes the exclusive or of those before it; then the last one's bits flip those below them in all.
    gray = F.aggregate(
        turned, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) > 0, v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))).otherwise(v)))
    )
    flips = F.aggregate(
        F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), F.struct(gray.alias("x"), F.lit(0).alias("t")),
        lambda acc, q: F.struct(acc["x"].alias("x"), F.when(F.element_at(acc["x"], -1).bitwiseAND(q) != 0, acc["t"].bitwiseXOR(q - 1)).otherwise(acc["t"]).alias("t")),
        lambda acc: F.transform(acc["x"], lambda v: v.bitwiseXOR(acc["t"])),
    )
    return F.aggregate(
        F.array(*(F.lit(1 << b) for b in range(bits - 1, -1, -1))), F.struct(flips.alias("x"), F.lit(0).cast("long").alias("h")),
        lambda acc, q: F.struct(acc["x"].alias("x"), F.aggregate(acc["x"], acc["h"], lambda h, v: h * 2 + F.when(v.bitwiseAND(q) != 0, 1).otherwise(0)).alias("h")),
        lambda acc: acc["h"],
    )


def _numbers(df: DataFrame, dims: list[str]) -> tuple[list[Column], list[Column]]:
    """Each dimension as a long that keeps its order (a null is below all), and its step in [0, STEPS).

    Of strings, the six bytes after the prefix that all of them share count; the least and the
    greatest value share exactly that prefix. Two values a dimension come to the driver.
    """
    kinds = dict(df.dtypes)
    ends = df.agg(*(f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("a", F.min), ("b", F.max)))).first()
    numbers, steps = [], []
    for i, d in enumerate(dims):
        lo, hi = ends[f"a{i}"], ends[f"b{i}"]
        if kinds[d] == "string":
            a, b = (lo or "").encode(), (hi or "").encode()
            skip = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            tail = lambda v: int.from_bytes(v[skip : skip + 6].ljust(6, b"\0"), "big")
            hexed = F.rpad(F.substring(F.hex(F.col(d).cast("binary")), 2 * skip + 1, 12), 12, "0")
            number, lo, hi = F.conv(hexed, 16, 10).cast("long"), tail(a), tail(b)
        else:
            number = F.floor(F.col(d).cast("double")).cast("long") if kinds[d] in ("float", "double") else F.col(d).cast("long")
            lo, hi = int(lo or 0), int(hi or 0)
        numbers.append(number)
        if kinds[d] == "string":
            width = -(-(hi - lo + 1) // (STEPS - 1))
            step = F.floor((number - F.lit(lo)) / F.lit(width)) + 1
        else:
            # Where the distance's first bit is, and the six bits behind it.
            x = number - F.lit(lo) + 1
            top = F.length(F.bin(x)) - 1
            right, left = F.call_function("shiftright", x, top - 6), F.call_function("shiftleft", x, 6 - top)
            step = top * 64 + F.when(top >= 6, right).otherwise(left).bitwiseAND(F.lit(63)) + 1
        steps.append(F.coalesce(step.cast("int"), F.lit(0)))
    return numbers, steps


def shard(df: DataFrame, dims: list[str], n_shards: int = N_SHARDS, id_col: str = "doc_id") -> DataFrame:
    """``df`` plus ``shard`` (0 to ``n_shards`` - 1, counts at most one apart) and ``slot`` (its place in the shard, gapless from 0).

    ``dims`` are columns (numbers or strings) of ``df``. Rows of one cell lie in the order of a
    hash of the row, so that a cell with any share of the rows is split, also by rows of a null or repeated id; rows
    that are equal in all columns take neighbouring slots and are interchangeable. Nulls come first in a dimension. An
    empty table gives an empty result; texts of any length are only measured and hashed. Input columns
    that clash with the new names are replaced.
    """
    df = df.drop("shard", "slot")
    cell, h, sub, size, rank, base, bin_ = free_name(df, "cell", "hash", "sub", "n_subs", "nth", "base", "bin")
    numbers, steps = _numbers(df, dims)
    # Equal-depth levels from exact counts: at most STEPS rows a dimension.
    counts = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("d"), s.alias("s")) for i, s in enumerate(steps)))).alias("x")).groupBy("x.d", "x.s").agg(F.count("*").alias("n"))
    before = Window.partitionBy("d").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    levels = counts.select("d", "s", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) * (1 << BITS) / F.sum("n").over(Window.partitionBy("d"))).cast("int").alias("level"))
    levels = materialise(levels)
    out = df
    step_names, level_names = free_name(df, *(f"step{i}" for i in range(len(dims)))), free_name(df, *(f"level{i}" for i in range(len(dims))))
    for i, s in enumerate(steps):
        out = out.withColumn(step_names[i], s)
    for i in range(len(dims)):  # at most STEPS rows each
        known = levels.filter(F.col("d") == i).select(F.col("s").alias(step_names[i]), F.col("level").alias(level_names[i]))
        out = out.join(F.broadcast(known), step_names[i]).drop(step_names[i])
    out = out.withColumn(cell, hilbert_index([F.col(c) for c in level_names])).withColumn(h, F.xxhash64(id_col, *(c for c, t in df.dtypes if c != id_col and "map<" not in t and "variant" not in t))).drop(*level_names)
    cells = materialise(out.groupBy(F.col(cell).alias("c")).agg(F.count("*").alias("n")))  # at most 2 ** (BITS * dims) rows
    total = cells.agg(F.sum("n")).first()[0] or 0
    in_bin = max(LEAST_BIN, -(-total // BIN_PART))
    cells = cells.select("c", F.ceil(F.col("n") / in_bin).cast("int").alias("subs"), F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cell_base"))
    out = out.join(F.broadcast(cells.select(F.col("c").alias(cell), F.col("subs").alias(size))), cell)
    # The hash's place in its range picks the sub-bin, so sub-bins follow the order of the hash.
    out = out.withColumn(sub, F.floor((F.shiftrightunsigned(F.col(h).bitwiseXOR(F.lit(-(1 << 63))), 33) * F.col(size)) / F.lit(1 << 31)).cast("int"))
    bins = out.groupBy(F.col(cell).alias("c"), F.col(sub).alias("b")).agg(F.count("*").alias("n"))
    within = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bins = materialise(bins.join(F.broadcast(cells.select("c", "cell_base")), "c").select(F.col("c").alias(cell), F.col("b").alias(sub), (F.col("cell_base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias(base)))
    # At most BIN_PART + 2 ** (BITS * dims) rows.
    out = out.withColumn(rank, F.row_number().over(Window.partitionBy(cell, sub).orderBy(h, id_col)) - 1)
    out = out.join(F.broadcast(bins), [cell, sub]).withColumn(bin_, F.col(base) + F.col(rank))
    out = out.withColumn("shard", F.expr(f"cast({bin_} * {n_shards}L div {max(total, 1)}L as int)"))
    out = out.withColumn("slot", F.expr(f"{bin_} - ((shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L)"))
    return out.select(*df.columns, "shard", "slot")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, size`` (UTF-8 bytes of the text and 8) and ``text_crc32`` of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", "lang", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place: law ``rows``, 24 shards in the order of a curve over source, language and size."""
    meta = materialise(sized(table(spark, sf_dir, "documents")))
    return shard(meta, ["source", "lang", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "lang"
    )


def sharded(docs: DataFrame) -> DataFrame:
    """The pipeline's last stage: whole documents with ``shard`` and ``slot``."""
    (size,) = free_name(docs, "size")
    return shard(docs.withColumn(size, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8), ["source", "lang", size]).drop(size)
