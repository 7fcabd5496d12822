"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators.scratch import written as materialise

__all__ = ["GROUP_BYTES", "Tokens", "U64", "WORD", "free_name", "grouped_texts", "held_out", "materialise", "mix", "n_groups", "table", "word_count"]

#: Words of the contracts: maximal runs without ASCII white space. ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one group of documents aims at; a group is one Python call.
GROUP_BYTES = 4 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The rows no label may be learned from: crc32 of the id's digits, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def n_groups(docs: DataFrame, target_bytes: int = GROUP_BYTES, least: int = 24) -> int:
    """How many groups of documents hold about ``target_bytes`` of text each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-total // target_bytes))


def grouped_texts(docs: DataFrame, n: int) -> DataFrame:
    """``g, doc_id, text``: every document in one of ``n`` groups by a hash of its id."""
    return docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs, elementwise."""
    with np.errstate(over="ignore"):
        x = a * U64(0x9E3779B97F4A7C15) + b
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(32)
    return x


class Tokens:
    """The words of a group of documents, end to end, as 64-bit hashes.

    Documents stand in the order of (id, text) with null ids last, whatever order the rows
    arrive in, so that positions mean the same in every pass over the group.
    """

    def __init__(self, pdf: pd.DataFrame, lower: bool = False, keep: bool = False):
        import xxhash

        rows = [(pd.isna(i), 0 if pd.isna(i) else int(i), "" if t is None else t) for i, t in zip(pdf["doc_id"], pdf["text"])]
        self.order = sorted(range(len(rows)), key=rows.__getitem__)
        self.null = np.array([rows[i][0] for i in self.order], bool)
        self.ids = np.array([rows[i][1] for i in self.order], np.int64)
        words: list[bytes] = []
        ends = np.zeros(len(rows), np.int64)
        for k, i in enumerate(self.order):
            b = rows[i][2].encode()
            words += (b.lower() if lower else b).split()
            ends[k] = len(words)
        self.starts, self.ends = np.concatenate([ends[:0], [0], ends[:-1]]).astype(np.int64)[: len(rows)], ends
        self.n = len(words)
        column = np.empty(len(words), object)
        column[:] = words
        codes, unique = pd.factorize(column) if words else (np.zeros(0, np.int64), [])
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in unique), U64, len(unique))
        self.hash = hashes[codes] if words else np.zeros(0, U64)
        self.words = words if keep else None
        self.doc = np.repeat(np.arange(len(rows)), self.ends - self.starts)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each position on; only positions with ``k`` words ahead are there."""
        power, have, out, at = 1, self.hash, None, 0
        while True:
            if k & power:
                if out is None:
                    out, at = have, power
                else:
                    m = max(0, min(len(out), len(have) - at))
                    out, at = mix(out[:m], have[at : at + m]), at + power
            power *= 2
            if power > k:
                return out[: max(0, self.n - k + 1)]
            m = max(0, len(have) - power // 2)
            have = mix(have[:m], have[power // 2 :][:m])

    def fits(self, k: int) -> np.ndarray:
        """Positions from which ``k`` words stand in one document."""
        n = max(0, self.n - k + 1)
        return np.flatnonzero(np.arange(n) + k <= self.ends[self.doc[:n]]) if n else np.zeros(0, np.int64)
