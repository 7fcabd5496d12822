"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage of a document by an edit budget of ``RATE`` of its length.
It is split into budget + 1 pieces: any passage within the budget holds at least one piece
unchanged. An Aho-Corasick automaton finds all exact hits of all pieces in one pass over the
whole text; around each hit, Myers' bit-parallel algorithm gives the least edit distance of the
item to any part of the text there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise, table

#: Edits allowed, as a part of an item's characters.
RATE = 0.05
#: Characters of items that go to the tasks at once; a larger benchmark takes more passes.
BLOCK_CHARS = 4 << 20


def normalise(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a part of ``text``, and the first end of such a part."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    vp, vn, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        x = eq.get(c, 0)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp) & full, vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best, end = score, j
        hp = hp << 1 & full
        vp, vn = (hn << 1 | ~(d0 | hp)) & full, hp & d0
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, n, int(rate * len(n))) for i, t in items if (n := normalise(t))]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def find(self, text: str | None) -> list[tuple]:
        """``item_id, distance, start, end, places`` of each item within its budget; offsets are into the normalised text."""
        text = normalise(text)
        if self.empty or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                starts.setdefault(k, set()).add(end - size + 1 - at)
        out = []
        for k, where in starts.items():
            item_id, item, budget = self.items[k]
            best, places = None, 0
            where = sorted(where)
            i = 0
            while i < len(where):
                j = i  # starts that one passage within the budget can explain
                while j + 1 < len(where) and where[j + 1] - where[j] <= 2 * budget:
                    j += 1
                a, b = max(0, where[i] - budget), min(len(text), where[j] + len(item) + budget)
                part = text[a:b]
                at = part.find(item)
                distance, end = (0, at + len(item)) if at >= 0 else myers(item, part)
                if distance <= budget:
                    places += 1
                    start = at if at >= 0 else end - myers(item[::-1], part[:end][::-1])[1]
                    if best is None or distance < best[0]:
                        best = (distance, a + start, a + end)
                i = j + 1
            if best is not None:
                out.append((item_id, *best, places))
        return sorted(out)


_HITS = "array<struct<item_id: long, distance: int, start: int, end: int, places: int>>"


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``chars`` characters; one block at a time is held."""
    known = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    n = max(1, -(-(known.agg(F.sum(F.length("text"))).first()[0] or 0) // chars))
    for b in range(n):
        yield [tuple(r) for r in known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def finder(spark: SparkSession, items: list[tuple[int, str]], rate: float = RATE):
    """A column function that finds ``items`` in texts, and the broadcast it holds."""
    sent = spark.sparkContext.broadcast(items)

    @F.pandas_udf(_HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate)
        for batch in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "start", "end", "places"), h)) for h in matcher.find(t)] for t in batch], dtype=object)

    return find, sent


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, start, end, places``: every document and item within the item's edit budget.

    A pair has one row for each row of ``docs``: its least distance, where that is, and the number
    of places. Null texts and empty items match nothing; repeated items are one, repeated documents are not. Empty tables
    on either side give an empty result; other columns of both are left out; texts are searched whole. No shuffle. Of a
    benchmark of more than one block, each block's hits are written before the next block is sent.
    """
    out, last = None, None
    for items in blocks(benchmark, chars):
        if last is not None:
            hits, sent = last
            out = materialise(hits) if out is None else out.union(materialise(hits))
            sent.unpersist()
        find, sent = finder(docs.sparkSession, items, rate)
        last = docs.select("doc_id", F.explode(find("text")).alias("hit")).select("doc_id", "hit.*"), sent
    return last[0] if out is None else out.union(last[0])


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns.

    Null and empty texts stay, and an empty benchmark keeps all. What a block leaves is written before the next block is sent.
    """
    (hit,) = free_name(docs, "hits")
    held = None
    for items in blocks(benchmark, chars):
        if held is not None:
            docs = materialise(docs)
            held.unpersist()
        find, held = finder(docs.sparkSession, items, rate)
        docs = docs.withColumn(hit, find("text")).filter(F.size(hit) == 0).drop(hit)
    return docs
