"""Quality rules on repetition, by suffix arrays.

The suffix array of the words of many documents is built at once by prefix doubling; a word's
first rank includes its document, so no suffix matches one of another document. The longest common
prefixes give every maximal repeat: the words of a repeat of at least ``k`` words are those that
suffixes with a common prefix of ``k`` or more cover from their start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words taken together in one suffix array, unless a document has more.
BATCH_WORDS = 300_000
BASE_WINDOW = 8
#: Share of words that repeats of at least MIN_REPEAT words may cover, and words of the longest repeat.
MIN_REPEAT, MAX_COVERED, LONGEST = 5, 0.3, 100
_SYMBOL = re.compile(r"[#*$%&|<>]")


def longest_repeats(codes: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on also stand elsewhere in its document.

    ``codes`` are the words' numbers, ``ends`` the end of each word's document, ``doc`` its number. A text that repeats one
    word throughout is the worst case: it keeps ranks of 4 bytes a word for each doubling, 80 MB for a million words.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    key = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks, length = [rank], 1
    del key, order, sorted_key, head
    while True:
        group = np.bincount(rank, minlength=n)
        active = np.flatnonzero(group[rank] > 1).astype(np.int32)
        del group
        if not len(active):
            break
        after = active + length
        inside = after < ends[active]
        nxt = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        place = np.lexsort([nxt, rank[active]])
        a, r, x = active[place], rank[active][place], nxt[place]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new_part = new_group | np.concatenate([[True], x[1:] != x[:-1]])
        here = np.arange(len(a))
        offset = np.maximum.accumulate(np.where(new_part, here, 0)) - np.maximum.accumulate(np.where(new_group, here, 0))
        rank = rank.copy()
        rank[a] = r + offset
        # Suffixes that end within ``length`` words and are equal cannot stay tied: a suffix that ends sooner has 0 next, and only one of a document ends there.
        ranks.append(rank)
        length *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r, step = ranks[level], 1 << level
        p, q = i + lcp, j + lcp
        # Equal ranks at a level mean that as many words are the same, inside the documents.
        ok = (p + step <= ends[i]) & (q + step <= ends[j])
        same = ok & (r[np.minimum(p, n - 1)] == r[np.minimum(q, n - 1)])
        lcp = lcp + step * same
    out = np.zeros(n, np.int64)
    np.maximum.at(out, i, lcp)
    np.maximum.at(out, j, lcp)
    return out


def covered(longest: np.ndarray, k: int) -> np.ndarray:
    """The words inside a repeat of at least ``k`` words."""
    n = len(longest)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest >= k)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge)[:-1] > 0


def _measure(texts: list[str], min_repeat: int) -> list[tuple]:
    """Words, their characters, symbols, repeated lines, words in repeated 8-word windows, words in repeats of ``min_repeat``, longest repeat."""
    words: list[bytes] = []
    rows, ends = [], []
    for t in texts:
        own = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        words += own
        ends.append(len(words))
        rows.append((len(own), len(b"".join(own).decode()), len(_SYMBOL.findall(t)), len(lines) - len(set(lines))))
    if not words:
        return [(*r, 0, 0, 0) for r in rows]
    column = np.empty(len(words), object)
    column[:] = words
    codes, _ = pd.factorize(column)
    ends = np.array(ends)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(texts)), ends - starts)
    longest = longest_repeats(codes, ends[doc], doc)
    base, own = np.concatenate([[0], np.cumsum(covered(longest, BASE_WINDOW))]), np.concatenate([[0], np.cumsum(covered(longest, min_repeat))])
    return [(*r, int(base[b] - base[a]), int(own[b] - own[a]), int(longest[a:b].max()) if b > a else 0) for r, a, b in zip(rows, starts, ends)]


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest long"


def _measures(min_repeat: int):
    @F.pandas_udf(_MEASURES)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, part, size = [], [], 0
            for t in batch:
                t = "" if t is None else t
                if part and size + len(t) > 7 * BATCH_WORDS:
                    out += _measure(part, min_repeat)
                    part, size = [], 0
                part.append(t)
                size += len(t)
            out += _measure(part, min_repeat) if part else []
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _MEASURES.split(", ")]).astype("int64")

    return udf


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, longest: int = LONGEST) -> DataFrame:
    """``docs`` plus a struct ``rules`` with the measures, ``base_failed`` and ``kept``.

    ``kept`` asks that repeats of at least ``min_repeat`` words cover no more than ``max_covered``
    of the words and that none has more than ``longest`` words. A null or empty text has no
    words and fails the base rule. No shuffle: each document is judged by itself, repeated rows each like the
    first. Texts are read whole; one of over ``BATCH_WORDS`` words has a suffix array of its own. An empty table gives an
    empty result, an input column ``rules`` is replaced and all others stay.
    """
    out = docs.drop("rules").withColumn("rules", _measures(min_repeat)("text"))
    r = F.col("rules")
    failed = (r["n_words"] < 20) | (100 * r["n_repeat_words"] > 30 * r["n_words"])
    good = ~failed & (r["n_covered"] * 100 <= r["n_words"] * round(100 * max_covered)) & (r["longest"] <= longest)
    return out.withColumn("rules", F.struct(*(r[x.split()[0]].alias(x.split()[0]) for x in _MEASURES.split(", ")), failed.alias("base_failed"), good.alias("kept")))


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and verdict of every document."""
    return repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


#: Hashes of 5, 8 and LONGEST + 1 words by doubling.
assert (MIN_REPEAT, BASE_WINDOW, LONGEST) == (5, 8, 100)
OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), h1 AS (SELECT doc_id, len(ws) AS n, s, hash(w) AS h1 FROM (SELECT doc_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS s FROM w)
), h2 AS (SELECT *, hash(h1, lead(h1, 1) OVER o) AS h2 FROM h1 WINDOW o AS (PARTITION BY doc_id ORDER BY s)
), h4 AS (SELECT *, hash(h2, lead(h2, 2) OVER o) AS h4 FROM h2 WINDOW o AS (PARTITION BY doc_id ORDER BY s)
), h8 AS (SELECT *, hash(h4, lead(h4, 4) OVER o) AS h8 FROM h4 WINDOW o AS (PARTITION BY doc_id ORDER BY s)
), h16 AS (SELECT *, hash(h8, lead(h8, 8) OVER o) AS h16 FROM h8 WINDOW o AS (PARTITION BY doc_id ORDER BY s)
), h32 AS (SELECT *, hash(h16, lead(h16, 16) OVER o) AS h32 FROM h16 WINDOW o AS (PARTITION BY doc_id ORDER BY s)
), h64 AS (SELECT *, hash(h32, lead(h32, 32) OVER o) AS h64 FROM h32 WINDOW o AS (PARTITION BY doc_id ORDER BY s)
), h AS (
  SELECT doc_id, n, s, h8, hash(h4, lead(h1, 4) OVER o) AS h5, hash(h64, lead(h32, 64) OVER o, lead(h4, 96) OVER o, lead(h1, 100) OVER o) AS h101 FROM h64 WINDOW o AS (PARTITION BY doc_id ORDER BY s)
), p AS (
  SELECT doc_id, k, s, count(*) OVER (PARTITION BY doc_id, k, x) AS n
  FROM (SELECT doc_id, 8 AS k, s, h8 AS x FROM h WHERE s + 7 <= n UNION ALL SELECT doc_id, 5, s, h5 FROM h WHERE s + 4 <= n UNION ALL SELECT doc_id, 101, s, h101 FROM h WHERE s + 100 <= n)
), c AS (
  SELECT doc_id, k, sum(least(k, nxt - s)) AS words
  FROM (SELECT doc_id, k, s, coalesce(lead(s) OVER (PARTITION BY doc_id, k ORDER BY s), s + k) AS nxt FROM p WHERE n > 1) GROUP BY doc_id, k
), m AS (
  SELECT doc_id, sum(words) FILTER (WHERE k = {BASE_WINDOW}) AS base, sum(words) FILTER (WHERE k = {MIN_REPEAT}) AS own, count(*) FILTER (WHERE k = {LONGEST + 1}) AS long FROM c GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), a AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(base, 0) AS BIGINT) AS n_repeat_words, coalesce(own, 0) AS own, coalesce(long, 0) AS long
  FROM w LEFT JOIN m ON w.doc_id = m.doc_id LEFT JOIN l ON w.doc_id = l.doc_id
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND own * 100 <= n_words * {round(100 * MAX_COVERED)} AND long = 0 AS kept
FROM b
"""
