"""License scans as an exact set-similarity join of text blocks with license templates.

A block is a run of as many words as the longest template has (a shorter text is one block), whatever
lines it spans. A template is found in a block if at least ``threshold`` of its distinct words stand there.

The words of all templates are ordered by their count over all documents, rarest first, and both
sides of the join are kept in that order; other words of a block can match nothing and are left out.
A block that meets the threshold shares a word with the template's first ``size - needed + 1`` (prefix
filter), holds ``needed`` such words at all (length filter), and from the first shared word on, the i-th
of the template and the j-th of the block, both still have enough words left (positional filter).
What passes is counted in full, so nothing is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrases whose consecutive words are the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices by label; a label may have several.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("all-rights-reserved", "All rights reserved"),
]
THRESHOLD = 0.9
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: bytes) -> list[bytes]:
    """Words of lower-cased UTF-8: ASCII letters, digits and all that is not ASCII."""
    return _WORD.findall(text.lower())


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def word_counts(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """How often each of ``words`` stands in all of ``docs``; at most one row a word comes to the driver."""
    wanted = frozenset(words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    n.update(w for w in tokens(t.encode()) if w in wanted)
        yield pd.DataFrame({"word": [w.decode() for w in n], "n": list(n.values())}).astype({"word": object, "n": "int64"})

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in wanted} | {r["word"].encode(): r["n"] for r in rows}


class Index:
    """Templates as ranks of the global order, by the ranks of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        sets = [frozenset(tokens(text.encode())) for _, text in templates]
        self.window = max(len(tokens(text.encode())) for _, text in templates)
        order = sorted(frozenset().union(*sets), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: r for r, w in enumerate(order)}
        self.templates: list[tuple[str, list[int], frozenset[int], int]] = []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for n, ((label, _), words) in enumerate(zip(templates, sets)):
            ranks, k = sorted(self.rank[w] for w in words), needed(len(words), threshold)
            self.templates.append((label, ranks, frozenset(ranks), k))
            for i, r in enumerate(ranks[: len(ranks) - k + 1]):
                self.prefix.setdefault(r, []).append((n, i))
        self.least = min(k for *_, k in self.templates)
        #: Pairs that each filter turned away, and pairs counted in full.
        self.turned_away = {"length": 0, "position": 0, "counted": 0}

    def pairs(self, block: list[int]) -> Iterator[tuple[int, int]]:
        """Template and shared words of every template that ``block``, ascending ranks, meets."""
        seen = set()
        for j, r in enumerate(block):
            for n, i in self.prefix.get(r, ()):
                if n in seen:
                    continue
                seen.add(n)  # r is the first word that both share: all before it in either order was looked at
                _, ranks, own, k = self.templates[n]
                if len(block) < k:
                    self.turned_away["length"] += 1
                elif len(ranks) - i < k or len(block) - j < k:
                    self.turned_away["position"] += 1
                else:
                    self.turned_away["counted"] += 1
                    if (both := len(own.intersection(block))) >= k:
                        yield n, both

    def find(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Label and largest containment of each template that some block of ``words`` meets.

        A block can be moved on to its first template word without losing one, and must hold a word of a prefix: only such
        blocks are looked at.
        """
        at = [(p, r) for p, w in enumerate(words) if (r := self.rank.get(w)) is not None]
        near = [p for p, r in at if r in self.prefix]
        best: dict[int, int] = {}
        end, wanted = 0, 0
        for s, (start, _) in enumerate(at):
            while wanted < len(near) and near[wanted] < start:
                wanted += 1
            if wanted == len(near):
                break
            while end < len(at) and at[end][0] < start + self.window:
                end += 1
            if near[wanted] < start + self.window and end - s >= self.least:
                for n, both in self.pairs(sorted({r for _, r in at[s:end]})):
                    best[n] = max(both, best.get(n, 0))
        return [(self.templates[n][0], both / len(self.templates[n][1])) for n, both in best.items()]


def base_places(words: list[bytes], phrases: list[tuple[tuple[bytes, ...], str]]) -> list[tuple[int, str]]:
    """Start and label of each place where a phrase's words stand one after the other."""
    return [(i, label) for phrase, label in phrases for i in range(len(words) - len(phrase) + 1) if words[i] == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase]


_FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus a struct ``license`` with the places and labels found in ``text``.

    A null or empty text has no words, no labels and score 0; texts of any length are read whole, one at a time. The score
    is 1 if a base phrase is there, else the largest containment found. Repeated rows stay, an empty table gives an empty
    result, an input column ``license`` is replaced and all others stay. One pass counts the templates' words over all
    documents (the order decides speed, never the result); the join itself needs no shuffle, since all templates, a fixed
    list, go to every task.
    """
    templates = templates or TEMPLATES
    vocabulary = sorted({w for _, t in templates for w in tokens(t.encode())})
    counts = word_counts(docs, vocabulary)
    phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(templates, counts, threshold)
        for batch in batches:
            rows = []
            for t in batch:
                b = t.encode().lower() if t else b""
                words = _WORD.findall(b)
                places = base_places(words, phrases) if any(p[-1] in b for p, _ in phrases) else []
                found = index.find(words)
                base = {label for _, label in places}
                at = [i for i, _ in places]
                score = 1.0 if base else max((s for _, s in found), default=0.0)
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), score))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _FOUND.split(", ")])
            yield out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return docs.drop("license").withColumn("license", find("text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, labels and score of every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")


def _sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows, window = [], max(len(tokens(text.encode())) for _, text in TEMPLATES)
    for label, text in TEMPLATES:
        words = sorted({w.decode() for w in tokens(text.encode())})
        rows.append(f"('{label}', {words}, {needed(len(words), THRESHOLD)})")
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM d
), phrases(phrase, label, k) AS (VALUES {phrases}
), b AS (
  SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS labels
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM w), phrases
  WHERE array_to_string(ws[i + 1:i + k], ' ') = phrase GROUP BY doc_id
), templates(label, words, needed) AS (VALUES {", ".join(rows)}
), o AS (SELECT doc_id, ws, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w
), l AS (
  SELECT doc_id, label, words, needed, list_distinct(ws[i:i + {window - 1}]) AS ws FROM o JOIN (SELECT label, words, needed, unnest(words) AS x FROM templates) USING (x)
), m AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(shared / len(words)) AS score
  FROM (SELECT doc_id, label, words, needed, len(list_intersect(ws, words)) AS shared FROM l) WHERE shared >= needed GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word, CAST(b.z AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CAST(CASE WHEN b.n > 0 THEN 1 ELSE coalesce(m.score, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN m ON w.doc_id = m.doc_id
"""


OP9_SQL = _sql()
