"""Repeated passages by prefix-partitioned suffix trees.

Suffixes start at every word. A suffix's prefix decides its group. It runs at first from its start to the
end of the least 8-gram of its first 20 words: 8 to 20 words, so equal 20-word sequences have equal
prefixes, and neighbouring suffixes of a text mostly share the closing 8-gram (the anchor) and travel
together. Prefixes are counted; one whose suffixes are over ``tree_rows`` is lengthened to 20 words.

1. Every group of documents sends the hashes of its anchors, and how many suffixes end their prefix with each.
2. An anchor that only one group has cannot open a repeat across groups; the rest are sent back, each with whether
   its prefixes are to be lengthened.
3. Each group sends, for these anchors, the suffixes to their prefix's partition, once for all equal
   20-word windows that the group has: runs of neighbours as one stretch of words, and those with a lengthened
   prefix, which is all that is asked of them, as its hash. So a passage with any number of copies costs as many rows as there
   are groups and not documents.
4. Each partition builds its suffix tree, cut at depth 20: suffix array, longest common prefixes, and the outermost
   internal nodes of depth 20. A node's leaves are one word sequence; all but the earliest leaf are marked and sent
   back to their group.
5. Each group takes the words that marked windows cover out of its texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Tokens, grouped_texts, n_groups, table

WINDOW = 20
ANCHOR = 8
#: Text bytes of a group of documents.
GROUP_BYTES = 2 << 20
#: Suffixes of one prefix that a tree takes (about 100 bytes each) before the prefix is lengthened.
TREE_ROWS = 200_000
#: Partitions of prefixes, at least; otherwise as many as there are groups.
LEAST_PARTS = 192
_PART = "part int, g int, data binary"
_HEAD = np.dtype([("null", "u1"), ("n", "u1"), ("doc_id", "<i8"), ("start", "<i4"), ("pos", "<i4")])


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(parts)) >> U64(32)


def _rows(parts: np.ndarray, g: int, cut) -> pd.DataFrame:
    """One row for each run of equal ``parts`` (ascending); ``cut(i, j)`` gives its bytes."""
    ends = np.flatnonzero(np.diff(parts)) + 1
    runs = list(zip([0, *ends], [*ends, len(parts)])) if len(parts) else []
    return pd.DataFrame({"part": [int(parts[i]) for i, _ in runs], "g": [g] * len(runs), "data": [cut(i, j) for i, j in runs]}).astype({"part": "int32", "g": "int32"})


class _Group:
    """Windows, their hashes and their anchors in a group of documents."""

    def __init__(self, pdf: pd.DataFrame, window: int, anchor: int, keep: bool = False):
        self.t = t = Tokens(pdf, keep=keep)
        self.at = t.fits(window)
        self.hash = t.grams(window)[self.at] if len(self.at) else np.zeros(0, U64)
        # By (hash, position): positions follow the order of (id, start), so the first of a run is the earliest.
        order = np.argsort(self.hash, kind="stable")
        sorted_hash = self.hash[order]
        new = np.concatenate([[True], sorted_hash[1:] != sorted_hash[:-1]])[: len(order)]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        local_first = np.zeros(len(order), bool)
        local_first[order[new]] = True
        # Rows that share an id are one document as far as "earlier" goes: the same start is not earlier.
        doc, start = t.doc[self.at], self.at - t.starts[t.doc[self.at]] if len(self.at) else self.at
        same = np.zeros(len(order), bool)
        same[order] = (t.ids[doc[order]] == t.ids[doc[first]]) & (t.null[doc[order]] == t.null[doc[first]]) & (start[order] == start[first]) if len(order) else False
        self.marked = ~(local_first | same)
        self.doc, self.start = doc, start
        if len(self.at):
            grams = t.grams(anchor)
            view = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)
            self.anchor = self.at + np.concatenate([view[self.at[i : i + 65536]].argmin(axis=1) for i in range(0, len(self.at), 65536)])
            self.anchor_hash = grams[self.anchor]
        else:
            self.anchor, self.anchor_hash = self.at, self.hash


def _send_anchors(parts: int, window: int, anchor: int):
    def send(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s = _Group(pdf, window, anchor)
        h, n = np.unique(s.anchor_hash[~s.marked], return_counts=True)
        return _rows(_part(h, parts), key[0], lambda i, j: h[i:j].tobytes() + n[i:j].astype("<u4").tobytes())

    return send


def _anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Anchors' hashes and their numbers."""
    m = len(data) // 12
    return np.frombuffer(data, U64, m), np.frombuffer(data, "<u4", m, 8 * m)


def _common_anchors(tree_rows: int):
    def common(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """The anchors of more than one group, each with 1 if its prefixes are to be lengthened and else 0."""
        each = [_anchors(b) for b in pdf["data"]]
        h, where, groups = np.unique(np.concatenate([x for x, _ in each]), return_inverse=True, return_counts=True)
        rows = np.bincount(where, np.concatenate([n for _, n in each]).astype(float), len(h))
        long = (rows > tree_rows).astype("<u4")
        out, at = [], 0
        for x, _ in each:
            k = where[at : at + len(x)]
            k = k[groups[k] > 1]
            out.append(h[k].tobytes() + long[k].tobytes())
            at += len(x)
        return pdf.assign(data=out)[[len(b) > 0 for b in out]][["part", "g", "data"]]

    return common


def _send_suffixes(parts: int, window: int, anchor: int):
    def send(key, docs: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(common):
            return _rows(np.zeros(0, int), 0, None)
        s = _Group(docs, window, anchor)
        known, is_long = (np.concatenate(x) for x in zip(*map(_anchors, common["data"])))
        order = np.argsort(known)
        known, is_long = known[order], is_long[order] > 0
        place = np.minimum(np.searchsorted(known, s.anchor_hash), len(known) - 1)
        wanted = ~s.marked & (known[place] == s.anchor_hash)
        whole = np.flatnonzero(wanted & is_long[place])
        leaves = _leaf_rows(s, whole, parts, key[0])
        k = np.flatnonzero(wanted & ~is_long[place])
        if not len(k):
            return leaves
        # A run: neighbouring windows with the same anchor.
        cut = np.concatenate([[0], np.flatnonzero((np.diff(s.at[k]) != 1) | (np.diff(s.anchor[k]) != 0)) + 1])
        n = np.diff(np.concatenate([cut, [len(k)]]))
        first = k[cut]
        p = _part(s.anchor_hash[first], parts)
        order = np.argsort(p, kind="stable")
        head = np.zeros(len(order), _HEAD)
        f = first[order]
        head["null"], head["doc_id"], head["start"], head["pos"], head["n"] = s.t.null[s.doc[f]], s.t.ids[s.doc[f]], s.start[f], s.at[f], n[order]
        short = (s.t.hash & U64(0xFFFFFFFF)).astype("<u4")
        # The last symbol of a window is its 64-bit hash, so that two windows are told apart by all bits of their words.
        word_at = [short[a : a + m + window - 1] for a, m in zip(s.at[f], n[order])]
        hash_at = [s.hash[a : a + m] for a, m in zip(f, n[order])]

        def pack(i: int, j: int) -> bytes:
            return b"".join([np.int64(j - i).tobytes(), head[i:j].tobytes(), np.concatenate(word_at[i:j]).tobytes(), np.concatenate(hash_at[i:j]).tobytes()])

        return pd.concat([leaves, _rows(p[order], key[0], pack)])

    return send


def _leaf_rows(s: _Group, k: np.ndarray, parts: int, g: int) -> pd.DataFrame:
    """The windows ``k`` by their hash, for the partitions behind those of the shorter prefixes."""
    p = _part(s.hash[k], parts)
    k = k[order] if len(order := np.argsort(p, kind="stable")) else k
    head = np.zeros(len(k), _HEAD)
    head["null"], head["doc_id"], head["start"], head["pos"], head["n"] = s.t.null[s.doc[k]], s.t.ids[s.doc[k]], s.start[k], s.at[k], 1
    return _rows(np.sort(p) + U64(parts), g, lambda i, j: head[i:j].tobytes() + s.hash[k[i:j]].tobytes())


def suffix_array(words: np.ndarray, last: np.ndarray, tie: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of suffixes cut to the rows of ``words`` plus the symbol ``last``, leaves of a node in the order of ``tie``; and longest common prefixes.

    The prefix with the one before is counted in symbols, ``last`` included; that of the first one is 0.
    """
    n, k = words.shape
    pairs = [words[:, i].astype(U64) << U64(32) | (words[:, i + 1].astype(U64) if i + 1 < k else U64(0)) for i in range(0, k, 2)]
    order = np.lexsort([*reversed(tie), last, *reversed(pairs)])
    same = words[order[1:]] == words[order[:-1]]
    all_ = same.all(axis=1) if k else np.ones(max(0, n - 1), bool)
    lcp = np.where(all_, k + (last[order[1:]] == last[order[:-1]]), same.argmin(axis=1) if k else 0)
    return order, np.concatenate([[0], lcp])[:n].astype(np.int64)


def deep_nodes(lcp: np.ndarray, depth: int) -> np.ndarray:
    """First leaf, as a place of the suffix array, of the outermost internal node of at least ``depth`` that each place lies under; of a place under none, itself.

    Such a node is a run of common prefixes that all reach the depth.
    """
    return np.maximum.accumulate(np.where(lcp >= depth, 0, np.arange(len(lcp))))


def _trees(window: int, parts: int):
    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        heads, words, lasts, groups = [], [], [], []
        for g, b in zip(pdf["g"], pdf["data"]):
            if key[0] >= parts:  # whole prefixes: nothing is left below them but the leaves
                m = len(b) // (_HEAD.itemsize + 8)
                wide = np.frombuffer(b, _HEAD, m)
                heads.append((wide["null"], wide["doc_id"], wide["start"].astype(np.int64), wide["pos"].astype(np.int64)))
                lasts.append(np.frombuffer(b, U64, m, m * _HEAD.itemsize))
                words.append(np.zeros((m, 0), np.uint32))
                groups.append(np.full(m, g, np.int32))
                continue
            m = int(np.frombuffer(b, "<i8", 1)[0])
            head = np.frombuffer(b, _HEAD, m, 8)
            n = head["n"].astype(np.int64)
            at = 8 + m * _HEAD.itemsize
            size = int((n + window - 1).sum())
            w = np.frombuffer(b, "<u4", size, at)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = np.repeat(np.cumsum(n + window - 1) - (n + window - 1), n) + nth
            words.append(w[begin[:, None] + np.arange(window)[None, :]])
            lasts.append(np.frombuffer(b, U64, int(n.sum()), at + 4 * size))
            wide = np.repeat(head, n)
            heads.append((wide["null"], wide["doc_id"], wide["start"] + nth, wide["pos"] + nth))
            groups.append(np.full(len(nth), g, np.int32))
        null, doc, start, pos = (np.concatenate(x) for x in zip(*heads))
        g, rows, last = np.concatenate(groups), np.concatenate(words), np.concatenate(lasts)
        order, lcp = suffix_array(rows, last, [null, doc, start])
        node = deep_nodes(lcp, rows.shape[1] + 1)
        first = order[node]
        later = (node != np.arange(len(node))) & ~((null[order] == null[first]) & (doc[order] == doc[first]) & (start[order] == start[first]))
        k = order[later]
        k = k[np.lexsort([pos[k], g[k]])]
        spans = _spans(g[k])
        return pd.DataFrame({"g": [int(g[k[i]]) for i, _ in spans], "data": [_runs(pos[k[i:j]]) for i, j in spans]}).astype({"g": "int32", "data": object})

    return build


def _spans(x: np.ndarray) -> list[tuple[int, int]]:
    ends = np.flatnonzero(np.diff(x)) + 1
    return list(zip([0, *ends], [*ends, len(x)])) if len(x) else []


def _runs(pos: np.ndarray) -> bytes:
    """Ascending positions as (first, count) of each run of neighbours."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(pos) != 1) + 1])
    return np.stack([pos[cut], np.diff(np.concatenate([cut, [len(pos)]]))], axis=1).astype("<i4").tobytes()


def _covered(window: int, anchor: int, docs: pd.DataFrame, marks: pd.DataFrame) -> tuple[_Group, np.ndarray]:
    s = _Group(docs, window, anchor, keep=True)
    edge = np.zeros(s.t.n + 1, np.int64)
    at = s.at[s.marked]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    for b in marks["data"]:
        runs = np.frombuffer(b, "<i4").reshape(-1, 2).astype(np.int64)
        np.add.at(edge, runs[:, 0], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + window, -1)
    return s, np.cumsum(edge)[:-1] > 0


def _clean(window: int, anchor: int):
    def clean(key, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        s, gone = _covered(window, anchor, docs, marks)
        out = []
        for i, (a, b) in enumerate(zip(s.t.starts, s.t.ends)):
            kept = b" ".join(s.t.words[j] for j in np.flatnonzero(~gone[a:b]) + a)
            out.append((None if s.t.null[i] else int(s.t.ids[i]), int(b - a), int(gone[a:b].sum()), kept.decode()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    return clean


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group_bytes: int = GROUP_BYTES, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row of ``docs(doc_id, text)``; ``kept`` is the text left.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a smaller
    id, or in the same id at an earlier word. A null text has no words; null ids come after all
    others; rows that share an id count as one document, so copies under one id do not remove each
    other at the same start. Shorter documents lose nothing. Other columns of the input are left out, an empty table gives an
    empty result, and a text is never cut: a group holds at least one document, whatever its length.
    """
    n = n_groups(docs, group_bytes)
    parts = max(n, LEAST_PARTS)
    texts = grouped_texts(docs, n)
    # One query, with no written table between its passes, so that all three read one exchange of the texts.
    by_g = texts.groupBy("g")
    anchors = by_g.applyInPandas(_send_anchors(parts, window, anchor), _PART)
    common = anchors.groupBy("part").applyInPandas(_common_anchors(tree_rows), _PART)
    suffixes = by_g.cogroup(common.groupBy("g")).applyInPandas(_send_suffixes(parts, window, anchor), _PART)
    marks = suffixes.groupBy("part").applyInPandas(_trees(window, parts), "g int, data binary")
    return by_g.cogroup(marks.groupBy("g")).applyInPandas(_clean(window, anchor), "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), p AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)
), f AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1 AS later FROM p
), gone AS (
  SELECT DISTINCT doc_id, s + o AS i FROM f, (SELECT unnest(range(0, 20)) AS o) WHERE later
), g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string([ws[i] for i in range(1, len(ws) + 1) if NOT coalesce(list_contains(gone, i), false)], ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
