"""Stupid-backoff scores against n-gram counts of the whole corpus.

With the corpus scored against itself and nothing pruned, the n-gram that ends at a word has a count at the
longest order that the word's place allows, so a word scores log10 of count(n-gram) / count(context), and
the first words of a document, which have fewer words before them, score at a lower order. Their ratios
cancel but for the first whole context: a document's sum is the log-ratios of its n-grams of the highest
order, and of the count of its first context to the number of all words.

1. Documents are exploded, where they are read, to one row an n-gram: hash of the context, hash of the word, number of
   the document's row. A document's last context has a row without a word, since it counts as a context too.
   The rows travel as columns, a block for each partition of the contexts' hashes: one row each in
   Spark's format would be five times the text (the README has the figures).
2. In each partition the count tables of contexts and of n-grams are made by sorting, and joined to the
   rows where they lie.
3. The log-ratios are added up for each document, in the partitions and then over all of them.

A context with over ``1 / HEAVY`` of the rows is dealt out by its next word, and an n-gram that frequent stays
with its document; their counts are added up before they are shuffled and joined as a bounded table. A sample of documents says
which they are, which decides the route of a row and no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Tokens, materialise, mix, n_groups, table

ORDER = 3
BACKOFF = 0.4
#: A key with this part of the sampled rows, and LEAST_HEAVY of them, takes a route of its own: at most HEAVY contexts and as many n-grams.
HEAVY, LEAST_HEAVY, SAMPLED = 2048, 64, 64
#: Text bytes that are exploded at a time, unless a document has more; and that a partition of n-grams stands for.
BATCH_BYTES, PART_BYTES, LEAST_PARTS = 2 << 20, 12 << 20, 96
#: Bits of a hash by which n-grams are left out that no short document is.
SLOT_BITS = 20
#: Bits of a word's hash beside its context's 64; the largest value stands for the end of a document.
WORD_BITS = 48
_END = U64((1 << WORD_BITS) - 1)
_FIRST, _HOT = 1, 2
#: Kinds of blocks: n-grams; counts of lower orders; whole documents too short for a context; rows' ids and sizes; frequent keys.
GRAMS, LOW, SHORT, ROWS, FREQUENT = range(5)
_BLOCK = "part int, kind int, base long, m int, data binary"
_SUM = "base long, kind int, m int, data binary"
_ROW = "doc_id long, n_words long, value double, hot binary"
#: Sums travel as multiples of 2 ** -SCALE, which is exact to nine digits behind the point.
SCALE = 32


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of numbers, all first bytes first: planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :size].T).tobytes()


def _unplanes(data: bytes, at: int, m: int, size: int) -> np.ndarray:
    """Numbers of the least type that holds ``size`` bytes."""
    wide = next(w for w in (1, 2, 4, 8) if w >= size)
    out = np.zeros((m, wide), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, m * size, at).reshape(size, m).T
    return out.view(f"<u{wide}").ravel()


#: Bytes of the four columns of a block: a sorted key as differences, a second key, a number, flags.
_SIZES = (8, WORD_BITS // 8, 4, 1)


def _pack(key: np.ndarray, second: np.ndarray, number: np.ndarray, flag: np.ndarray) -> bytes:
    columns = (np.diff(key, prepend=U64(0)), second, number, flag)
    return b"".join(_planes(c, size) for c, size in zip(columns, _SIZES))


def _unpack(m: int, data: bytes) -> tuple[np.ndarray, ...]:
    at, out = 0, []
    for size in _SIZES:
        out.append(_unplanes(data, at, m, size))
        at += m * size
    return np.cumsum(out[0], dtype=U64), *out[1:]


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


class Grams:
    """The n-grams of the highest order of a batch of documents, and all of lower orders under a context's."""

    def __init__(self, docs: pd.DataFrame, order: int):
        self.t = t = Tokens(docs, lower=True)
        self.at = t.fits(order - 1)
        self.ctx = t.grams(order - 1)[self.at] if len(self.at) else np.zeros(0, U64)
        self.doc = t.doc[self.at]
        after = self.at + order - 1
        inside = after < t.ends[self.doc] if len(self.at) else np.zeros(0, bool)
        word = t.hash[np.minimum(after, max(0, t.n - 1))] >> U64(64 - WORD_BITS) if len(self.at) else np.zeros(0, U64)
        self.word = np.where(inside, np.minimum(word, _END - U64(1)), _END)
        self.first = self.at == t.starts[self.doc] if len(self.at) else np.zeros(0, bool)

    def low(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams that can be a whole document without a context, with their orders mixed in; and the documents that are one, by their row."""
        t = self.t
        every, short = [np.zeros(0, U64)], [np.zeros((0, 2), U64)]
        for k in range(1, order - 1):
            at = t.fits(k)
            if len(at):
                h = mix(t.grams(k)[at], np.full(len(at), k, U64))
                every.append(h)
                whole = (at == t.starts[t.doc[at]]) & (at + k == t.ends[t.doc[at]])
                short.append(np.stack([h[whole], t.doc[at][whole].astype(U64)], axis=1))
        return np.concatenate(every), np.concatenate(short)


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``of``."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


def explode(order: int, parts: int, contexts: np.ndarray, grams: np.ndarray, slots: np.ndarray):
    """Batches of ``doc_id, text`` to blocks. ``contexts`` and ``grams`` are the sorted keys of the frequent ones, ``slots`` those of ``short_slots``."""
    frequent_keys = np.concatenate([contexts, grams])
    by_key = np.argsort(frequent_keys)

    def blocks(docs: pd.DataFrame, base: int) -> Iterator[tuple]:
        g = Grams(docs, order)
        t = g.t
        size = t.ends - t.starts
        gram = mix(g.ctx, g.word)
        hot = _member(g.ctx, contexts)
        own = hot & _member(gram, grams)  # stays with its document
        # A frequent context is spread by its next word.
        p = np.where(hot, _part(gram, parts), _part(g.ctx, parts))
        k = np.flatnonzero(~own)
        k = k[np.lexsort((g.ctx[k], p[k]))]
        flag = (g.first * _FIRST + hot * _HOT).astype(np.uint8)
        yield from _cut(p[k], GRAMS, base, g.ctx[k], g.word[k], g.doc[k], flag[k])
        every, short = g.low(order)
        h, n = np.unique(every[slots[_slot(every)]], return_counts=True)
        yield from _cut(_part(h, parts), LOW, base, h, np.zeros(len(h), U64), n, np.zeros(len(h)))
        short = short[np.argsort(short[:, 0])]
        yield from _cut(_part(short[:, 0], parts), SHORT, base, short[:, 0], np.zeros(len(short), U64), short[:, 1], np.zeros(len(short)))
        rows = np.arange(len(size))
        here = base % parts
        ids = np.where(t.null, 0, t.ids).astype("<i8").tobytes() + t.null.astype(np.uint8).tobytes() + size.astype("<i8").tobytes()
        yield here, ROWS, base, len(rows), ids
        # Frequent keys: how often a document has one, and with what weight its count's logarithm enters.
        has = g.word != _END
        key = np.concatenate([g.ctx[hot], gram[own]])
        doc = np.concatenate([g.doc[hot], g.doc[own]])
        weight = np.concatenate([g.first[hot].astype(np.int64) - has[hot], has[own].astype(np.int64)])
        if len(key):
            key = by_key[np.searchsorted(frequent_keys, key, sorter=by_key)]
            at = np.lexsort((key, doc))
            new = np.flatnonzero(np.concatenate([[True], (np.diff(doc[at]) != 0) | (key[at][1:] != key[at][:-1])]))
            n, w = np.diff(np.append(new, len(at))), np.add.reduceat(weight[at], new)
            # n + w is 0, 1 or 2 n or near it: small, and never negative.
            columns = (key[at][new], 2), (np.diff(doc[at][new], prepend=0), 4), (n, 4), (n + w, 4)
            yield here, FREQUENT, base, len(new), b"".join(_planes(c, size) for c, size in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        for pdf in batches:
            part = pdf["text"].str.len().fillna(0).cumsum().to_numpy() // BATCH_BYTES
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(pdf)]]) if len(pdf) else [0]
            for i, j in zip(cut, cut[1:]):
                docs = pdf.iloc[i:j]
                out = pd.DataFrame(list(blocks(docs, base)), columns=["part", "kind", "base", "m", "data"])
                base += len(docs)
                yield out.astype({"part": "int32", "kind": "int32", "m": "int32"})

    return run


def _cut(p: np.ndarray, kind: int, base: int, *columns: np.ndarray) -> Iterator[tuple]:
    """A block for each run of equal partitions."""
    ends = np.flatnonzero(np.diff(p)) + 1
    for i, j in zip([0, *ends], [*ends, len(p)]) if len(p) else ():
        yield int(p[i]), kind, base, j - i, _pack(*(c[i:j] for c in columns))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """For each place of sorted keys, how many places have the same ones."""
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    at = np.flatnonzero(new)
    return np.diff(np.append(at, len(new)))[np.cumsum(new) - 1]


def _sums(row: np.ndarray, value: np.ndarray, bases: np.ndarray) -> Iterator[tuple]:
    """A block of sums by row for each batch, rows that sum to 0 left out. ``row`` is the batch's place in ``bases`` and the row's number in it."""
    order = np.argsort(row, kind="stable")
    row, value = row[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    total = np.rint(np.add.reduceat(value, new) * (1 << SCALE)).astype(np.int64)
    row, total = row[new][total != 0], total[total != 0]
    batch, number = row >> 32, (row & 0xFFFFFFFF).astype(U64)
    ends = np.flatnonzero(np.diff(batch)) + 1
    for i, j in zip([0, *ends], [*ends, len(batch)]) if len(batch) else ():
        x = (total[i:j] << 1 ^ total[i:j] >> 63).view(U64)  # the sign in the lowest bit
        size = (int(x.max()).bit_length() + 7) // 8
        yield int(bases[batch[i]]), GRAMS, j - i, bytes([size]) + _planes(np.diff(number[i:j], prepend=U64(0)), 4) + _planes(x, size)


def join_counts(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of a partition's contexts and n-grams, joined to its rows, as each row's sum of logarithms; rows' ids and frequent keys pass through."""
    out = [r for r in zip(pdf["base"], pdf["kind"], pdf["m"], pdf["data"]) if r[1] in (ROWS, FREQUENT)]
    of = {}
    for kind, own in pdf.groupby("kind"):
        if kind in (GRAMS, LOW, SHORT):
            columns = [np.concatenate(c) for c in zip(*(_unpack(m, d) for m, d in zip(own["m"], own["data"])))]
            bases, m = own["base"].to_numpy(), own["m"].to_numpy()
            of[kind] = bases, np.repeat(np.arange(len(bases)) << 32, m) + columns[2], *columns
    if GRAMS in of:
        bases, row, ctx, word, _, flag = of.pop(GRAMS)
        order = np.lexsort((word, ctx))
        ctx, word, row, flag = ctx[order], word[order], row[order], flag[order]
        c2, value = np.log10(_runs(ctx)), np.log10(_runs(ctx, word))
        c2[flag & _HOT > 0] = 0.0  # comes with the frequent keys
        value -= c2
        value[word == _END] = 0.0
        value += np.where(flag & _FIRST > 0, c2, 0.0)
        del ctx, word, order, c2, flag
        out += _sums(row, value, bases)
    if SHORT in of:
        _, _, h, _, times, _ = of[LOW]
        low, where = np.unique(h, return_inverse=True)
        n = np.bincount(where, times.astype(float), len(low))
        bases, row, asked, *_ = of[SHORT]
        out += _sums(row, np.log10(n[np.searchsorted(low, asked)]), bases)
    return pd.DataFrame(out, columns=["base", "kind", "m", "data"]).astype({"base": "int64", "kind": "int32", "m": "int32"})


def add_up(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """A batch's documents with the sums of all partitions, and their frequent keys by the place in the list of all."""
    (m, d), = ((m, d) for kind, m, d in zip(pdf["kind"], pdf["m"], pdf["data"]) if kind == ROWS)
    ids, null, size = np.frombuffer(d, "<i8", m), np.frombuffer(d, np.uint8, m, 8 * m), np.frombuffer(d, "<i8", m, 9 * m)
    total, hot = np.zeros(m, np.int64), np.full(m, None, object)
    for kind, n, d in zip(pdf["kind"], pdf["m"], pdf["data"]):
        if kind == GRAMS:
            number = np.cumsum(_unplanes(d, 1, n, 4), dtype=U64).astype(np.int64)
            x = _unplanes(d, 1 + 4 * n, n, d[0]).astype(U64)
            total[number] += (x >> U64(1)).view(np.int64) ^ -(x & U64(1)).view(np.int64)
        elif kind == FREQUENT:
            k, doc, times, both = (_unplanes(d, at * n, n, size).astype(np.int64) for at, size in ((0, 2), (2, 4), (6, 4), (10, 4)))
            rows, doc = np.stack([k, times, both - times], axis=1).astype("<i4"), np.cumsum(doc)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [n]])
            for i, j in zip(cut, cut[1:]):
                hot[doc[i]] = rows[i:j].tobytes()
    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64").copy(), "n_words": size, "value": total / (1 << SCALE), "hot": hot})
    out.loc[null > 0, "doc_id"] = pd.NA
    return out


def frequent_logs(per: DataFrame, keys: int) -> np.ndarray:
    """Logarithms of how often each frequent key stands in all documents; ``keys``, at most 2 * HEAVY, rows come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(keys, np.int64)
        for pdf in batches:
            rows = np.frombuffer(b"".join(pdf["hot"].dropna()), "<i4").reshape(-1, 3)
            n += np.bincount(rows[:, 0], rows[:, 1].astype(float), keys).astype(np.int64)
        yield pd.DataFrame({"key": np.flatnonzero(n), "n": n[n > 0]})

    out = np.zeros(keys)
    if keys:
        for key, n in per.select("hot").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n")).collect():
            out[key] = np.log10(n)
    return out


def with_frequent(logs: np.ndarray):
    """Sum of the logarithms of a document's frequent keys, by their weights."""

    @F.pandas_udf("double")
    def extra(hot: pd.Series) -> pd.Series:
        rows = [np.frombuffer(b or b"", "<i4").reshape(-1, 3) for b in hot]
        return pd.Series([float(r[:, 2] @ logs[r[:, 0]]) if len(r) else 0.0 for r in rows], dtype=float)

    return extra


def frequent(docs: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the contexts, and of n-grams of these, that a sample of documents shows to be frequent: at most HEAVY of each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = Grams(pdf, order)
            for kind, keys in ((0, g.ctx), (1, mix(g.ctx, g.word)[g.word != _END])):
                h, at, n = np.unique(keys, return_index=True, return_counts=True)
                yield pd.DataFrame({"kind": kind, "key": h.view(np.int64), "n": n}).astype({"kind": "int32"})

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    n = materialise(sample.mapInPandas(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = n.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    rows = n.filter(F.col("n") >= max(LEAST_HEAVY, -(-total // HEAVY))).collect()
    return tuple(np.sort(np.array([r["key"] for r in rows if r["kind"] == kind], np.int64).view(U64)) for kind in (0, 1))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - SLOT_BITS)).astype(np.int64)


def short_slots(docs: DataFrame, order: int) -> np.ndarray:
    """A table of bits in which those of the n-grams are set that are whole documents, too short for a context. Its size is fixed."""
    out = np.zeros(1 << SLOT_BITS, bool)
    if order < 3:
        return out
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    # Fails at the first word too many.
    few = docs.filter(F.col("text").rlike(rf"\A{space}*+(?:{word}++{space}++){{0,{order - 3}}}+{word}*+{space}*+\z"))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, short = Grams(pdf, order).low(order)
            yield pd.DataFrame({"slot": np.unique(_slot(short[:, 0]))})

    out[[r[0] for r in few.mapInPandas(slots, "slot long").distinct().collect()]] = True
    return out


def backoff_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, n_words, n_by_order, log10_prob, score`` of every row of ``docs(doc_id, text)``; ``order`` is 2 or more.

    ``n_by_order`` counts the words scored at each order, ``log10_prob`` sums the words' log10 scores
    and ``score`` is their mean (null without words). ASCII letters are lower-cased. The corpus is
    ``docs`` itself, repeated rows included, and no n-gram is pruned, whatever its count; so no word has to
    back off (the factor would be ``BACKOFF``) but those at the start of a document, which have no longer n-gram.
    Null and empty texts have no words; an empty table gives an empty result; texts of any length are read whole; other
    columns of the input are left out. Rows are numbered within the scan's partitions, so ``docs`` is to be a written
    table, which a repeated task reads in the same order.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = n_groups(docs, PART_BYTES, LEAST_PARTS)
    contexts, grams = frequent(docs, order)
    blocks = docs.mapInPandas(explode(order, parts, contexts, grams, short_slots(docs, order)), _BLOCK)
    sums = blocks.groupBy("part").applyInPandas(join_counts, _SUM)
    per = materialise(sums.groupBy("base").applyInPandas(add_up, _ROW))
    total = float(max(1, per.agg(F.sum("n_words")).first()[0] or 0))
    extra = with_frequent(frequent_logs(per, len(contexts) + len(grams)))
    n = F.col("n_words")
    prob = F.when(n > 0, F.col("value") + F.col("extra") - F.log10(F.lit(total))).otherwise(F.lit(0.0))
    by_order = F.array(*(F.least(F.lit(1), F.greatest(n - (k - 1), F.lit(0))).cast("long") for k in range(1, order)), F.greatest(n - (order - 1), F.lit(0)).cast("long"))
    return per.withColumn("extra", extra("hot")).select("doc_id", "n_words", by_order.alias("n_by_order"), prob.alias("log10_prob"), F.when(n > 0, prob / n).alias("score"))


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document against the counts of all n-grams of all documents, none pruned."""
    out = backoff_scores(table(spark, sf_dir, "documents"))
    by = F.col("n_by_order")
    return out.select("doc_id", "n_words", *(by[k].alias(f"n_order{k + 1}") for k in range(ORDER)), F.round("log10_prob", 4).alias("log10_prob"), F.round("score", 6).alias("score"))


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT doc_id, i, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), u AS (SELECT w, count(*) AS c FROM t GROUP BY w
), b AS (SELECT w1, w, count(*) AS c FROM t WHERE i > 1 GROUP BY w1, w
), g AS (SELECT w2, w1, w, count(*) AS c FROM t WHERE i > 2 GROUP BY w2, w1, w
), s AS (
  SELECT t.doc_id, CASE WHEN g.c > 0 THEN 3 WHEN b.c > 0 THEN 2 ELSE 1 END AS k,
         CASE WHEN g.c > 0 THEN log10(g.c / CAST(b2.c AS DOUBLE))
              WHEN b.c > 0 THEN log10(b.c / CAST(u1.c AS DOUBLE)) + (least(i, 3) - 2) * log10({BACKOFF})
              ELSE log10(u.c / CAST((SELECT count(*) FROM t) AS DOUBLE)) + (least(i, 3) - 1) * log10({BACKOFF}) END AS v
  FROM t JOIN u ON t.w = u.w LEFT JOIN u u1 ON t.w1 = u1.w LEFT JOIN b ON t.w1 = b.w1 AND t.w = b.w
       LEFT JOIN b b2 ON t.w2 = b2.w1 AND t.w1 = b2.w LEFT JOIN g ON t.w2 = g.w2 AND t.w1 = g.w1 AND t.w = g.w
)
SELECT d.doc_id, CAST(coalesce(len(any_value(d.ws)), 0) AS BIGINT) AS n_words, count(*) FILTER (WHERE k = 1) AS n_order1, count(*) FILTER (WHERE k = 2) AS n_order2, count(*) FILTER (WHERE k = 3) AS n_order3,
       round(coalesce(sum(v), 0), 4) AS log10_prob, round(avg(v), 6) AS score
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
