"""Quality by co-training two views of a document.

One view is the text's content (words and word shapes), the other the page's metadata (language,
source, and the layout of lines and characters). Each view has a logistic model of its own. In
each round both give the unlabelled rows they are surest of to a common set, from which the other
one learns too. In the end each view is calibrated on labelled rows that trained neither of them, and the mean of their log-odds
scores all documents.

Only the samples that the parameters bound come to the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialise, table
from .toxicity import by_hash, calibrate

#: Bounds of what is drawn for training, all of them parameters of ``fit``: labelled rows of each class, unlabelled rows, and bytes of a
#: row (a longer one gives its place to the next).
LABELLED, POOL, MAX_BYTES = 1500, 3000, 1 << 17
#: Rounds, and rows that a view gives of each class in a round; every CALIBRATED-th labelled row calibrates the views and trains none.
ROUNDS, GIVEN, CALIBRATED = 4, 100, 4
THRESHOLD = 0.5
_DIMS = 1 << 15
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Upper-case letters as X, other letters as x, digits as 9, all else as it is; runs are one."""
    out = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return _RUN.sub(r"\1", out)


class Content:
    """Hashed words and shapes of a text, weighted by the root of their share."""

    def __init__(self):
        self.cache: dict[str, tuple[int, int]] = {}

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of all features."""
        import xxhash

        rows, cols, vals = [], [], []
        for i, t in enumerate(texts):
            words = t.split() if t else []
            if not words:
                continue
            if len(self.cache) > 500_000:
                self.cache.clear()
            ids = []
            for w in words:
                if (x := self.cache.get(w)) is None:
                    x = self.cache[w] = (xxhash.xxh32_intdigest(w.lower().strip(".,")) % (_DIMS // 2), _DIMS // 2 + xxhash.xxh32_intdigest(shape(w)) % (_DIMS // 2))
                ids += x
            c, n = np.unique(np.array(ids), return_counts=True)
            rows.append(np.full(len(c), i)), cols.append(c), vals.append(np.sqrt(n / len(words)))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return cat(rows, np.int64), cat(cols, np.int64), cat(vals, float)


_PAGE = 9


def page(text: str | None, lang: str | None, source: str | None) -> tuple[list[float], list[int]]:
    """Numbers of the layout, and hashed columns of the language and the source."""
    import xxhash

    t = text or ""
    n = max(1, len(t))
    lines = t.split("\n")
    words = t.split()
    letters = sum(map(str.isalpha, t))
    return [
        math.log1p(len(t)), math.log1p(len(lines)), math.log1p(len(words) / len(lines)), len(set(lines)) / len(lines), 5 * letters / n,
        5 * sum(map(str.isupper, t)) / n, 5 * sum(map(str.isdigit, t)) / n, 5 * (n - letters - t.count(" ")) / n, len(t) / max(1, len(words)) / 5,
    ], [_PAGE + xxhash.xxh32_intdigest(f"l:{lang}") % 32, _PAGE + 32 + xxhash.xxh32_intdigest(f"s:{source}") % 96]


def _page_rows(docs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols, vals = [], [], []
    for i, d in enumerate(docs):
        numbers, ids = page(*d)
        rows += [i] * (_PAGE + 2)
        cols += [*range(_PAGE), *ids]
        vals += [*numbers, 1.0, 1.0]
    return np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals, float)


class Logistic:
    """Logistic regression on sparse rows by full-batch Adam."""

    def __init__(self, dims: int):
        self.w, self.b, self.a, self.c = np.zeros(dims), 0.0, 1.0, 0.0

    def raw(self, x: tuple, n: int) -> np.ndarray:
        return np.bincount(x[0], self.w[x[1]] * x[2], n) + self.b if len(x[0]) else np.full(n, self.b)

    def fit(self, x: tuple, y: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-4) -> Logistic:
        n, d = len(y), len(self.w)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
        m, v = np.zeros(d + 1), np.zeros(d + 1)
        for k in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(self.raw(x, n), -30, 30)))
            e = (p - y) * weight
            g = np.append(np.bincount(x[1], e[x[0]] * x[2], d) + decay * self.w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            self.w, self.b = self.w - step[:-1], self.b - step[-1]
        return self


def _pick(x: tuple, rows: np.ndarray) -> tuple:
    """The given rows of sparse rows, renumbered in order."""
    order = np.argsort(x[0], kind="stable")
    starts = np.searchsorted(x[0][order], [rows, rows + 1])
    take = np.concatenate([order[a:b] for a, b in starts.T]) if len(rows) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(rows)), starts[1] - starts[0]), x[1][take], x[2][take]


class Model:
    def __init__(self, labelled: list[tuple], y: list[int], pool: list[tuple]):
        """``labelled`` and ``pool`` hold (text, lang, source)."""
        self.views = (Logistic(_DIMS), Logistic(_PAGE + 128))
        self.constant = None
        y = np.array(y, float)
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return
        docs = labelled + pool
        x = self._features(docs)
        apart = self._apart(y)
        know, left = np.setdiff1d(np.arange(len(y)), apart), np.arange(len(y), len(docs))
        goal = y[know]
        for r in range(ROUNDS + 1):
            for view, rows in zip(self.views, x):
                view.fit(_pick(rows, know), goal, rounds=120 if not r else 40)
            if r == ROUNDS or not len(left):
                break
            new: dict[int, float] = {}
            for view, rows in zip(self.views, x):
                s = view.raw(_pick(rows, left), len(left))
                order = np.argsort(s, kind="stable")
                for side, value in ((order[::-1][:GIVEN], 1.0), (order[:GIVEN], 0.0)):
                    for i in side:
                        if (s[i] > 1) if value else (s[i] < -1):
                            j = int(left[i])
                            new[j] = value if new.get(j, value) == value else -1.0  # the views disagree
            given = {j: v for j, v in new.items() if v >= 0}
            if not given:
                break
            know, goal = np.append(know, list(given)).astype(np.int64), np.append(goal, list(given.values()))
            left = left[~np.isin(left, list(given))]
        for view, rows in zip(self.views, x):
            view.a, view.c = calibrate(view.raw(_pick(rows, apart), len(apart)), y[apart], balanced=True)

    @staticmethod
    def _apart(y: np.ndarray) -> np.ndarray:
        """Every ``CALIBRATED``-th row of each class; all rows if a class has too few to give some away."""
        of = [np.flatnonzero(y == v) for v in (0, 1)]
        if min(map(len, of)) < 2 * CALIBRATED:
            return np.arange(len(y))
        return np.sort(np.concatenate([i[CALIBRATED - 1 :: CALIBRATED] for i in of]))

    @staticmethod
    def _features(docs: list[tuple], content: Content | None = None) -> tuple[tuple, tuple]:
        return (content or Content()).rows([d[0] for d in docs]), _page_rows(docs)

    def score(self, docs: list[tuple], content: Content | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        odds = [v.a * v.raw(x, len(docs)) + v.c for v, x in zip(self.views, self._features(docs, content))]
        return 1 / (1 + np.exp(-np.clip((odds[0] + odds[1]) / 2, -30, 30)))


def _drawn(docs: DataFrame, of: DataFrame | None, n: int, max_bytes: int) -> list[tuple]:
    """``doc_id, text, lang, source`` of at most ``n`` ids, the first in the order of a hash; of the ids in ``of``, or of all.

    The hash's range is cut first (twice what ``n`` rows need, by the exact count), so that the sort sees few rows.
    """
    short = docs.filter((F.octet_length("text") <= max_bytes) & F.col("doc_id").isNotNull())
    ids = (short.select("doc_id").join(of.select("doc_id").distinct(), "doc_id") if of is not None else short.select("doc_id")).withColumn("h", by_hash(F.col("doc_id")))
    ids = materialise(ids)
    rows = ids.count()
    if rows > 4 * n:
        # Repeated ids share a hash, so the cut is widened until it holds enough distinct ones.
        share = 2 * n / rows
        while share < 1:
            part = ids.filter(F.col("h") < f"{int(share * (1 << 32)):08x}").distinct()
            if part.limit(n).count() == n:
                ids = part
                break
            share *= 4
    ids = ids.distinct().orderBy("h", "doc_id").limit(n)
    one = short.join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id").agg(F.min(F.struct("text", "lang", "source")).alias("d")).select("h", "doc_id", "d.*")
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in sorted(one.collect(), key=lambda r: (r["h"], r["doc_id"]))]


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", labelled: int = LABELLED, pool: int = POOL, max_bytes: int = MAX_BYTES) -> Model:
    """A model of ``labels.quality`` from rows that are not held out, and of unlabelled ones. Without both classes it gives one score to all."""
    open_ = labels.filter(~held_out(F.col("doc_id")))
    rows, y, seen = [], [], set()
    for value in (0, 1):
        for i, *d in _drawn(docs, open_.filter(F.col(column) == value), labelled, max_bytes):
            rows.append(tuple(d)), y.append(value), seen.add(i)
    unlabelled = [tuple(d) for i, *d in _drawn(docs, None, pool, max_bytes) if i not in seen] if seen else []
    return Model(rows, y, unlabelled)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``text, lang, source``) plus ``quality_score``. Nulls are values like any other; a null text is empty.

    An input column of that name is replaced, other columns stay; an empty table gives an empty result. Texts of any length are read whole.
    """

    @F.pandas_udf("double")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        content = Content()
        for text, lang, source in batches:
            rows = list(zip(text, lang, source))
            yield pd.Series(np.concatenate([model.score(rows[i : i + 200], content) for i in range(0, len(rows), 200)]) if rows else np.zeros(0))

    return docs.withColumn("quality_score", udf("text", "lang", "source"))


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted, kept`` of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    score = F.col("quality_score")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), (score >= THRESHOLD).alias("kept")
    )
