"""Toxic spans by a linear-chain conditional random field with two states.

Labels mark documents, so tokens are labelled first: a word (or the first letters of a word)
that stands in significantly more toxic documents than clean ones marks its tokens in toxic
documents. A field over hashed word and prefix features with transitions is trained on these by
maximum likelihood. Forward-backward marginals give each token's probability; a document's score
is its largest marginal, calibrated on the training rows, and its spans are the runs of likely tokens.

Only the sample that the parameters bound comes to the driver.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, held_out, table

#: Bounds of the labelled sample, all of them parameters of ``fit``: toxic and clean rows from which evidence is counted, bytes of
#: a row that is drawn (a longer one gives its place to the next), and rows of each class whose tokens train the field.
SAMPLE_TOXIC, SAMPLE_CLEAN, MAX_BYTES, TRAIN = 2000, 3000, 1 << 17, 600
#: Documents that one gradient step adds up at a time.
CHUNK = 250
#: A document is toxic from this score on.
THRESHOLD = 0.7
SPAN = 0.5
#: Weights nearer to 0 are left out of a trained field.
_LEAST = 0.02
_TOKEN = re.compile(r"[^\W\d_]+")
#: Tokens that one forward-backward pass takes, unless a document has more.
BATCH_TOKENS = 500_000


def tokens(text: str | None) -> list[str]:
    """Runs of letters, each lower-cased by itself, so that places in the text stay what they are."""
    return [w.lower() for w in _TOKEN.findall(text)] if text else []


def features(word: str) -> list[str]:
    """The word, and its first 4, 5 and 6 letters."""
    return [f"w:{word}", *(f"{k}:{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]


def _scan(e: np.ndarray, t: np.ndarray, vectors: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Push row vectors ``(columns, k, 2)`` through the rows of one chain a column: times ``t``, then times the emission."""
    out = np.empty((*e.shape, 2)) if keep else None
    v = vectors
    for i in range(len(e)):
        a = t[i]
        x0 = v[..., 0] * a[:, None, 0] + v[..., 1] * a[:, None, 2]
        x1 = (v[..., 0] * a[:, None, 1] + v[..., 1] * a[:, None, 3]) * e[i][:, None]
        total = (x0 + x1).max(axis=1, keepdims=True)
        v = np.stack([x0 / total, x1 / total], axis=-1)
        if keep:
            out[i] = v[:, 0]
    return v, out


def _messages(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Normalised forward messages of one chain of emissions ``e`` and transitions ``t`` into each place.

    The chain is laid out in columns. A first pass multiplies each column's matrices, a short one
    carries a vector from column to column, and a last one fills the columns in, all at once.
    """
    n = len(e)
    rows = max(1, int(math.sqrt(n)))
    columns = -(-n // rows)
    pad = rows * columns - n
    e2 = np.concatenate([e, np.ones(pad)]).reshape(columns, rows).T
    t2 = np.concatenate([t, np.ones((pad, 4))]).reshape(columns, rows, 4).transpose(1, 0, 2)
    whole, _ = _scan(e2, t2, np.broadcast_to(np.eye(2), (columns, 2, 2)), False)
    starts, v = np.empty((columns, 1, 2)), np.array([0.5, 0.5])
    for c in range(columns):
        starts[c, 0] = v
        v = v @ whole[c]
        v = v / v.sum()
    _, out = _scan(e2, t2, starts, True)
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


class Field:
    """Weights of the features, of the bias, of the transitions and of the first token."""

    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray, first: np.ndarray):
        self.weights, self.bias, self.move, self.first = weights, bias, move, first

    def emissions(self, words: list[str]) -> list[float]:
        known = self.weights.get
        return [min(30.0, max(-30.0, self.bias + sum(known(f, 0.0) for f in features(w)))) for w in words]

    def run(self, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of state 1, and the expected number of each transition. ``starts`` marks the first token of each document."""
        n = len(e)
        odds = np.exp(e)
        move, first = np.exp(self.move).ravel(), np.exp(self.first)
        t = np.where(starts[:, None], np.array([first[0], first[1], first[0], first[1]])[None], move[None])
        a = _messages(odds, t)
        # Backward: the same from the end, with each transition turned over; a message holds its own token's emission.
        nxt = np.concatenate([t[1:], np.ones((1, 4))])[::-1][:, [0, 2, 1, 3]]
        b = _messages(odds[::-1], nxt)[::-1]
        joint = a * b / np.stack([np.ones(n), odds], axis=-1)
        p = joint[:, 1] / joint.sum(axis=1)
        inner = np.flatnonzero(~starts[1:])
        x = a[inner][:, :, None] * np.exp(self.move)[None] * b[inner + 1][:, None, :]
        return p, (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _spread(docs: list[list[str]], wanted: set[str] | None = None) -> tuple[Counter, int]:
    """In how many documents each feature stands between two words that no earlier document had around it, and the documents with any such place. Copies add nothing.

    Places are remembered in a table of hashed bits; a rare clash only loses a place.
    """
    seen = bytearray(1 << 26)
    mask = len(seen) - 1
    count, n = Counter(), 0
    for d in docs:
        new, own = set(), set()
        for a, w, b in zip(["", *d], d, [*d[1:], ""]):
            h = zlib.crc32(f"{a} {w} {b}".encode()) & mask
            if not seen[h]:
                own.add(h)
                new.add(w)
        for h in own:
            seen[h] = 1
        n += bool(new)
        found = {f for w in new for f in features(w)}
        count.update(found if wanted is None else found & wanted)
    return count, n


def evidence(toxic: list[list[str]], clean: list[list[str]]) -> tuple[set[str], set[str]]:
    """Features in significantly more toxic documents than chance gives and in next to no clean ones; and narrow prefixes.

    A narrow prefix hardly occurs but in one word or longer prefix, and would carry that word's
    weight over to strangers; it is no evidence.
    """
    many, n1 = _spread(toxic)
    least = 2 * math.log(max(2, len(many))) - 4
    narrow = set()
    for w in {w for d in toxic for w in d}:
        own = features(w)
        for k, f in enumerate(own[1:], 1):
            if any(many[g] >= 0.9 * many[f] for g in own[k + 1 :] + own[:1]):
                narrow.add(f)
    few, n0 = _spread(clean, {f for f, a in many.items() if a > 1 and f not in narrow})
    n1, n0 = max(1, n1), max(1, n0)
    out = set()
    for f, a in many.items():
        if a < 2 or f in narrow:
            continue
        b = few[f]
        rate = (a + b) / (n1 + n0)
        g2 = 2 * (a * math.log(a / (n1 * rate)) + (b * math.log(b / (n0 * rate)) if b else 0))
        if g2 >= least and b / n0 <= 0.02 * a / n1:
            out.add(f)
    return out, narrow


def _layout(chains: list[tuple[list[str], int]], is_toxic: dict[str, bool], code: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, marks and first-token flags of a chunk of documents laid end to end."""
    codes = np.fromiter((code[w] for d, _ in chains for w in d), np.int32)
    y = np.fromiter((bool(t and is_toxic[w]) for d, t in chains for w in d), bool, len(codes))
    starts = np.zeros(len(codes), bool)
    starts[np.cumsum([0, *(len(d) for d, _ in chains)])[:-1]] = True
    return codes, y, starts


def train(toxic: list[list[str]], clean: list[list[str]], rounds: int = 40, rate: float = 0.3, decay: float = 1e-3, most: int = TRAIN) -> Field:
    """Adam on the log-likelihood of the weakly labelled tokens of the first ``most`` documents of each class.

    Each step takes all of them; their gradients are added up chunk by chunk, so that memory holds one chunk's messages.
    """
    marks, narrow = evidence(toxic, clean)
    is_toxic = {w: any(f in marks for f in features(w)) for d in toxic for w in d}
    # Classes alternate, so that every chunk holds both.
    pair = [[(d, 1) for d in toxic if any(is_toxic[w] for w in d)][:most], [(d, 0) for d in clean if d][:most]]
    chains = [x for both in zip_longest(*pair) for x in both if x is not None]
    code: dict[str, int] = {}
    for d, _ in chains:
        for w in d:
            code.setdefault(w, len(code))
    field = Field({}, -4.0, np.zeros((2, 2)), np.zeros(2))
    if not pair[0]:
        field.bias = -30.0
        return field
    slot: dict[str, int] = {"": 0}  # 0 stands for no feature
    slots = np.zeros((len(code), 4), np.int64)
    for w, i in code.items():
        for j, f in enumerate(features(w)):
            if f not in narrow:
                slots[i, j] = slot.setdefault(f, len(slot))
    chunks = [_layout(chains[i : i + CHUNK], is_toxic, code) for i in range(0, len(chains), CHUNK)]
    x, m, v = np.zeros(len(slot) + 7), 0.0, 0.0
    for k in range(1, rounds + 1):
        field.bias, field.move, field.first = x[-7] - 4.0, x[-6:-2].reshape(2, 2), x[-2:]
        e = np.clip(x[slots].sum(axis=1) + field.bias, -30, 30)
        by_word, by_move, by_first = np.zeros(len(code)), np.zeros((2, 2)), np.zeros(2)
        for codes, y, starts in chunks:
            p, moved = field.run(e[codes], starts)
            state, inner = y.astype(int), np.flatnonzero(~starts[1:])
            by_word += np.bincount(codes, y - p, len(code))
            by_move += np.bincount(2 * state[inner] + state[inner + 1], minlength=4).reshape(2, 2) - moved
            by_first += np.bincount(state[starts], minlength=2) - [(1 - p[starts]).sum(), p[starts].sum()]
        by_slot = np.bincount(slots.ravel(), np.repeat(by_word, 4), len(slot))
        by_slot[0] = 0.0
        grad = np.concatenate([by_slot, [by_word.sum()], by_move.ravel(), by_first]) - decay * x
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    field.bias, field.move, field.first = x[-7] - 4.0, x[-6:-2].reshape(2, 2), x[-2:]
    field.weights = {f: float(x[i]) for f, i in slot.items() if i and abs(x[i]) >= _LEAST}
    return field


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 200, balanced: bool = False) -> tuple[float, float]:
    """Slope (at least 0) and offset of a logistic curve, fitted by Newton steps with Platt's smoothed targets.

    ``balanced`` gives both classes the same weight, as if they were equally frequent.
    """
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    each = np.where(y > 0, len(y) / (2 * max(1, pos)), len(y) / (2 * max(1, neg))) if balanced else np.ones(len(y))
    a, b = 0.0, 0.0 if balanced else math.log((pos + 1) / (neg + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = each * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(each * (goal - p) * x).sum() - 1e-3 * a, (each * (goal - p)).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-6:
            break
    return max(0.0, float(a)), float(b)


class Model:
    """A trained field and its calibration; ``score`` takes texts."""

    def __init__(self, field: Field | None, a: float = 0.0, b: float = 0.0):
        self.field, self.a, self.b = field, a, b
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def marginals(self, docs: list[list[str]]) -> np.ndarray:
        words = [w for d in docs for w in d]
        if not words:
            return np.zeros(0)
        column = np.empty(len(words), object)
        column[:] = words
        codes, unique = pd.factorize(column)
        if len(self.cache) > 1_000_000:
            self.cache.clear()
        new = [w for w in unique if w not in self.cache]
        if new:
            self.cache.update(zip(new, self.field.emissions(new)))
        e = np.fromiter((self.cache[w] for w in unique), float, len(unique))[codes]
        starts = np.zeros(len(words), bool)
        at = np.cumsum([0, *(len(d) for d in docs)])[:-1]
        starts[at[at < len(words)]] = True
        return self.field.run(e, starts)[0]

    def evidence_of(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """Log-odds of each text's likeliest toxic token (``LEAST`` without tokens), and its spans."""
        docs = [tokens(t) for t in texts]
        p = self.marginals(docs)
        out, at = [], 0
        for text, d in zip(texts, docs):
            own = p[at : at + len(d)]
            at += len(d)
            most = float(own.max()) if len(d) else 0.0
            most = min(max(most, 1e-6), 1 - 1e-6)
            spans = []
            if len(d) and most >= SPAN:
                for k, m in enumerate(_TOKEN.finditer(text)):
                    if own[k] >= SPAN:
                        if spans and spans[-1][3] == k - 1:
                            spans[-1][1:] = [m.end(), max(spans[-1][2], float(own[k])), k]
                        else:
                            spans.append([m.start(), m.end(), float(own[k]), k])
            out.append((math.log(most / (1 - most)), [{"start": a, "end": b, "p": q} for a, b, q, _ in spans]))
        return out

    def score(self, texts: list[str | None]) -> list[tuple[float, list]]:
        if self.field is None:
            return [(0.0, [])] * len(texts)
        return [(1 / (1 + math.exp(-min(30.0, max(-30.0, self.a * x + self.b)))), spans) for x, spans in self.evidence_of(texts)]


def by_hash(doc_id: Column) -> Column:
    """A random order of the ids that every run repeats."""
    return F.md5(doc_id.cast("string").cast("binary"))


def sample(docs: DataFrame, labels: DataFrame, column: str, value: int, n: int, max_bytes: int = MAX_BYTES) -> list[str]:
    """Texts of at most ``n`` rows labelled ``value`` that are not held out: the first in the order of a hash of their id.

    Ids with a text of over ``max_bytes`` are passed over before the ``n`` are counted, so the next ones take their place.
    """
    if not n:
        return []
    open_ = labels.filter((F.col(column) == value) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    short = docs.filter(F.octet_length("text") <= max_bytes)
    ids = short.select("doc_id").join(open_, "doc_id").distinct().withColumn("h", by_hash(F.col("doc_id"))).orderBy("h", "doc_id").limit(n)
    rows = short.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id").agg(F.min("text").alias("text"))  # n rows
    return [r["text"] for r in sorted(rows.collect(), key=lambda r: (r["h"], r["doc_id"]))]


def fit(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN, max_bytes: int = MAX_BYTES, n_train: int = TRAIN) -> Model:
    """A model of ``labels.toxic`` from a bounded sample of open rows; without both classes, one that gives 0 to all."""
    toxic, clean = ([[sys.intern(w) for w in tokens(t)] for t in sample(docs, labels, "toxic", v, n, max_bytes)] for v, n in ((1, n_toxic), (0, n_clean)))
    return learn(toxic, clean, n_train)


def learn(toxic: list[list[str]], clean: list[list[str]], n_train: int = TRAIN) -> Model:
    """A model from the tokens of labelled documents: the field, and the calibration of its largest marginals."""
    if not toxic or not clean:
        return Model(None)
    field = train(toxic, clean, most=n_train)
    model = Model(field)
    x = np.array([m for docs_ in (toxic, clean) for i in range(0, len(docs_), 200) for m in _most(model, docs_[i : i + 200])])
    y = np.array([1] * len(toxic) + [0] * len(clean))
    model.a, model.b = calibrate(x, y, balanced=True)
    return model


def _most(model: Model, docs: list[list[str]]) -> list[float]:
    p = model.marginals(docs)
    out, at = [], 0
    for d in docs:
        q = min(max(float(p[at : at + len(d)].max()) if d else 0.0, 1e-6), 1 - 1e-6)
        out.append(math.log(q / (1 - q)))
        at += len(d)
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus a struct ``toxicity`` of ``score`` and ``spans`` (offsets into the text).

    A null text is empty, and an empty one scores what a text without any toxic token does. Rows are scored each by itself, repeated
    ones alike; texts of any length are scored whole. An empty table gives an empty result. An input column ``toxicity``
    is replaced, all others stay.
    """

    @F.pandas_udf("score double, spans array<struct<start: int, end: int, p: double>>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, part, size = [], [], 0
            for t in batch:
                if part and size + len(t or "") > 6 * BATCH_TOKENS:
                    out += model.score(part)
                    part, size = [], 0
                part.append(t)
                size += len(t or "")
            out += model.score(part) if part else []
            yield pd.DataFrame({"score": [s for s, _ in out], "spans": [s for _, s in out]})

    return docs.drop("toxicity").withColumn("toxicity", udf("text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the offending ``spans`` of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity.score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.col("toxicity.spans").alias("spans"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns, one called ``toxicity`` included."""
    whole = docs.columns
    (kept,) = free_name(docs, "kept_toxicity")
    out = scored(docs.withColumnRenamed("toxicity", kept), model).filter(F.col("toxicity.score") < threshold).drop("toxicity")
    return out.withColumnRenamed(kept, "toxicity").select(*whole)
