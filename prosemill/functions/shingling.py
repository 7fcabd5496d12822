"""Shingles and neighbouring words of whole texts in Arrow batches: texts are one buffer of bytes and a shingle a place in it.

The same as ``text.shingles`` of ``text.plain_tokens``, and as ``text.words``, for lower-cased texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at once; a longer text is alone.
CHUNK = 1 << 20
#: Shingles of one step of ``_md5_heads``, so that its arrays stay in the cache.
STEP = 2048
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = True
_K = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_SHIFT = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
#: What a word of a block keeps of its bytes and the mark behind them, by the number of bytes left from -1 (none, and the mark is before) to 4.
_MASK = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_PAD = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def chunks(texts: Iterable[str | None], most: int = CHUNK) -> Iterator[list[bytes]]:
    """The texts in order, some at a time; null as empty."""
    out, size = [], 0
    for t in texts:
        b = t.encode() if t else b""
        if out and size + len(b) > most:
            yield out
            out, size = [], 0
        out.append(b)
        size += len(b)
    if out:
        yield out


def _cut(texts: list[bytes], a: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts, a space behind each, and how many there are up to the end of each text; ``word`` says which bytes of ``a`` are in one."""
    behind = np.zeros(len(a), bool)
    np.greater(word[:-1], word[1:], out=behind[1:])
    upto = np.searchsorted(np.flatnonzero(behind), np.cumsum([len(t) + 1 for t in texts]) - 1, "right")
    return np.where(word, a, np.uint8(32))[word | behind], upto


def runs(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``buf, start, end, n``: the words of all texts, a space behind each, where each text's runs of ``k`` words start and end, and how many runs it has. A shorter text is one run, one without words none."""
    a = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    buf, upto = _cut(texts, a, _WORD[a])
    ends = np.flatnonzero(buf == 32)
    starts = np.concatenate([ends[:0], [0], ends[:-1] + 1])[: len(ends)]
    words = np.diff(upto, prepend=0)
    n = np.where(words > 0, np.maximum(words - k + 1, 1), 0)
    first = np.arange(n.sum()) + np.repeat(upto - words - np.cumsum(n) + n, n)
    return buf, starts[first], ends[first + np.repeat(np.minimum(words, k) - 1, n)], n


def hashes(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The distinct runs of each text as Spark's ``xxhash64`` of them, in ascending order."""
    import xxhash

    buf, start, end, n = runs(texts, k)
    raw, digest = buf.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[i:j], 42) for i, j in zip(start.tolist(), end.tolist())), np.uint64, len(start)).view(np.int64)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([x for part in chunks(texts) for x in hashes(part)], dtype=object)


def hashed(text: Column) -> Column:
    """The distinct shingles of a text as sorted 64-bit hashes, none for null."""
    # Not repeated for a filter on it.
    return _hashed.asNondeterministic()(F.lower(text))


def _md5_heads(buf: np.ndarray, start: np.ndarray, size: np.ndarray, blocks: int, prefixes: np.ndarray) -> np.ndarray:
    """The first 32 bits, as a number, of the MD5 of each prefix (two bytes, one row each) and each place of ``buf``; all take ``blocks`` blocks of 64 bytes."""
    four = np.concatenate([buf, np.zeros(4, np.uint8)])
    four = np.ndarray(len(buf) + 1, "<u4", four, strides=(1,)).astype(np.uint32)
    out = np.empty((len(prefixes), len(start)), np.uint32)
    for lo in range(0, len(start), STEP):
        at, n = start[lo : lo + STEP], size[lo : lo + STEP]
        shape = len(prefixes), len(at)
        state = [np.full(shape, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        f = np.empty(shape, np.uint32)
        for block in range(blocks):
            m = []
            for w in range(16 * block, 16 * block + 16):
                left = np.clip(n + 2 - 4 * w, -1, 4) + 1
                x = four.take(at, mode="clip") << np.uint32(16) if w == 0 else four.take(at + (4 * w - 2), mode="clip")
                m.append((x & _MASK[left]) | _PAD[left])
            if block == blocks - 1:
                m[14] = ((n + 2) * 8).astype(np.uint32)
            a, b, c, d = (x.copy() for x in state)
            first = m[0][None] | prefixes[:, None] if block == 0 else m[0]
            t = np.empty(shape, np.uint32)
            # The head of the digest is settled three steps before the end.
            for i in range(61 if block == blocks - 1 else 64):
                if i < 16:
                    g = i
                    np.bitwise_xor(c, d, out=f)
                    f &= b
                    f ^= d
                elif i < 32:
                    g = (5 * i + 1) % 16
                    np.bitwise_xor(b, c, out=f)
                    f &= d
                    f ^= c
                elif i < 48:
                    g = (3 * i + 5) % 16
                    np.bitwise_xor(b, c, out=f)
                    f ^= d
                else:
                    g = 7 * i % 16
                    np.invert(d, out=f)
                    f |= b
                    f ^= c
                f += a
                f += (m[g] if g else first) + _K[i]
                s = _SHIFT[i // 16][i % 4]
                np.left_shift(f, np.uint32(s), out=t)
                f >>= np.uint32(32 - s)
                t |= f
                t += b
                a, b, c, d, t = d, t, b, c, a
            state = [state[0] + b] if block == blocks - 1 else [x + y for x, y in zip(state, (a, b, c, d))]
        out[:, lo : lo + STEP] = state[0].byteswap()
    return out


def least_md5(texts: list[bytes], seeds: int, k: int = 5) -> list[list[str]]:
    """For each text and seed (a digit) the least MD5 of the seed, a colon and a run, in hexadecimal; nothing for a text without runs.

    Heads of the digests are compared first, and only what has the least head is hashed whole.
    """
    if seeds > 10:
        raise ValueError("a seed is one digit")
    buf, start, end, n = runs(texts, k)
    out: list[list[str]] = [[] for _ in texts]
    if not len(start):
        return out
    md5 = lambda x: hashlib.md5(x, usedforsecurity=False)
    raw, size = buf.tobytes(), end - start
    prefixes = np.array([ord(str(s)) | ord(":") << 8 for s in range(seeds)], np.uint32)
    heads, blocks = np.empty((seeds, len(start)), np.uint32), (size + 10) // 64 + 1
    for b in np.unique(blocks):
        own = np.flatnonzero(blocks == b)
        if b <= 4:
            heads[:, own] = _md5_heads(buf, start[own], size[own], int(b), prefixes)
        else:
            for i in own.tolist():
                x = raw[start[i] : end[i]]
                heads[:, i] = [int.from_bytes(md5(b"%d:" % s + x).digest()[:4], "big") for s in range(seeds)]
    some = np.flatnonzero(n)
    least = np.repeat(np.minimum.reduceat(heads, (np.cumsum(n) - n)[some], axis=1), n[some], axis=1)
    of = np.repeat(np.arange(len(n)), n)
    for s in range(seeds):
        found: dict[int, set[bytes]] = {}
        for i in np.flatnonzero(heads[s] == least[s]).tolist():
            found.setdefault(int(of[i]), set()).add(raw[start[i] : end[i]])
        for doc, xs in found.items():
            out[doc].append(min(md5(b"%d:" % s + x).hexdigest() for x in xs))
    return out


def minhash_md5(text: Column, seeds: int = 8) -> Column:
    """The least MD5 of the shingles of a text under each seed, as ``dedup.minhash_md5`` has it; nothing for no shingles."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def least(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x for part in chunks(texts) for x in least_md5(part, seeds)], dtype=object)

    return least.asNondeterministic()(F.lower(text))


def signature(text: Column, least: Callable[[np.ndarray], np.ndarray]) -> Column:
    """``least`` (``dedup.least_maps``) of the hashed shingles of a text; nothing for no shingles."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([least(x) if len(x) else [] for part in chunks(texts) for x in hashes(part)], dtype=object)

    return signed.asNondeterministic()(F.lower(text))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for texts in chunks(batch.column(0).to_pylist(), 4 * CHUNK):
            a = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
            letter = (a >= 97) & (a <= 122)
            word = letter.copy()
            # An apostrophe or hyphen is part of a word between two letters.
            word[1:-1] |= ((a[1:-1] == 39) | (a[1:-1] == 45)) & letter[:-2] & letter[2:]
            buf, upto = _cut(texts, a, word)
            code, forms = pd.factorize(np.array(buf.tobytes().split(b" ")[:-1], object))
            if not len(code):
                continue
            h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in forms), np.uint64, len(forms)).view(np.int64)
            last = np.zeros(len(code), bool)
            last[upto[upto > 0] - 1] = True
            pair, n = np.unique((code[:-1].astype(np.int64) * len(forms) + code[1:])[~last[:-1]], return_counts=True)
            for at in range(0, len(n), 1 << 16):
                p = pair[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(h[p // len(forms)]), pa.array(h[p % len(forms)]), pa.array(n[at : at + (1 << 16)].astype(np.int64))], ["h1", "h2", "n"])


def word_pairs(texts: DataFrame) -> DataFrame:
    """``h1, h2, n``: neighbouring words (``text.words``) of the one text column of ``texts`` as Spark's ``xxhash64`` of them, and how often. Counted in parts of some MB of text before rows are made of them."""
    low = texts.select(F.lower(F.col(texts.columns[0])).alias("text"))
    return low.mapInArrow(_pairs, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
