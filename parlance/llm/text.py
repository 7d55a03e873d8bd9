"""Words and hashes of many texts at once, over the UTF-8 buffers that Arrow hands to a task.

A word is a longest run of bytes other than space and 0x09-0x0D; hashing folds A-Z to a-z where asked.
All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of the contracts, as Java, Python and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Texts are taken in slices of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves half of the output's bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for slices of about ``slice_bytes``; null is as empty. A longer text is a slice alone."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, off_buf, data = texts.buffers()
    off = np.frombuffer(off_buf, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + slice_bytes, "right")) - 1)
        to = min(to, n)
        yield at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


class Words:
    """Words of a slice: ``hash`` and ``start`` (byte) of each, ``bounds``: of each text's words."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, fold: bool = True):
        ns = ~SPACE[raw]
        first = ns.copy()
        first[1:] &= ~ns[:-1]
        inner = off[1:-1]
        inner = inner[inner < len(raw)]
        first[inner] = ns[inner]
        nb = np.flatnonzero(ns)
        self.start = np.flatnonzero(first)
        self.bounds = np.searchsorted(self.start, off)
        self.n_bytes = len(raw)
        if not len(nb):
            self.hash = np.zeros(0, np.uint64)
            self.length = np.zeros(0, np.int64)
            return
        cum = np.searchsorted(nb, self.start)
        self.length = np.diff(np.append(cum, len(nb)))
        pos = np.arange(len(nb)) - np.repeat(cum, self.length)
        power = np.ones(int(self.length.max()), np.uint64)
        power[1:] = _BASE
        power = np.multiply.accumulate(power)
        vals = (_FOLDED if fold else _BYTE)[raw[nb]] * power[pos]
        self.hash = mix(np.add.reduceat(vals, cum) + self.length.astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries, runs across texts included (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * COEF[0]
    for i in range(1, k):
        out = out + h[i : n + i] * COEF[i]
    return mix(out + np.uint64(k))


def text_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct ``k``-word shingles as sorted hashes; a text of fewer words has one, of all its words."""
    win = windows(words.hash, k)
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        n = b - a
        if n >= k:
            yield np.unique(win[a : b - k + 1])
        elif n:
            yield windows(words.hash[a:b], int(n))
        else:
            yield np.zeros(0, np.uint64)
