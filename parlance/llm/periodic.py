"""Periodic runs of words, found by internal pattern matching.

A run of period q and at least three periods has, for the block length b with b <= q < 2b, a block that starts at a
multiple of b and stands once more q words on. So each such dyadic block asks for its own occurrences in the window of
starts from b to 2b words on: a range successor in a wavelet tree over the part of the suffix array that begins with
the block. All occurrences in such a window are one arithmetic progression. Of two, both distances are candidates; of
three or more with difference d, the block lies in a stretch of period d, and a longer period must map the ends of
that stretch to those of the stretch with the occurrences, or is the first or last distance. Candidates are checked
exactly over the text they come from.

A slice of texts is worked on at once. Words of different texts are different symbols, so nothing is found across.
Only positions whose LEAST words stand twice in a text go into the suffix array; the others end no search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest block; it also serves periods below, as runs have three times as many words at least.
LEAST = 8
#: Texts are taken together up to so many words; a longer one alone.
SLICE_WORDS = 250_000
RUN = "struct<start:long,length:long,period:long>"


class WaveletTree:
    """Over an array of numbers from 0, level by level: each keeps how many zero bits stand before each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.n, self.zeros = len(values), []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def less(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the entries from ``low`` to ``high`` are below ``x``."""
        out = np.where(x >> self.bits, high - low, 0)  # of more bits than any entry: all are below
        for level, zeros in enumerate(self.zeros):
            one = ((x >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = zeros[low], zeros[high]
            out += np.where(one & (x >> self.bits == 0), b - a, 0)
            low, high = np.where(one, low - a + zeros[-1], a), np.where(one, high - b + zeros[-1], b)
        return out

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th entry, from 0, of those from ``low`` to ``high`` in order of size."""
        k, out = k.copy(), np.zeros(len(k), np.int64)
        for zeros in self.zeros:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k -= np.where(one, b - a, 0)
            out = out * 2 + one
            low, high = np.where(one, low - a + zeros[-1], a), np.where(one, high - b + zeros[-1], b)
        return out


def repeated_ranks(symbols: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(b, ranks) for b = LEAST, 2 * LEAST, ... while any b symbols stand twice, by doubling.

    Positions with equal b symbols have one rank, below len(symbols); those whose b symbols stand once have ranks of
    their own from len(symbols) on. Ranks of 2b keep the order of those of b.
    """
    n, out, b = len(symbols), [], 1
    _, back, count = np.unique(symbols, return_inverse=True, return_counts=True)
    held = np.flatnonzero(count[back] > 1)
    alone = n + np.arange(2 * n, dtype=np.int64)
    rank = alone.copy()
    rank[held] = back[held]
    while True:
        if b >= LEAST:
            if not len(held):
                return out
            out.append((b, rank[:n]))
        key = rank[held] * (3 * n + 1) + rank[np.minimum(held + b, 2 * n - 1)]
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], np.diff(key[order]) > 0]) if len(held) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        twice = np.bincount(group)[group] > 1
        held, group = held[order][twice], group[twice]
        rank = alone.copy()
        rank[held] = group
        b *= 2
        if b < LEAST or len(held):
            continue
        return out


def occurrences(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block length and window (start of a block, its first, second and last occurrence there), -1 for no second."""
    levels = repeated_ranks(symbols)
    if not levels:
        return
    n = len(symbols)
    held = np.flatnonzero(levels[0][1] < n)
    suffixes = held[np.lexsort([ranks[held] for _, ranks in reversed(levels)])]
    tree = WaveletTree(suffixes)
    place = np.full(n, -1)
    place[suffixes] = np.arange(len(suffixes))
    for b, ranks in levels:
        blocks = np.arange(0, n, b)
        blocks = blocks[ranks[blocks] < n]
        if not len(blocks):
            continue
        of = ranks[suffixes]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        group = np.searchsorted(first, place[blocks], "right") - 1
        low, high = first[group], np.append(first, len(of))[group + 1]
        for near, far in ((1, b + 1), (b + 1, 2 * b)) if b == LEAST else ((b, 2 * b),):
            before, through = tree.less(low, high, blocks + near), tree.less(low, high, blocks + far)
            some = np.flatnonzero(through > before)
            at, lo, hi, c, e = blocks[some], low[some], high[some], before[some], through[some]
            second = np.where(e - c > 1, tree.smallest(lo, hi, np.minimum(c + 1, e - 1)), -1)
            yield at, tree.smallest(lo, hi, c), second, tree.smallest(lo, hi, e - 1)


def _stretches(words: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the longest stretches in which words ``q`` apart are equal, of more than ``q`` words."""
    same = np.concatenate([[False], words[:-q] == words[q:], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    return edge[::2], edge[1::2] + q


def _periods(words: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, last: np.ndarray) -> set[int]:
    """Candidate periods of one text, from what its blocks found."""
    out = {*np.unique(first - at).tolist(), *np.unique(last - at).tolist()}
    many = (second >= 0) & (last > second)
    for d in np.unique((second - first)[many]).tolist():
        these = many & (second - first == d)
        begin, end = _stretches(words, d)
        x = np.searchsorted(begin, at[these], "right") - 1
        y = np.searchsorted(begin, first[these], "right") - 1
        apart = (x != y) & (x >= 0) & (y >= 0)
        x, y = x[apart], y[apart]
        out.update(np.unique(end[y] - end[x]).tolist(), np.unique(begin[y] - begin[x]).tolist())
    return {q for q in out if q > 0}


def _runs(words: np.ndarray, periods: set[int], least: int, powers: int) -> np.ndarray:
    """(start, length, period) by start, then period: the runs of these periods that have no smaller one."""
    found: list[tuple[int, int, int]] = []
    begins = ends = np.zeros(0, np.int64)
    for q in sorted(periods):
        if powers * q > len(words):
            break
        begin, end = _stretches(words, q)
        long = end - begin >= max(least, powers * q)
        begin, end = begin[long], end[long]
        if len(begin) and len(begins):  # of a smaller period: within a run that was found before
            order = np.argsort(begins, kind="stable")
            reach = np.maximum.accumulate(ends[order])
            k = np.searchsorted(begins[order], begin, "right") - 1
            inside = (k >= 0) & (reach[np.maximum(k, 0)] >= end)
            begin, end = begin[~inside], end[~inside]
        found += [(a, b - a, q) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        begins, ends = np.concatenate([begins, begin]), np.concatenate([ends, end])
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def runs_of(texts: list[np.ndarray], least: int = 24, powers: int = 3) -> list[np.ndarray]:
    """The runs of each of ``texts``, arrays of word numbers; see periodic_runs."""
    none = np.zeros((0, 3), np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    base = np.cumsum([0, *(int(t.max()) + 1 if len(t) else 0 for t in texts)])
    if not bounds[-1]:
        return [none for _ in texts]
    symbols = np.concatenate([t + b for t, b in zip(texts, base[:-1], strict=True)])
    parts = list(occurrences(symbols))
    out = [none] * len(texts)
    if not parts:
        return out
    at, first, second, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    owner = np.searchsorted(bounds, at, "right") - 1
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(owner[order]) > 0, [True]])) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        these, i = order[a:b], int(owner[order[a]])
        own = bounds[i]
        periods = _periods(texts[i], at[these] - own, first[these] - own, np.where(second[these] < 0, -1, second[these] - own), last[these] - own)
        out[i] = _runs(texts[i], periods, least, powers)
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are kept if of each run only the first period is."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:-1] == 0


def _numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def _run(least: int, powers: int):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def close(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of([_numbered(x) for x in texts], least, powers)
        collapsed = [b" ".join(w if not len(r) else [w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()]) for w, r in zip(texts, runs, strict=True)]
        flat = np.concatenate(runs)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()  # bytes: at 0x20 and 0x09-0x0D, no others
                if texts and size + len(words) > SLICE_WORDS:
                    yield close(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(name)
                texts.append(words)
                size += len(words)
            if texts:
                yield close(ids, texts)

    return run


def periodic_runs(docs: DataFrame, least: int = 24, powers: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of ``docs``, over its whole text.

    A run (start, length, period) is a stretch of words, counted from 0, with smallest period q (words q apart are the
    same) and ``length`` >= max(least, powers * q) that no neighbouring word extends; ``runs`` has all, by start, then
    period. ``collapsed`` is the text's words joined by one space, without those that any run has after its first
    period. ``least`` is 3 * LEAST or more and ``powers`` 3 or more, which the search needs.

    Null or empty text: no words, no runs, an empty text. Each row stands for itself, whatever its id. Empty table: no
    rows. Other columns are ignored. A text is worked on in one task, in memory of some 300 bytes a word.
    """
    if least < 3 * LEAST or powers < 3:
        raise ValueError(f"least must be {3 * LEAST} or more, and powers 3 or more")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(_run(least, powers), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
