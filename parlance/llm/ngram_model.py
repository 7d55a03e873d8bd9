"""Scoring texts by an interpolated modified Kneser-Ney model of order 2 or 3 that is counted in Spark.

The model is sorted arrays in the shared folder, which workers map into memory:

* ``vocabulary``: 64-bit hashes of the words, sorted; a word's rank is its number;
* ``trigrams``, of order 3: sorted 64-bit hashes of three numbers, and their counts;
* ``bigrams``: sorted keys (number of the word before, number of the word); how often each is there, of order 3 after
  how many different words; of order 3 also its sum as a context, and how many trigrams it begins that are there once,
  twice and more often;
* ``words``: for each number its count, its sum and discounted mass as a context, and its lower-order probability.

Each is cut into files by leading bits, so a file is what one task sorted. Tasks send sorted keys of whole slices as
packed blobs, with differences byte by byte, not a row for each token. A word that is the context of very many
bigrams is dealt by the second word too, so no file holds more than others by much; its sums are added up after.
Trigrams are dealt as the bigram of their last two words, so that a task knows after how many words that one stands.
Two of n trigrams have the same hash by a chance of n * n / 2**65; these would be counted as one.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.storage import new_path, written
from parlance.llm.text import COEF, Words, buffers, mix
from parlance.llm.tokenizing import held

#: Entries in a file, about; and unique entries that a task gathers before it sends them.
FILE_ENTRIES, SENT_ENTRIES = 4_000_000, 1_000_000
#: Number of the start of a text, and of a word that training has not; both only as contexts.
START, UNKNOWN = np.uint64(2**32 - 1), np.uint64(2**32 - 2)
#: Hash of the token that ends a text.
END = mix(np.array([COEF[60]], np.uint64))[0]
_SLOTS = (("count", "<u8"), ("total", "<u8"), ("mass", "<f8"), ("lower", "<f8"))


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Writes a file whole or not at all; a second try writes the same."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
    fs.move(part, f"{path}/{name}")


def _shared(spark: SparkSession, folder: str) -> str:
    """``folder`` as workers open it: a path where it is mounted, else files that Spark brings to each executor."""
    if urlparse(folder).scheme in ("", "file"):
        return urlparse(folder).path
    spark.sparkContext.addFile(folder, recursive=True)
    return "spark-files:" + folder.rstrip("/").rpartition("/")[2]


def _map(folder: str, name: str, kind: str) -> np.ndarray:
    if folder.startswith("spark-files:"):
        folder = SparkFiles.get(folder.removeprefix("spark-files:"))
    path = f"{folder}/{name}"
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def _narrow(x: np.ndarray) -> np.ndarray:
    """In as few bytes an entry as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _map_narrow(folder: str, name: str, n: int) -> np.ndarray:
    data = _map(folder, name, "u1")
    return data.view(f"<u{len(data) // n}") if n else data


def _bits(entries: int) -> int:
    return max(1, math.ceil(math.log2(max(2, entries / FILE_ENTRIES))))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray], *rest: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted different keys, the sums of their counts, and of the rest, which goes by key, the first."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(count, first) if len(first) else count, *(np.concatenate(x)[order[first]] for x in rest)


def _firsts(marks: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    return np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])) if len(marks) else np.zeros(0, np.int64)


class _Gather:
    """Counts of keys over many slices, with what goes by key, given out when there are many."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, keys: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...] | None:
        if rest:
            u, at, c = np.unique(keys, return_index=True, return_counts=True)
        else:
            (u, c), at = np.unique(keys, return_counts=True), None
        self.parts.append((u, c, *(x[at] for x in rest)))
        self.n += len(u)
        if self.n < 2 * SENT_ENTRIES:
            return None
        found = self.rest()
        if len(found[0]) >= SENT_ENTRIES:
            self.__init__()
            return found
        self.parts, self.n = [found], len(found[0])
        return None

    def rest(self) -> tuple[np.ndarray, ...] | None:
        return _merged(*map(list, zip(*self.parts, strict=True))) if self.parts else None


def _tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, with an end after each text; bounds by text)."""
    words = Words(raw, off)
    n = len(off) - 1
    bounds = words.bounds + np.arange(n + 1)
    out = np.full(bounds[-1], END, np.uint64)
    at = np.ones(len(out), bool)
    at[bounds[1:] - 1] = False
    out[at] = words.hash
    return out, bounds


def _packed(x: np.ndarray, kind: str) -> bytes:
    """Numbers of one place of all entries together, so that the zeros of small ones are cheap to send."""
    return x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gather = _Gather()

    def rows(found):
        key, count = found
        for i in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 50_000].view(np.int64)), pa.array(count[i : i + 50_000].astype(np.int64))], names=["h", "c"])

    for batch in batches:
        for _, raw, off in buffers(batch.column(0)):
            if found := gather.add(_tokens(raw, off)[0]):
                yield from rows(found)
    if found := gather.rest():
        yield from rows(found)


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches of each file; rows come sorted by the first column."""
    now, parts = None, []
    for batch in batches:
        marks = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1), len(marks)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                if parts and marks[a] != now:
                    yield now, parts
                    parts = []
                now = int(marks[a])
                parts.append(batch.slice(a, b - a))
    if parts:
        yield now, parts


def _save_vocabulary(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, parts in _by_file(batches):
            h = np.concatenate([np.asarray(x.column(1)) for x in parts]).view(np.uint64)
            c = np.concatenate([np.asarray(x.column(2)) for x in parts]).astype(np.uint64)
            _save(folder, f"vocabulary-{file}", h)
            _save(folder, f"count-{file}", c)
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([len(h)], pa.int64())], names=["file", "n"])

    return run


class Vocabulary:
    """Numbers of words by their hashes."""

    def __init__(self, folder: str, sizes: list[int]):
        self.bits, self.folder = int(math.log2(len(sizes))), folder
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.files = [_map(folder, f"vocabulary-{i}", "<u8") if n else np.zeros(0, np.uint64) for i, n in enumerate(sizes)]

    def find(self, sorted_hashes: np.ndarray) -> np.ndarray:
        """Numbers, -1 where there is none."""
        out = np.full(len(sorted_hashes), -1, np.int64)
        edges = np.searchsorted(sorted_hashes >> np.uint64(64 - self.bits), np.arange(len(self.files) + 1, dtype=np.uint64))
        for i, file in enumerate(self.files):
            part = sorted_hashes[edges[i] : edges[i + 1]]
            if len(part) and len(file):
                at = np.minimum(np.searchsorted(file, part), len(file) - 1)
                out[edges[i] : edges[i + 1]] = np.where(file[at] == part, at + self.base[i], -1)
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        unique, back = np.unique(hashes, return_inverse=True)
        return self.find(unique)[back]


def _bigram_keys(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty(len(numbers), np.uint64)
    before[1:] = np.where(numbers[:-1] < 0, UNKNOWN, numbers[:-1].astype(np.uint64))
    before[bounds[:-1]] = START
    return (before << np.uint64(32)) | np.where(numbers < 0, UNKNOWN, numbers.astype(np.uint64))


def _files_of(keys: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """The file of each bigram: by its context, of a hot context by the second word as well."""
    before = keys >> np.uint64(32)
    at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
    spread = np.where(hot[at] == before, (keys & np.uint64(0xFFFFFFFF)) + np.uint64(1), np.uint64(0))
    return (mix(before * COEF[61] ^ mix(spread * COEF[62])) >> np.uint64(64 - bits)).astype(np.int64)


def _words_before(pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before each bigram; each text is as after two starts."""
    out = np.empty_like(pairs)
    out[1:] = pairs[:-1] >> np.uint64(32)
    out[bounds[:-1]] = START
    return out


def _trigram_hash(pairs: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(pairs * COEF[59] ^ mix(before * COEF[58] + COEF[57]))


#: Of bigrams: how often, then as contexts of trigrams their sum and how many of these are there once, twice, more often.
_COLUMNS = ("times", "sum", "once", "twice", "more")
_PAIR_BLOBS = "file int, keys binary, " + ", ".join(f"{x} binary" for x in _COLUMNS) + ", top binary"
_TRIGRAM_BLOBS = "file int, pairs binary, before binary, counts binary"


def _dealt(file: np.ndarray, bits: int, *by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(file, its entries) of the files that have some, in the order of ``by``, or as they come."""
    order = np.lexsort((*by, file)) if by else np.argsort(file, kind="stable")
    cuts = np.searchsorted(file[order], np.arange(2**bits + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        yield int(i), order[cuts[i] : cuts[i + 1]]


def _pair_blobs(key: np.ndarray, columns: dict[str, np.ndarray], hot: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted bigrams as rows of _PAIR_BLOBS; columns that are not given are null, which is as zeros."""
    for i, at in _dealt(_files_of(key, hot, bits), bits):
        keys = _packed(np.diff(key[at], prepend=np.uint64(0)), "<u8")
        packed = [_packed(columns[x][at], "<u8") if x in columns else None for x in _COLUMNS]
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x], pa.binary()) for x in (keys, *packed, None))], names=["file", "keys", *_COLUMNS, "top"])


def _count_pairs(folder: str, sizes: list[int], hot: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, gather = held(("vocabulary", folder), lambda: Vocabulary(folder, sizes)), _Gather()
        blobs = lambda found: _pair_blobs(found[0], {"times": found[1]}, hot, bits)
        for batch in batches:
            for _, raw, off in buffers(batch.column(0)):
                tokens, bounds = _tokens(raw, off)
                if found := gather.add(_bigram_keys(vocabulary.numbers(tokens), bounds)):
                    yield from blobs(found)
        if found := gather.rest():
            yield from blobs(found)

    return run


def _count_trigrams(folder: str, sizes: list[int], hot: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, gather = held(("vocabulary", folder), lambda: Vocabulary(folder, sizes)), _Gather()

        def blobs(found):
            _, count, pair, before = found
            for i, at in _dealt(_files_of(pair, hot, bits), bits, pair):
                packed = _packed(np.diff(pair[at], prepend=np.uint64(0)), "<u8"), _packed(before[at], "<u4"), _packed(count[at], "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["file", "pairs", "before", "counts"])

        for batch in batches:
            for _, raw, off in buffers(batch.column(0)):
                tokens, bounds = _tokens(raw, off)
                pairs = _bigram_keys(vocabulary.numbers(tokens), bounds)
                before = _words_before(pairs, bounds)
                if found := gather.add(_trigram_hash(pairs, before), pairs, before.astype(np.uint32)):
                    yield from blobs(found)
        if found := gather.rest():
            yield from blobs(found)

    return run


def _how_many(count: np.ndarray) -> list[int]:
    return [int((count == i).sum()) for i in (1, 2, 3, 4)]


def _save_trigrams(folder: str, hot: np.ndarray, bits: int):
    """Merges the blobs of each file, writes it, and gives out what the bigrams gain from it; ``top`` is how many trigrams are there once to four times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, parts in _by_file(batches):
            pairs, before, counts = [], [], []
            for part in parts:
                for p, b, c in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    pairs.append(np.cumsum(_unpacked(p.as_buffer(), "<u8"), dtype=np.uint64))
                    before.append(_unpacked(b.as_buffer(), "<u4"))
                    counts.append(_unpacked(c.as_buffer(), "<u4").astype(np.uint64))
            hashes = [_trigram_hash(p, b.astype(np.uint64)) for p, b in zip(pairs, before, strict=True)]
            key, count, pair, word = _merged(hashes, counts, pairs, before)
            hashes = pairs = before = counts = None
            _save(folder, f"trigrams-{file}", key)
            _save(folder, f"often-{file}", _narrow(count))
            key = None
            top = np.array(_how_many(count), "<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), *(pa.array([x], pa.binary()) for x in (b"", *[None] * len(_COLUMNS), top))], names=["file", "keys", *_COLUMNS, "top"])
            follows, n = np.unique(pair, return_counts=True)
            yield from _pair_blobs(follows, {"times": n}, hot, bits)
            context = (word.astype(np.uint64) << np.uint64(32)) | (pair >> np.uint64(32))
            order = np.argsort(context, kind="stable")
            context, count = context[order], count[order]
            first = _firsts(context)
            sums = lambda x: np.add.reduceat(x.astype(np.uint64), first)
            yield from _pair_blobs(context[first], dict(zip(_COLUMNS[1:], (sums(count), sums(count == 1), sums(count == 2), sums(count > 2)), strict=True)), hot, bits)

    return run


_STATS = ("id", "total", "n1", "n2", "n3", "n4", "cont")


def _save_bigrams(folder: str, order: int):
    """Merges the blobs of each file, writes it, and gives out what each number's sums gain from it; those of id -1 are of all bigrams, of -2 of all trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, parts in _by_file(batches):
            keys, columns, top = [], {x: [] for x in _COLUMNS[: 1 if order == 2 else None]}, np.zeros(4, np.int64)
            for part in parts:
                for row in range(len(part)):
                    cell = lambda x: part.column(x)[row]  # noqa: E731, B023
                    if cell("top").is_valid:
                        top += np.frombuffer(cell("top").as_buffer(), "<i8")
                        continue
                    keys.append(np.cumsum(_unpacked(cell("keys").as_buffer(), "<u8"), dtype=np.uint64))
                    for x, found in columns.items():
                        found.append(_unpacked(cell(x).as_buffer(), "<u8") if cell(x).is_valid else np.zeros(len(keys[-1]), np.uint64))
            out = [[np.array([x], np.int64) for x in (-2, 0, *top, 0)]]
            if keys:
                by_key, keys = np.concatenate(keys), None
                sort = np.argsort(by_key, kind="stable")
                by_key = by_key[sort]
                first = _firsts(by_key)
                key = by_key[first]
                _save(folder, f"bigrams-{file}", key)
                for x in columns:
                    found = np.add.reduceat(np.concatenate(columns[x])[sort], first)
                    _save(folder, f"{x}-{file}", _narrow(found))
                    count = found if x == "times" else count
                columns = sort = by_key = None
                key, count = key[count > 0], count[count > 0]  # two starts come before a word, and after none
                before = key >> np.uint64(32)
                first = _firsts(before)
                sums = lambda x: np.add.reduceat(x.astype(np.int64), first)  # noqa: E731, B023
                zero = np.zeros(len(first), np.int64)
                if len(key):
                    out.append([before[first].astype(np.int64), sums(count), sums(count == 1), sums(count == 2), sums(count > 2), zero, zero])
                word, n = np.unique(key & np.uint64(0xFFFFFFFF), return_counts=True)
                zero = np.zeros(len(word), np.int64)
                out.append([word.astype(np.int64), zero, zero, zero, zero, zero, n.astype(np.int64)])
                out.append([np.array([x], np.int64) for x in (-1, int(count.sum()), *_how_many(count), len(key))])
            for cols in out:
                for i in range(0, len(cols[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in cols], names=list(_STATS))

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of entries counted once, twice and more often, from how many there are of one to four; 0.75 where there are too few to tell."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), k) for k, x in zip((0.95, 1.95, 2.95), found, strict=True))


def _save_words(folder: str, base: list[int], d: tuple, dc: tuple, types: int, left: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, parts in _by_file(batches):
            at = np.concatenate([np.asarray(x.column("id")) for x in parts]) - base[file]
            col = {k: np.concatenate([np.asarray(x.column(k)) for x in parts]) for k in _STATS[1:]}
            n = base[file + 1] - base[file]
            total, mass, lower = np.zeros(n, "<u8"), np.zeros(n), np.full(n, left / (size + 1))
            total[at] = col["total"]
            mass[at] = d[0] * col["n1"] + d[1] * col["n2"] + d[2] * col["n3"]
            c = col["cont"]
            lower[at] += np.maximum(c - np.choose(np.minimum(c, 3), (0, *dc)), 0) / types
            for name, x in (("total", total), ("mass", mass), ("lower", lower)):
                _save(folder, f"{name}-{file}", x)
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([n], pa.int64())], names=["file", "n"])

    return run


def _table(folder: str, file: int, keys: str, columns: tuple[str, ...]) -> dict[str, np.ndarray] | None:
    try:
        key = _map(folder, f"{keys}-{file}", "<u8")
    except FileNotFoundError:  # nothing fell there
        return None
    return {"": key, **{x: _map_narrow(folder, f"{x}-{file}", len(key)) for x in columns}}


def _interpolated(count: np.ndarray, total: np.ndarray, mass: np.ndarray, d: tuple, lower: np.ndarray) -> np.ndarray:
    known = np.maximum(count - np.choose(np.minimum(count, 3).astype(int), (0, *d)), 0)
    safe = np.maximum(total, 1)
    return np.where(total > 0, known / safe + mass / safe * lower, lower)


class Model:
    """The mapped arrays, and scores by them."""

    def __init__(self, about: dict):
        folder = about["folder"]
        self.about = about
        self.vocabulary = Vocabulary(folder, about["sizes"])
        files, order = range(2 ** about["bits"]), about["order"]
        self.bigrams = [_table(folder, i, "bigrams", _COLUMNS[: 1 if order == 2 else None]) for i in files]
        self.trigrams = [_table(folder, i, "trigrams", ("often",)) for i in files] if order == 3 else []
        self.words = {name: [_map(folder, f"{name}-{i}", kind) if n else np.zeros(0, kind) for i, n in enumerate(about["sizes"])] for name, kind in _SLOTS}

    def of_words(self, name: str, numbers: np.ndarray, missing: float) -> np.ndarray:
        """Values of sorted numbers; ``missing`` for what is no word's."""
        out = np.full(len(numbers), missing, float)
        edges = np.searchsorted(numbers, self.vocabulary.base)
        for i, file in enumerate(self.words[name]):
            a, b = edges[i], edges[i + 1]
            if a < b:
                out[a:b] = file[numbers[a:b] - self.vocabulary.base[i]]
        return out

    def find(self, tables: list, keys: np.ndarray, pairs: np.ndarray, *columns: str) -> list[np.ndarray]:
        """Columns of sorted keys, 0 where there is none, in the files of ``pairs``."""
        out = [np.zeros(len(keys)) for _ in columns]
        for i, at in _dealt(_files_of(pairs, self.about["hot"], self.about["bits"]), self.about["bits"]):
            if (table := tables[i]) is not None and len(table[""]):
                place = np.minimum(np.searchsorted(table[""], keys[at]), len(table[""]) - 1)
                there = table[""][place] == keys[at]
                for x, column in zip(out, columns, strict=True):
                    x[at] = np.where(there, table[column][place], 0)
        return out

    def of_numbers(self, name: str, numbers: np.ndarray, missing: float) -> np.ndarray:
        unique, back = np.unique(numbers, return_inverse=True)
        return self.of_words(name, unique, missing)[back]

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Of each bigram's word after the word before it."""
        a = self.about
        before, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lower = self.of_numbers("lower", word, a["left"] / (a["size"] + 1))
        total, mass = self.of_numbers("total", before, 0), self.of_numbers("mass", before, 0)
        start = before == int(START)
        total[start], mass[start] = a["start"]
        return _interpolated(self.find(self.bigrams, keys, keys, "times")[0], total, mass, a["d"], lower)

    def probability3(self, hashes: np.ndarray, pairs: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each trigram's word after the two before it; ``hashes`` are sorted."""
        pair, back = np.unique(pairs, return_inverse=True)
        lower = self.probability(pair)[back]
        context, back = np.unique((before << np.uint64(32)) | (pairs >> np.uint64(32)), return_inverse=True)
        total, *follow = self.find(self.bigrams, context, context, *_COLUMNS[1:])
        mass = sum(d * n for d, n in zip(self.about["d3"], follow, strict=True))
        return _interpolated(self.find(self.trigrams, hashes, pairs, "often")[0], total[back], mass[back], self.about["d3"], lower)

    def score(self, raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        tokens, bounds = _tokens(raw, off)
        numbers = self.vocabulary.numbers(tokens)
        keys = _bigram_keys(numbers, bounds)
        if self.about["order"] == 3:
            before = _words_before(keys, bounds)
            hashes, first, back = np.unique(_trigram_hash(keys, before), return_index=True, return_inverse=True)
            found = self.probability3(hashes, keys[first], before[first])
        else:
            keys, back = np.unique(keys, return_inverse=True)
            found = self.probability(keys)
        unique, at = np.unique(numbers, return_inverse=True)
        base = np.log10((self.of_words("count", unique, 0) + 1) / (self.about["tokens"] + self.about["size"] + 1))
        sums = lambda x: np.add.reduceat(x, bounds[:-1])
        return {"n_tokens": np.diff(bounds), "n_known": sums((numbers >= 0).astype(np.int64)), "base_score": sums(base[at]), "score": sums(np.log10(found)[back])}


def train(texts: DataFrame, path: str | None = None, order: int = 3) -> dict:
    """Counts the ``text`` column of ``texts`` (null: empty) and writes the model of ``order`` 2 or 3.

    Returns what Model needs to map it. Each row counts, repeated ones as often as they are there. Empty table: a model
    of no text. Other columns are ignored.
    """
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    spark = texts.sparkSession
    folder = path or new_path(spark, "ngrams")
    data = texts.select(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    words = written(data.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    size, tokens = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    if size >= int(UNKNOWN):
        raise OverflowError("the vocabulary has more words than 32 bits number")
    bits = _bits(size)
    file = F.shiftrightunsigned("h", 64 - bits).cast("int")
    dealt = words.select(file.alias("file"), "h", "c").repartitionById(2**bits, F.col("file")).sortWithinPartitions("file", "h")
    made = {r["file"]: r["n"] for r in dealt.mapInArrow(_save_vocabulary(folder), "file int, n long").collect()}
    sizes = [made.get(i, 0) for i in range(2**bits)]
    base = [0, *np.cumsum(sizes).tolist()]
    mapped = _shared(spark, folder) if tokens else ""

    pair_bits = _bits(tokens)
    often = words.filter(F.col("c") > max(1000, tokens // (4 * 2**pair_bits))).select("h").toArrow()["h"]  # 4 * 2 ** pair_bits rows at most
    known = np.sort(np.asarray(often, dtype=np.int64).view(np.uint64)) if len(often) else np.zeros(0, np.uint64)
    hot = Vocabulary(mapped, sizes).find(known) if len(known) else np.zeros(0, np.int64)
    hot = np.sort(np.append(hot.astype(np.uint64), START))
    by_file = lambda blobs: blobs.repartitionById(2**pair_bits, F.col("file")).sortWithinPartitions("file")
    if order == 3:
        blobs = by_file(data.mapInArrow(_count_trigrams(mapped, sizes, hot, pair_bits), _TRIGRAM_BLOBS))
        blobs = blobs.mapInArrow(_save_trigrams(folder, hot, pair_bits), _PAIR_BLOBS)
    else:
        blobs = data.mapInArrow(_count_pairs(mapped, sizes, hot, pair_bits), _PAIR_BLOBS)
    schema = ", ".join(f"{x} long" for x in _STATS)
    part = written(by_file(blobs).mapInArrow(_save_bigrams(folder, order), schema), "sums")
    sums = written(part.groupBy("id").agg(*[F.sum(x).alias(x) for x in _STATS[1:]]), "stats")
    zero = dict.fromkeys(_STATS, 0)
    rows = {r["id"]: r.asDict() for r in sums.filter(F.col("id").isin(-2, -1, int(START))).collect()}
    whole, start = rows.get(-1, zero), rows.get(int(START), zero)
    top = rows.get(-2, zero)
    d, d3 = (discounts(x["n1"], x["n2"], x["n3"], x["n4"]) for x in (whole, top))
    own = sums.filter((F.col("id") >= 0) & (F.col("id") < size))
    cc = {r["k"]: r["n"] for r in own.filter("cont > 0").groupBy(F.least("cont", F.lit(5)).alias("k")).agg(F.count("*").alias("n")).collect()}
    dc = discounts(*(cc.get(k, 0) for k in (1, 2, 3, 4)))
    types = max(1, whole["cont"])
    left = (dc[0] * cc.get(1, 0) + dc[1] * cc.get(2, 0) + dc[2] * sum(cc.get(k, 0) for k in (3, 4, 5))) / types if tokens else 1.0
    # the first of the files' bounds that is above; one literal, however many files there are
    file = F.array_position(F.transform(F.lit(base[1:]), lambda end: F.col("id") < end), True).cast("int") - 1
    dense = own.select(file.alias("file"), *_STATS).repartitionById(2**bits, F.col("file")).sortWithinPartitions("file", "id")
    done = {r["file"] for r in dense.mapInArrow(_save_words(folder, base, d, dc, types, left, size), "file int, n long").collect()}
    assert done == {i for i, n in enumerate(sizes) if n}
    return {"folder": mapped, "sizes": sizes, "bits": pair_bits, "hot": hot, "order": order, "d": d, "d3": d3, "left": left, "size": size, "tokens": tokens, "start": (start["total"], d[0] * start["n1"] + d[1] * start["n2"] + d[2] * start["n3"])}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of ``docs`` by a trained model.

    Tokens are the words, A-Z folded, and one end. ``score``: log10 of the text's probability; ``base_score``: by
    counts plus one. Null text: empty, the end alone. Each row counts, whatever its id. A model of no text gives every
    token the probability that is left for unknown words. Other columns are ignored. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = None
        for batch in batches:
            mapped = mapped or held(("ngrams", model["folder"]), lambda: Model(model))
            for at, raw, off in buffers(batch.column(1)):
                got = mapped.score(raw, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(off) - 1), *map(pa.array, got.values())], names=["doc_id", *got])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str = "doc_id", modulus: int = 7, rest: int = 2):
    """Whether the crc32 of the id as text leaves ``rest``; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus == rest


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """score() of all rows by the model of those that are not held_out(), with that flag and the tokens trained on."""
    model = train(docs.filter(~held_out(id_col)).select(F.col(text_col).alias("text")), order=order)
    return score(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
