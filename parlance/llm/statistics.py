"""Counts of whole texts that quality rules and weak labellers use, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.text import COEF, Words, buffers, mix, windows

WINDOW = 5
#: Columns of ``document_statistics``, each a long.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_other", "n_marks", "n_distinct_words", "n_long_words")


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _MARKS, _DIGITS = _set(b"#*$%&|<>"), _set(b"!?"), _set(b"0123456789")
_UPPER, _LOWER = _set(bytes(range(65, 91))), _set(bytes(range(97, 123)))
_OTHER = _set(bytes(range(33, 127))) & ~_DIGITS & ~_UPPER & ~_LOWER & ~_set(b".,;:'\"-()")


def _by_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``mask`` are set between neighbouring ``bounds``."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(text: bytes) -> tuple[int, int]:
    seen, n, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            n += line in seen
            seen.add(line)
    return n, lines


def counts_of(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of the texts in a slice; see document_statistics."""
    words = Words(raw, off, fold=False)
    owner = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), words.counts())
    word_keys = mix(words.hash ^ (owner * COEF[50]))
    first = np.zeros(len(word_keys), bool)
    first[np.unique(word_keys, return_index=True)[1]] = True
    win = windows(words.hash, WINDOW)
    repeat = np.zeros(len(words.hash), bool)
    if len(win):
        own = owner[: len(win)]
        keys = mix(win ^ (own * COEF[51]))
        keys[owner[WINDOW - 1 :] != own] = 0  # such a run is of two texts
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        hit = np.flatnonzero((n[back] > 1) & (keys != 0))
        edge = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        repeat = np.cumsum(edge)[:-1] > 0
    data = raw.tobytes()
    lines = np.array([_dup_lines(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.int64).reshape(-1, 2)
    spaces = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    char = (raw & 0xC0) != 0x80
    return {
        "n_words": words.counts(),
        "word_chars": _by_text(char & ~spaces, off),
        "n_symbols": _by_text(_SYMBOLS[raw], off),
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": _by_text(repeat, words.bounds),
        "n_lines": lines[:, 1],
        "n_upper": _by_text(_UPPER[raw], off),
        "n_letters": _by_text(_UPPER[raw] | _LOWER[raw], off),
        "n_digits": _by_text(_DIGITS[raw], off),
        "n_other": _by_text(_OTHER[raw], off),
        "n_marks": _by_text(_MARKS[raw], off),
        "n_distinct_words": _by_text(first, words.bounds),
        "n_long_words": _by_text(words.length > 20, words.bounds),
    }


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, raw, off in buffers(batch.column(1)):
            counts = counts_of(raw, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(off) - 1), *(pa.array(counts[x], pa.int64()) for x in COUNTS)], names=["doc_id", *COUNTS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS...) of each row of ``docs``, over its whole text.

    Words are runs of anything but space and 0x09-0x0D. ``word_chars``: code points in words; ``n_symbols``: of
    ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an earlier one, of ``n_lines`` with a word;
    ``n_repeat_words``: words in runs of five that the text has twice or more, the first included; ``n_upper``,
    ``n_letters``, ``n_digits``: ASCII; ``n_marks``: of ``!?``; ``n_other``: ASCII marks but ``.,;:'"-()``;
    ``n_long_words``: of over 20 bytes. Null or empty text: all 0. Each row counts, whatever its id. Other columns
    are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(_run, "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS))
