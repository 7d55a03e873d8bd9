"""Encoding many texts by a public tokenizer file, piece by piece with a bounded memory of pieces.

The tokenizers split a text by a pattern before they merge, and never merge across a split. A cut that is always a
split leaves the ids as they are, so a piece met before need not be encoded again. Cuts are found on the bytes of
many texts at once, equal pieces of a slice are one by Arrow's dictionary encoding, and only a slice's different
pieces are looked up one by one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

#: Pieces that a Python worker keeps (some 200 MB), in two generations: what the last half did not meet is forgotten.
KEPT = 800_000
#: Texts are cut in slices of about so many bytes: the more, the fewer different pieces for each word.
SLICE_BYTES = 4 << 20


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a worker has learnt stays for its later tasks.
_held: dict = {}


def held(key: tuple, make: Callable):
    """``make()``, made once in a Python worker for each ``key``."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _flags(chars: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = _flags(b" \t\n\r")
#: White space, and control characters that some libraries count as such.
_GAP = _SPACE | _flags([0x0B, 0x0C, *range(0x1C, 0x20)])
_LEAD = _flags([0xC2, 0xE1, 0xE2, 0xE3])
#: The other characters of the Unicode property White_Space.
_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)], np.int64)
_MARK = _flags(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_ALNUM = _flags(c for c in range(0x7F) if chr(c).isalnum())


def _gaps(raw: np.ndarray) -> np.ndarray:
    """Bytes that are white space, or may be."""
    gap = _GAP[raw]
    lead = np.flatnonzero(_LEAD[raw])
    wide = raw.astype(np.int64) if len(lead) else raw
    two = lead[lead + 1 < len(raw)]
    two = two[(wide[two] == 0xC2) & ((wide[two + 1] == 0x85) | (wide[two + 1] == 0xA0))]
    three = lead[lead + 2 < len(raw)]
    three = three[np.isin(wide[three] << 16 | wide[three + 1] << 8 | wide[three + 2], _WIDE)]
    for i, at in ((0, two), (1, two), (0, three), (1, three), (2, three)):
        gap[at + i] = True
    return gap


def cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted starts of the pieces of a slice's texts (offsets ``off``); an empty text has none.

    A piece begins with each text; where white space follows another character; after a line end between two others;
    and at an ASCII mark after a letter or digit of Latin-1, but for texts that may hold an added token, ``<|...|>``.
    At each such place both patterns split, whatever follows; neither looks back, or more than one character ahead.
    """
    n = len(raw)
    at = np.zeros(n + 1, bool)
    if n:
        gap, nl = _gaps(raw), np.flatnonzero(raw == 10)
        wordy = _ALNUM[raw]
        latin = np.flatnonzero(raw[:-1] == 0xC3) + 1  # U+00C0 to U+00FF, all letters but two
        wordy[latin[(raw[latin] != 0x97) & (raw[latin] != 0xB7)]] = True
        at[1:n] = _MARK[raw[1:]] & wordy[:-1]
        pipe = np.flatnonzero(raw == ord("|"))
        near = pipe[((pipe > 0) & (raw[np.maximum(pipe - 1, 0)] == ord("<"))) | ((pipe + 1 < n) & (raw[np.minimum(pipe + 1, n - 1)] == ord(">")))]
        for i in np.unique(np.searchsorted(off, near, "right") - 1):
            at[off[i] : off[i + 1]] = False
        at[1:n] |= _SPACE[raw[1:]] & ~gap[:-1]
        lone = nl[(nl > 0) & (nl + 1 < n)]
        at[lone[~gap[lone - 1] & ~gap[lone + 1]] + 1] = True
    at[off[:-1]] = True
    at[n] = False
    return np.flatnonzero(at)


def can_cut(tokenizer) -> bool:
    """Whether ``cuts`` fits: the byte-level pattern, or one that takes letters, digits and marks apart, and no other added tokens."""
    about = json.loads(tokenizer.to_str())
    kinds = json.dumps(about["pre_tokenizer"])
    known = '"use_regex": true' in kinds and '"add_prefix_space": true' not in kinds or r"[^\\s\\p{L}\\p{N}]+" in kinds
    plain = all(x["content"].startswith("<|") and x["content"].endswith("|>") and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in about["added_tokens"])
    return known and plain


class Pieces:
    """What ``make`` gives for the ids of each piece; a piece is encoded only if it was not met lately."""

    def __init__(self, tokenizer, make: Callable):
        self.tokenizer, self.make, self.cut = tokenizer, make, can_cut(tokenizer)
        self.known: dict = {}
        self.before: dict = {}

    def learn(self, parts: set[str]) -> None:
        """Call once for a batch of texts, with all their pieces."""
        if len(self.known) > KEPT // 2:
            self.before, self.known = self.known, {}
        new = parts.difference(self.known)
        again = [x for x in new if x in self.before]
        self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
        new = list(new.difference(again))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, [self.make(x.ids) for x in encoded], strict=True))

    def of(self, parts: Iterable[str]):
        """In order, for pieces of the last ``learn``."""
        return map(self.known.__getitem__, parts)

    def of_slice(self, raw: np.ndarray, off: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """(what ``make`` gave for the slice's different pieces, the place there of each piece, each text's bounds among these)."""
        starts = cuts(raw, off) if self.cut else np.unique(off[:-1][np.diff(off) > 0])
        ends = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(raw)]).dictionary_encode()
        try:
            parts = coded.dictionary.cast(pa.string()).to_pylist()
        except pa.ArrowInvalid:
            parts = [x.decode("utf-8", "replace") for x in coded.dictionary.to_pylist()]
        self.learn(set(parts))
        return list(self.of(parts)), np.asarray(coded.indices), np.searchsorted(starts, off)
