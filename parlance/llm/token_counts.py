"""Token counts; a huge document by overlapping chunks that are spliced where both prove to agree.

Chunks are encoded with offsets. Two neighbours are spliced at a white-space position of their overlap that starts a
token in neither's middle, with the same tokens at the same places for a run on either side. The tokenizer never
merges across white space, so such a cut is one of the whole text too, and what each side holds there is final. Where
an overlap has no such place, it is widened; in the end it is the rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.text import buffers
from parlance.llm.tokenizing import SLICE_BYTES, Pieces, held, load

CHUNK_CHARS, OVERLAP_CHARS, AGREE = 32_768, 256, 3


class _Chunk:
    def __init__(self, tokenizer, text: str, start: int, end: int):
        self.start, self.end = start, end
        self.made = tokenizer.encode(text[start:end], add_special_tokens=False)

    def at(self, position: int) -> int | None:
        """The token that holds the character at ``position``."""
        return self.made.char_to_token(position - self.start)

    def run(self, ids: list[int], first: int, last: int) -> list[tuple[int, int, int]]:
        """(start, end, id) of tokens ``first`` to ``last`` - 1, with offsets in the whole text."""
        places = map(self.made.token_to_chars, range(max(first, 0), min(last, len(ids))))
        return [(a + self.start, b + self.start, ids[i]) for i, (a, b) in enumerate(places, max(first, 0))]


def _seam(text: str, left: _Chunk, right: _Chunk, low: int, high: int) -> tuple[int, int] | None:
    """(tokens of left, tokens of right) before a stable common boundary in [low, high)."""
    middle, left_ids, right_ids = (low + high) // 2, left.made.ids, right.made.ids
    for at in sorted((i for i in range(low + 1, high - 1) if text[i] in " \n"), key=lambda i: abs(i - middle)):
        a, b = left.at(at + 1), right.at(at + 1)
        if a is None or b is None:  # more white space follows, say
            continue
        before = left.run(left_ids, a - AGREE, a)
        after = left.run(left_ids, a, a + AGREE)
        if min(len(before), len(after)) < AGREE or before[0][0] < low or before[-1][1] > at or after[0][0] <= at or after[-1][1] > high:
            continue
        if before == right.run(right_ids, b - AGREE, b) and after == right.run(right_ids, b, b + AGREE):
            return a, b
    return None


def count_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Number of tokens of ``text``, encoded by chunks of ``chunk`` characters and more."""
    total, start, from_ = 0, 0, 0
    end = min(len(text), chunk + overlap)
    left = _Chunk(tokenizer, text, start, end)
    while left.end < len(text):
        wide = overlap
        while True:
            low = max(start, left.end - wide)
            right = _Chunk(tokenizer, text, low, min(len(text), low + wide + chunk))
            if found := _seam(text, left, right, low, left.end):
                break
            if low == start:  # no place to splice in all of the chunk: take it and what follows as one
                right, found = _Chunk(tokenizer, text, start, min(len(text), left.end + 2 * (left.end - start))), (from_, from_)
                break
            wide *= 2
        a, b = found
        total += a - from_
        left, start, from_ = right, max(low, 0), b
    return total + len(left.made) - from_


def _decoded(raw: np.ndarray, off: np.ndarray, i: int) -> str:
    return raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")


def _without(raw: np.ndarray, off: np.ndarray, gone: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The slice with texts ``gone`` emptied."""
    if not gone:
        return raw, off
    sizes, stays = np.diff(off), np.ones(len(raw), bool)
    for i in gone:
        stays[off[i] : off[i + 1]], sizes[i] = False, 0
    return raw[stays], np.concatenate([[0], np.cumsum(sizes)])


def _count(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pieces = held(("counts", path), lambda: (t := load(path), Pieces(t, len)))
        for batch in batches:
            for at, raw, off in buffers(batch.column(1), SLICE_BYTES):
                long = {i: _decoded(raw, off, i) for i in np.flatnonzero(np.diff(off) > chunk + overlap)}
                huge = {i: x for i, x in long.items() if len(x) > chunk + overlap}
                found, place, bounds = pieces.of_slice(*_without(raw, off, list(huge)))
                sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64)[place])])
                counts = sums[bounds[1:]] - sums[bounds[:-1]]
                for i, text in huge.items():
                    counts[i] = count_huge(tokenizer, text, chunk, overlap)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), pa.array(np.diff(off)), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``, as the whole text's encoding would count.

    For tokenizers that drop white space. A text of more than ``chunk_chars`` + ``overlap_chars`` characters goes by
    chunks. Null text: as empty, no tokens. Null and repeated ids: each row is counted. Empty table: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    counted = texts.mapInArrow(_count(tokenizer_path, chunk_chars, overlap_chars), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
