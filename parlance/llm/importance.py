"""Importance resampling towards a target distribution of hashed n-grams.

Documents are scored by arrays: features are runs of words, each counted in a bucket by its CRC-32, and a document's
weight is the sum of its features' gains. CRC-32 is linear over bits, so that of a run follows from those of its words,
for a whole slice of texts at once. The draw takes the highest scores after Gumbel noise: a quantile sketch brackets
the cutoff, exact counts outside show whether the bracket holds it, and only the bracket is sorted to find it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.storage import written
from parlance.llm.text import buffers

#: Entries of the count arrays; so many rows, of two longs each, come to the driver.
BUCKETS = 10_000
#: Rows of a range when drawn rows are numbered, about.
RANGE_ROWS = 20_000
#: Accuracy of the sketch (its error of rank is 1 / ACCURACY of the rows) and the first half-width of the bracket.
ACCURACY, HALF_WIDTH = 10_000, 0.002

#: Bytes of words, after A-Z are folded: digits, letters, and all of code points above ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
#: Words of up to so many bytes go by columns of bytes, longer ones each by the library.
_COLUMNS = 64


def _byte_table() -> np.ndarray:
    """CRC-32 by bytes, from its polynomial, bits reflected."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _zeros_tables(table: np.ndarray) -> np.ndarray:
    """[n, k, b]: what byte b at place k of a register becomes after n zero bytes."""
    t = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [t]
    for _ in range(_COLUMNS):
        t = table[t & 255] ^ (t >> 8)
        out.append(t)
    return np.stack(out)


_TABLE = _byte_table()
_ZEROS = _zeros_tables(_TABLE)
_SPACE = np.uint32(zlib.crc32(b" "))


def _after(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved past ``n`` further bytes: crc(a + b) == _after(crc(a), len(b)) ^ crc(b)."""
    crc, n = crc.copy(), n.copy()
    far = np.flatnonzero(n > _COLUMNS)
    while len(far):
        crc[far] = _step(crc[far], np.full(len(far), _COLUMNS))
        n[far] -= _COLUMNS
        far = far[n[far] > _COLUMNS]
    return _step(crc, n)


def _step(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _ZEROS[n, 0, crc & 255] ^ _ZEROS[n, 1, (crc >> 8) & 255] ^ _ZEROS[n, 2, (crc >> 16) & 255] ^ _ZEROS[n, 3, crc >> 24]


def word_crcs(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, byte column by byte column over the words that are so long."""
    order = np.argsort(-length, kind="stable")
    at, sizes = start[order], length[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    ends = np.searchsorted(-sizes, -np.arange(_COLUMNS), "left")  # words longer than each column's number
    for j in range(min(_COLUMNS, int(sizes[0]) if len(sizes) else 0)):
        k = ends[j]
        crc[:k] = _TABLE[(crc[:k] ^ raw[at[:k] + j]) & 255] ^ (crc[:k] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > _COLUMNS):
        crc[i] = zlib.crc32(raw[at[i] : at[i] + sizes[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


class Features:
    """Words of a slice of texts, folded, and the buckets of their runs: ``bounds`` are of each text's words."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        raw = _FOLD[raw]
        inside = _WORD[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        first[inner] = inside[inner]
        last[inner - 1] = inside[inner - 1]
        start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - start
        self.bounds = np.searchsorted(start, off)
        self.crc = word_crcs(raw, start, self.length)
        self.owner = np.repeat(np.arange(len(off) - 1), np.diff(self.bounds))

    def runs(self, widths: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each width (numbers of the first words, buckets) of the runs within one text."""
        spaced = _after(np.full(len(self.crc), _SPACE), self.length) ^ self.crc  # of a blank and the word
        at, crc = np.arange(len(self.crc)), self.crc
        for w in range(widths):
            if w:
                keep = np.flatnonzero(self.owner[np.minimum(at + w, len(self.owner) - 1)] == self.owner[at]) if len(at) else at
                keep = keep[at[keep] + w < len(self.owner)]
                at = at[keep]
                crc = _after(crc[keep], self.length[at + w] + 1) ^ spaced[at + w]
            yield at, (crc % np.uint32(buckets)).astype(np.int64)


def _counts(widths: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw, off in buffers(batch.column(0)):
                for _, bucket in Features(raw, off).runs(widths, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", widths: int = 3, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``texts`` by bucket; each task sends one array of ``buckets`` counts. Null and empty texts have none."""
    rows = texts.select(F.col(text_col).cast("binary")).mapInArrow(_counts(widths, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed ratio of shares) for each bucket, from counts of the target and of all texts."""
    t_all, s_all, m = float(target.sum()), float(raw.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m)))) for t, s in zip(target.tolist(), raw.tolist(), strict=True)], np.int64)


def _weights(gain: np.ndarray, widths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, off in buffers(batch.column(1)):
                found = Features(raw, off)
                sums, n = np.zeros(len(found.crc), np.int64), np.zeros(len(found.crc), np.int64)
                for first, bucket in found.runs(widths, len(gain)):
                    sums[first] += gain[bucket]
                    n[first] += 1
                by_text = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[found.bounds]), pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(off) - 1), pa.array(np.diff(found.bounds), pa.int64()), by_text(n), by_text(sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def importance_weights(docs: DataFrame, gain: np.ndarray, widths: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs``: the sum of its features' gains, 0 without features."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(_weights(gain, widths), "doc_id long, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int) -> Column:
    """floor(1000 times Gumbel noise) that the seed and the id decide; a null id is as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``rows``, about ``n``, with ``rank`` from 1 in ``order``: ranges in order, sums of their counts, numbers within each."""
    dealt = rows.repartitionByRange(max(1, math.ceil(n / RANGE_ROWS)), *order).sortWithinPartitions(*order)
    stored = written(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return stored.withColumn("own", own).join(parts, "part").withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def bracket(scores: DataFrame, score: str, n: int, k: int, half_width: float = HALF_WIDTH, accuracy: int = ACCURACY) -> tuple[int | None, int | None, int, int]:
    """(low, high, above, within) about the k-th highest of ``n`` scores, 1 <= k <= n: None is unbounded; above < k <= above + within.

    Both ends come from a quantile sketch; exact counts above and within show whether the k-th is between them, and the
    end that it is beyond is moved out, four times as far each time.
    """
    up = down = half_width
    while True:
        shares = [max(0.0, 1 - k / n - down), min(1.0, 1 - k / n + up)]
        low, high = scores.agg(F.percentile_approx(score, shares, accuracy)).first()[0]
        low, high = low if shares[0] > 0 else None, high if shares[1] < 1 else None
        over = F.lit(False) if high is None else F.col(score) > high
        under = F.lit(False) if low is None else F.col(score) < low
        above, below = scores.agg(F.count_if(over), F.count_if(under)).first()
        if above < k <= n - below:
            return low, high, above, n - below - above
        if above >= k:
            up *= 4
        else:
            down *= 4


def draw_highest(scored: DataFrame, share: tuple[int, int], eligible: Column, id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """``scored``, a stored table, with ``rank``: of its N eligible rows the floor(share * N) of the highest score have 1, 2, 3...

    Ties go to the smaller id, null last, and of rows equal in both to the one stored first. Rows that are not drawn
    have a null rank. Scores are whole numbers, not null.
    """
    rows = scored.withColumn("_place", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")))
    key = [(-F.col(score)).alias("a"), F.col(id_col).isNull().alias("b"), F.coalesce(F.col(id_col), F.lit(0)).alias("c"), F.col("_place").alias("d")]
    rows = rows.select(*scored.columns, F.struct(*key).alias("_key"))
    can = rows.filter(eligible)
    n = can.count()
    k = share[0] * n // share[1]
    none = F.lit(None).cast("long")
    if not k:
        return scored.withColumn("rank", none)
    low, high, above, within = bracket(can, score, n, k)
    held = can.filter(F.lit(True) if low is None else F.col(score) >= low).filter(F.lit(True) if high is None else F.col(score) <= high)
    cut = numbered(held.select("_key"), [F.col("_key")], within).filter(F.col("rank") == k - above).first()["_key"]
    last = F.struct(F.lit(cut["a"]).alias("a"), F.lit(cut["b"]).alias("b"), F.lit(cut["c"]).alias("c"), F.struct(F.lit(cut["d"]["file"]).alias("file"), F.lit(cut["d"]["row"]).alias("row")).alias("d"))
    drawn = eligible & (F.col("_key") <= last)
    ranked = numbered(rows.filter(drawn), [F.col("_key")], k)
    return ranked.select(*scored.columns, "rank").union(rows.filter(~drawn).select(*scored.columns, none.alias("rank")))


def importance_resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42, widths: int = 3, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs``, resampled towards ``target``.

    Words are runs of digits, letters and code points above ASCII, A-Z folded; features are runs of 1 to ``widths``
    words joined by one space, repeats counted. ``weight`` sums floor(1000 log ratio) of the features' buckets between
    the two texts' counts plus one; ``score`` adds Gumbel noise of ``seed`` and the id, so the highest ``share`` of the
    rows with ``least_words`` is a draw without replacement by weight. ``rank`` as in draw_highest.

    Null or empty text: no features, weight 0. Null id: noise as of an empty id. Repeated ids: each row stands for
    itself, with the same noise. Empty ``docs``: no rows; empty ``target``: gains from its counts of 0. Other columns
    are ignored.
    """
    gain = gains(bucket_counts(target, target_text_col, widths, buckets), bucket_counts(docs, text_col, widths, buckets))
    weighed = importance_weights(docs, gain, widths, id_col, text_col)
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scored")
    return draw_highest(scored, share, F.col("n_words") >= least_words)


def drawn_documents(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with all their columns whose id importance_resample drew; rows of one id go together, a null id as any."""
    ids = ranked.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
