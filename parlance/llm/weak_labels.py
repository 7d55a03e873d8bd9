"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

Labellers vote good, bad or nothing on counts of the whole text. The expectation-maximisation works on the number of
documents with each pattern of votes, which is all that the likelihood needs: 3 to the power of the labellers at
most, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.calibration import calibrated_cut
from parlance.llm.statistics import COUNTS, counts_of, document_statistics
from parlance.llm.storage import written
from parlance.llm.text import Words, buffers

BAD, GOOD, NONE = 0, 1, 2
#: Labellers that vote good or nothing; the others vote bad or nothing.
GOOD_ONLY = ("plain", "varied")
WORD_BITS, CLASSES = 18, 40
_STEPS = 16


def labellers() -> dict[str, Column]:
    """Votes on the columns of document_statistics. Most know one kind of bad text and say nothing else."""
    c = F.col
    rate = lambda x, y: c(x) / F.greatest(c(y), F.lit(1))
    symbols, other, marks = rate("n_symbols", "word_chars"), rate("n_other", "word_chars"), rate("n_marks", "n_words")
    upper, repeats, lines = rate("n_upper", "n_letters"), rate("n_repeat_words", "n_words"), rate("n_dup_lines", "n_lines")
    variety, length = rate("n_distinct_words", "n_words"), rate("word_chars", "n_words")
    bad = lambda x: F.when(x, BAD).otherwise(NONE)
    good = lambda x: F.when(x, GOOD).otherwise(NONE)
    return {
        "symbols": bad(symbols > 0.03),
        "other_marks": bad(other > 0.03),
        "shouting": bad((c("n_letters") >= 20) & (upper > 0.3)),
        "marks": bad(marks > 0.2),
        "repeats": bad(repeats > 0.2),
        "lines": bad((c("n_lines") > 2) & (lines > 0.3)),
        "variety": bad((c("n_words") >= 12) & (variety < 0.3)),
        "word_length": bad((length > 14) | (length < 2) | (rate("n_long_words", "n_words") > 0.1)),
        "plain": good((symbols < 0.005) & (other < 0.005) & (marks < 0.05) & (upper < 0.15)),
        "varied": good((repeats < 0.05) & (lines < 0.05) & (variety > 0.4)),
    }


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, one_sided: np.ndarray, rounds: int = 200, prior_docs: float = 50.0) -> tuple[np.ndarray, float]:
    """(P(vote | class) as array (labeller, class, vote), share of good), by expectation-maximisation.

    ``patterns``: votes (pattern, labeller); ``counts``: documents with each; ``one_sided``: the vote that a labeller
    can cast, BAD or GOOD. Votes are independent given the class. How often a labeller speaks up in either class is
    estimated from all documents and a prior that counts as ``prior_docs`` of each class, however many there are: one
    that knows bad text seldom speaks up in good text, and one that knows good text more often there. The estimation
    starts from it, which keeps the classes from changing places; with many documents nothing else of it is left.
    """
    n = counts.sum()
    prior = np.zeros((patterns.shape[1], 2, 3))
    for j, vote in enumerate(one_sided):
        speaks = {BAD: (0.3, 0.005), GOOD: (0.3, 0.9)}[int(vote)]
        for k in (BAD, GOOD):
            prior[j, k, vote], prior[j, k, NONE] = speaks[k], 1 - speaks[k]
    theta, share = prior, 0.85
    votes = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-np.clip(_log_odds(theta, share, patterns), -50, 50)))
        new = np.empty_like(theta)
        for k, mass in ((GOOD, counts * post), (BAD, counts * (1 - post))):
            new[:, k] = (np.einsum("p,pjv->jv", mass, votes) + prior_docs * prior[:, k]) / (mass.sum() + prior_docs)
        share = float(np.clip((counts * post).sum() / n, 0.01, 0.99))
        if np.abs(new - theta).max() < 1e-9:
            break
        theta = new
    return theta, share


def _ratio(theta: np.ndarray) -> np.ndarray:
    """Log of P(vote | good) over P(vote | bad), 0 for a vote that is never cast."""
    cast = theta.min(axis=1) > 0
    return np.where(cast, np.log(np.where(cast, theta[:, GOOD], 1)) - np.log(np.where(cast, theta[:, BAD], 1)), 0)


def _log_odds(theta: np.ndarray, share: float, patterns: np.ndarray) -> np.ndarray:
    return np.log(share / (1 - share)) + _ratio(theta)[np.arange(patterns.shape[1]), patterns].sum(axis=1)


def posterior(theta: np.ndarray, share: float) -> Column:
    """Probability of good, from the votes of labellers()."""
    total = F.lit(float(np.log(share / (1 - share))))
    for vote, ratio in zip(labellers().values(), _ratio(theta).tolist(), strict=True):
        total = total + F.when(vote == GOOD, ratio[GOOD]).when(vote == BAD, ratio[BAD]).otherwise(ratio[NONE])
    return 1 / (1 + F.exp(-F.least(F.lit(50.0), F.greatest(F.lit(-50.0), total))))


def _class_table() -> np.ndarray:
    table = np.full(256, 5, np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for i, b in enumerate(marks):
        table[b] = 6 + i
    table[[i for i in range(33)]] = 0
    table[10] = 1
    table[97:123], table[65:91], table[48:58] = 2, 3, 4
    return table


_CLASS = _class_table()
_TRIGRAMS = CLASSES**3
_WIDTH = _TRIGRAMS + (1 << WORD_BITS) + 16 * _STEPS


_COUNTED = ", ".join(f"{x} long" for x in COUNTS)


def _count_arrays(counts: dict[str, np.ndarray]) -> list[pa.Array]:
    return [pa.array(counts[x], pa.int64()) for x in COUNTS]


def _parts(raw: np.ndarray, off: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[str, np.ndarray]]:
    """Three groups of hashed features of a slice, (feature of each occurrence, bounds by text), and its counts."""
    c = np.minimum(_CLASS[raw], CLASSES - 1)
    tri = np.zeros(len(c), np.int64)
    tri[:-2] = c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:] if len(c) > 2 else 0
    for back in (1, 2):  # these would reach into the next text
        last = off[1:] - back
        tri[last[last >= off[:-1]]] = 0
    words = Words(raw, off)
    word = (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64) + _TRIGRAMS
    k = counts_of(raw, off)
    rates = [("n_symbols", "word_chars"), ("n_upper", "n_letters"), ("n_marks", "word_chars"), ("n_other", "word_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_distinct_words", "n_words"), ("n_digits", "word_chars")]
    steps = np.stack([np.minimum(_STEPS - 1, np.sqrt(np.minimum(1, k[a] / np.maximum(k[b], 1))) * _STEPS).astype(np.int64) + i * _STEPS for i, (a, b) in enumerate(rates)], axis=1)
    steps += _TRIGRAMS + (1 << WORD_BITS)
    return [(tri, off), (word, words.bounds), (steps.ravel(), np.arange(len(off)) * len(rates))], k


def _sum_scores(weights: np.ndarray, bias: float, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    total = np.full(len(off) - 1, bias)
    parts, counts = _parts(raw, off)
    for (index, bounds), scale in zip(parts, _SCALES, strict=True):
        sums = np.concatenate([[0.0], np.cumsum(weights[index], dtype=float)])
        total += scale * (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
    return 1 / (1 + np.exp(-np.clip(total, -50, 50))), counts


_SCALES = (20.0, 5.0, 8.0)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, text) -> (h, features, values, COUNTS)."""
    for batch in batches:
        for at, raw, off in buffers(batch.column(1)):
            parts, counts = _parts(raw, off)
            index, value = [], []
            for i in range(len(off) - 1):
                found = []
                for (ids, bounds), scale in zip(parts, _SCALES, strict=True):
                    x, n = np.unique(ids[bounds[i] : bounds[i + 1]], return_counts=True)
                    found.append((x, scale * n / max(n.sum(), 1)))
                index.append(np.concatenate([x for x, _ in found]).astype(np.int32))
                value.append(np.concatenate([x for _, x in found]).astype(np.float32))
            hashes = batch.column(0).slice(at, len(index))
            yield pa.RecordBatch.from_arrays([hashes, pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), *_count_arrays(counts)], names=["h", "index", "value", *COUNTS])


def train_linear(target: np.ndarray, index: list[np.ndarray], value: list[np.ndarray], rounds: int = 120, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer, by Adam on all rows at once; ``target`` in [0, 1]."""
    row = np.repeat(np.arange(len(index)), [len(x) for x in index])
    used, col = np.unique(np.concatenate(index), return_inverse=True)
    val = np.concatenate(value).astype(float)
    w, m, v, bias, mb, vb = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], len(index)) + bias, -50, 50)))
        error = (p - target) / len(target)
        g, gb = np.bincount(col, val * error[row], len(used)) + decay * w / len(target), error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    weights = np.zeros(_WIDTH)
    weights[used] = w
    return weights, float(bias)


class QualityModel:
    """What ``fit`` learns: labellers' accuracies, the share of good, the scorer, and the cut of its score."""

    def __init__(self, theta: np.ndarray, share: float, weights: np.ndarray, bias: float, cut: float = 0.5):
        self.theta, self.share, self.weights, self.bias, self.cut = theta, share, weights.astype(np.float32), bias, cut

    def scores(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(probability of bad, counts) of the texts of a slice."""
        return _sum_scores(self.weights, self.bias, raw, off)


def _scored(rows: DataFrame, model: QualityModel, text: Callable[[pa.RecordBatch], pa.Array], schema: str | T.StructType) -> DataFrame:
    """``rows`` with score and COUNTS of their texts; ``schema`` is of the result's first column, which stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, off in buffers(text(batch)):
                scores, counts = model.scores(raw, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(scores)), pa.array(scores), *_count_arrays(counts)], names=[batch.schema.names[0], "score", *COUNTS])

    return rows.mapInArrow(run, schema)


def _last_hash(drawn: DataFrame, features: int) -> int:
    """The hash in ``drawn`` (h, index) at which rows in its order reach so many features; the last one if they don't."""
    rows = drawn.select("h", F.size("index").cast("long").alias("n")).toArrow().sort_by("h")  # of a sample's rows, 16 bytes each
    if not len(rows):
        return 0
    enough = np.searchsorted(np.cumsum(np.asarray(rows["n"])), features)
    return rows["h"][int(min(enough, len(rows) - 1))].as_py()


def fit(docs: DataFrame, labels: DataFrame | None, keep: float = 0.998, sample_rows: int = 4_000, sample_features: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", whole: bool = False) -> tuple[QualityModel, DataFrame] | None:
    """(the model of ``docs``, scores of all of them, written); see quality_scores.

    The labellers' model is of all documents. The scorer is trained on a sample with its posteriors: different
    documents whose hash is under that bound which about ``sample_rows`` of all rows are under; of any length, up to
    that in order of hash with which they have ``sample_features`` features, so what the driver fits has a bound
    (8 bytes for each, and some 300,000 for the last document). The cut is of all labelled rows, 0.5 without labels. The scores have the id, or
    with ``whole`` a struct ``doc`` of all columns of the row. Texts are scored once and never shuffled. Empty table:
    nothing.
    """
    votes = labellers()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = document_statistics(docs, id_col, text_col).select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count().toArrow()  # 3 ** 10 rows at most
    if not len(found):
        return None
    patterns, times = np.stack([np.asarray(found[k]) for k in votes], axis=1), np.asarray(found["count"], dtype=float)
    theta, share = fit_labellers(patterns, times, np.array([GOOD if k in GOOD_ONLY else BAD for k in votes]))
    h = F.xxhash64("doc_id", "text", F.lit(10))
    bound = -(2**63) + int(2**64 * min(1.0, sample_rows / times.sum()))
    drawn = texts.select(h.alias("h"), "text").filter(F.col("h") < F.lit(min(bound, 2**63 - 1)))
    drawn = drawn.mapInArrow(_hashed, f"h long, index array<int>, value array<float>, {_COUNTED}")
    drawn = written(drawn.select("h", "index", "value", (1 - posterior(theta, share)).alias("target")).dropDuplicates(["h"]), "drawn")
    rows = drawn.filter(F.col("h") <= _last_hash(drawn, sample_features)).toArrow().sort_by("h")
    weights, bias = np.zeros(_WIDTH), 0.0
    if len(rows):
        weights, bias = train_linear(np.asarray(rows["target"]), [np.asarray(x.values) for x in rows["index"]], [np.asarray(x.values) for x in rows["value"]])
    model = QualityModel(theta, share, weights, bias)
    if whole:
        place = docs.columns.index(text_col)
        first = T.StructType([T.StructField("doc", docs.schema)])
        schema = T.StructType([*first.fields, T.StructField("score", T.DoubleType()), *(T.StructField(x, T.LongType()) for x in COUNTS)])
        scored = _scored(docs.select(F.struct(*docs.columns).alias("doc")), model, lambda batch: batch.column(0).field(place), schema)
        scored = written(scored.select("doc", "score"), "scored")
        named = scored.select(F.col(f"doc.{id_col}").alias("doc_id"), "score")
    else:
        scored = written(_scored(texts, model, lambda batch: batch.column(1), f"doc_id long, score double, {_COUNTED}"), "scored")
        named = scored.select("doc_id", "score")
    if labels is not None:
        model.cut = calibrated_cut(named, labels, keep, 0.5, id_col, label_col)
    return model, scored


def quality_scores(docs: DataFrame, labels: DataFrame | None, keep: float = 0.998, sample_rows: int = 4_000, sample_features: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, weak_good, score, kept) of each row of ``docs``.

    ``weak_good``: the weak-label model's probability of good; ``score``: the scorer's of bad, which is trained on
    about ``sample_rows`` documents (see fit); ``kept``: a score up to the cut, with ``keep`` of the labelled good rows
    (see calibrated_cut). Null or empty text: scored by what it lacks. Null id: scored, never labelled. Each row
    counts, whatever its id. Other columns are ignored. Empty table: no rows.
    """
    found = fit(docs, labels, keep, sample_rows, sample_features, id_col, text_col, label_col)
    if found is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0.5).alias("weak_good"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    model, scored = found
    return scored.select("doc_id", posterior(model.theta, model.share).alias("weak_good"), "score", (F.col("score") <= model.cut).alias("kept"))


def drop_low_quality(docs: DataFrame, labels: DataFrame | None, keep: float = 0.998, sample_rows: int = 4_000, sample_features: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` without the rows that the model fitted on them rejects; all columns stay, whatever their names.

    Rows are written once with their scores, and read again up to the cut. See quality_scores.
    """
    found = fit(docs, labels, keep, sample_rows, sample_features, id_col, text_col, label_col, whole=True)
    return docs if found is None else found[1].filter(F.col("score") <= found[0].cut).select("doc.*")
