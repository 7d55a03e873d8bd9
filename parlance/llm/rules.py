"""Quality rules: fixed rules and an isolation forest on the rules' statistics, cut where labelled rows say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.calibration import calibrated_cut
from parlance.llm.statistics import COUNTS, document_statistics
from parlance.llm.storage import written

#: The forest is grown on so many labelled good rows at most, the ones of the least hash.
SAMPLE_ROWS = 20_000
TREES, TREE_ROWS = 128, 256


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics as rates, so that a long text is not odd for its length."""
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_letters"], 1)
    return np.stack(
        [
            np.log1p(200 * c["n_symbols"] / chars),
            np.log1p(50 * c["n_upper"] / letters),
            np.log1p(200 * c["n_marks"] / chars),
            np.log1p(200 * c["n_other"] / chars),
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            np.log(chars / words),
            np.log1p(100 * c["n_digits"] / chars),
        ],
        axis=1,
    )


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree over ``n`` rows: 2 H(n - 1) - 2 (n - 1) / n."""
    return 2 * float((1 / np.arange(1, n)).sum()) - 2 * (n - 1) / n if n > 1 else 0.0


def grow(sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 3) -> dict[str, np.ndarray]:
    """An isolation forest: arrays (tree, node) of the split feature (-1: leaf), its cut, and a leaf's path length.

    A node draws one of all features, and a cut between the ends of the feature's range in the node, each moved out by
    one standard deviation that the feature has in the whole sample: so values outside of what the sample holds part
    from it early. A leaf's path length is its depth and the expected path of a search tree over its rows; a leaf
    without rows, which only such values reach, counts as one level less.
    """
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(min(rows, len(sample)), 2))))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    spread = np.maximum(sample.std(axis=0), 1e-3)
    for t in range(trees):
        stack = [(0, sample[rng.choice(len(sample), min(rows, len(sample)), replace=False)], 0)]
        while stack:
            node, x, at = stack.pop()
            if at < depth and len(x) > 1:
                f = rng.integers(x.shape[1])
                low, high = x[:, f].min() - spread[f], x[:, f].max() + spread[f]
                feature[t, node], cut[t, node] = f, rng.uniform(low, high)
                left = x[:, f] < cut[t, node]
                stack += [(2 * node + 1, x[left], at + 1), (2 * node + 2, x[~left], at + 1)]
            else:
                length[t, node] = at + expected_path(len(x)) - (1 if len(x) == 0 else 0)
    mean = expected_path(min(rows, len(sample))) or 1.0
    return {"feature": feature, "cut": cut, "length": length, "mean": np.array(mean), "depth": np.array(depth)}


def anomaly(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / its expectation): near 1 where random splits part a row from the sample at once."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, cut, length in zip(forest["feature"], forest["cut"], forest["length"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(int(forest["depth"])):
            f = feature[node]
            go = 2 * node + 1 + (x[rows, f] >= cut[node])
            node = np.where(f >= 0, go, node)
        total += length[node]
    return np.clip(2 ** (-total / len(forest["feature"]) / float(forest["mean"])), 0, 1)


def _score(forest: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({k: np.asarray(batch.column(k)) for k in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly(forest, x))], names=[*batch.schema.names, "score"])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, keep: float = 0.998, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, COUNTS..., score, base_failed, kept) of each row of ``docs``.

    ``base_failed``: fewer than 10 words, or more than a fifth of them in repeated runs of five. ``score``: the
    forest's anomaly of the document's rates, over a forest grown on a bounded sample of rows labelled good (of all
    rows where none is). ``kept``: not base_failed, and a score up to the cut that labelled rows give (see
    calibrated_cut; ``keep`` of the good ones stay). Statistics and scores are of all rows and whole texts.

    Null or empty text: base_failed. Null id: scored, never labelled. An id with several labels counts with each.
    Empty table: no rows. No labels: the cut is 0.75.
    """
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    usable = stats.filter(~failed)
    draw = lambda rows: rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(SAMPLE_ROWS).select(*COUNTS).toArrow()
    sample = draw(usable.join(good, "doc_id", "left_semi"))
    if not len(sample):
        sample = draw(usable)
    if not len(sample):  # nothing passes the rules
        return stats.select("*", F.lit(1.0).alias("score"), failed.alias("base_failed"), F.lit(False).alias("kept"))
    forest = grow(features({k: np.asarray(sample[k]) for k in COUNTS}))
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS) + ", score double"
    scored = written(stats.mapInArrow(_score(forest), schema), "scored")
    cut = calibrated_cut(scored.filter(~failed).select("doc_id", "score"), labels, keep, 0.75, id_col, label_col)
    return scored.select("*", failed.alias("base_failed"), (~failed & (F.col("score") <= cut)).alias("kept"))
