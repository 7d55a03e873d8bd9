"""A cut of a score in [0, 1] from labelled rows, by a histogram that Spark counts over all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1000


def calibrated_cut(scored: DataFrame, labels: DataFrame, keep: float, default: float, id_col: str = "doc_id", label_col: str = "quality") -> float:
    """The cut above which a row is bad: of all that lose no more good rows than ``keep`` lets expect, that of the best balanced accuracy.

    Of n good rows (1 - keep) * n may be lost, and twice the root of that number as well, rounded up: the upper end of
    what chance makes of it. So one odd or mislabelled good row does not decide, and with many labels ``keep`` holds.

    ``scored``: (doc_id, score), higher is worse; ``labels``: ``label_col`` 1 is good, 0 is bad, null is ignored.
    Without rows of both kinds: ``default``. Between the last bad bin's edge and the first good one's, the middle.
    """
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("good")).filter("good is not null")
    bins = scored.join(named, "doc_id").groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("score") * BINS)).cast("int").alias("bin")).agg(
        F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad")
    )
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for row in bins.collect():  # BINS rows at most
        good[row["bin"]], bad[row["bin"]] = row["good"], row["bad"]
    if not good.sum() or not bad.sum():
        return default
    kept = np.cumsum(good) / good.sum()  # by a cut at the upper edge of each bin
    caught = 1 - np.cumsum(bad) / bad.sum()
    lost = (1 - keep) * good.sum()
    merit = np.where(good.sum() - np.cumsum(good) <= np.ceil(lost + 2 * np.sqrt(lost)), kept + caught, -1)
    best = np.flatnonzero(merit >= merit.max() - 1e-12)
    return float((best[0] + best[-1] + 2) / 2 / BINS)
