"""Mixing sources to target weights: hash-random order in each source, distributed prefix sums, a cut at the budget.

The order within a source is that of a seeded hash of the id and the text. Its leading hex digits deal a source into
ranges of keys, so a running sum needs only its range's rows and the sum of the ranges before it, and no source is one
task. Rows that share a key are equal in id and text; where they are more than a range should have, the key is cut out
of its range, and its rows are dealt into pieces by their places. Keys and sizes are written once, so texts are read
and counted once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.storage import checkpointed, small_side, written
from parlance.llm.text import n_words

#: Rows of a range of keys, about.
RANGE_ROWS = 5_000
#: A range of so many times that is looked through for keys that many rows share.
HOT_RANGE = 4
#: Ranges with such keys are broadcast up to this number (some 50 bytes a key); more are joined by a shuffle.
BROADCAST_RANGES = 200_000
#: The columns that name a range; within a source, ranges in their order have keys in order.
RANGE = ["range", "part", "piece"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """(src, source_size, target) of each source, from (src, source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all sizes by weight; a target
    stops at ``max_epochs`` times its source's size, and what is over is shared by the others, until none is above.
    One row a source; sources that stop are those of the least size a weight, so one ordered pass finds the level.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(max_epochs))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", budget / left)
    open_ = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("r"), "rank", "level"))
    leveled = leveled.withColumn("final", F.min(open_).over(whole)["level"])
    target = F.when(F.col("most") < F.col("final") * F.col("weight"), F.col("most").cast("double"))
    target = F.coalesce(target, F.col("final") * F.col("weight"), F.col("most").cast("double"))
    return leveled.select("src", "source_size", target.alias("target"))


def _dealt(base: DataFrame, digits: int) -> DataFrame:
    """``base`` (src, key, place, ...) with RANGE: leading digits, place among the hot keys of these, piece of a hot key.

    Hot keys have more than RANGE_ROWS rows, so they are fewer than the rows by that factor, and as keys are hashes,
    a range has about one of them at most.
    """
    base = base.withColumn("range", F.substring("key", 1, digits))
    wide = base.groupBy("src", "range").count().filter(F.col("count") > HOT_RANGE * RANGE_ROWS).select("src", "range")
    hot = base.join(checkpointed(wide), ["src", "range"], "left_semi").groupBy("src", "range", "key").count().filter(F.col("count") > RANGE_ROWS)
    pieces = F.ceil(F.col("count") / RANGE_ROWS).alias("pieces")
    hot = checkpointed(hot.groupBy("src", "range").agg(F.collect_list(F.struct("key", pieces)).alias("hot")))
    if not hot.limit(1).count():
        return base.withColumns({"part": F.lit(0), "piece": F.lit(0)})
    named = base.join(small_side(hot, BROADCAST_RANGES), ["src", "range"], "left").withColumn("hot", F.coalesce("hot", F.array()))
    below = F.size(F.filter("hot", lambda x: x["key"] < F.col("key")))
    own = F.get(F.filter("hot", lambda x: x["key"] == F.col("key")), F.lit(0))["pieces"]
    piece = F.coalesce(F.pmod(F.xxhash64("place"), own), F.lit(0)).cast("int")
    return named.withColumns({"part": 2 * below + own.isNotNull().cast("int"), "piece": piece}).drop("hot")


def _planned(docs: DataFrame, row: list[Column], share: float, weights: tuple[float, ...], max_epochs: int, seed: int, digits: int | None, id_col: str, source_col: str, text_col: str) -> DataFrame:
    digest = F.md5(F.col(text_col).cast("binary"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(digest, F.lit(""))))
    base = docs.select(
        *row,
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"),
        n_words(F.col(text_col)).alias("size"),
        key.alias("key"),
        F.monotonically_increasing_id().alias("place"),  # fixed once written
    )
    base = written(base, "sizes")
    if digits is None:
        digits = max(1, math.ceil(math.log(max(1, base.count() / RANGE_ROWS), 16)))
    base = _dealt(base, digits)
    ranges = base.groupBy("src", *RANGE).agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    targets = source_targets(ranges.groupBy("src").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    ahead = F.sum("range_size").over(Window.partitionBy("src").orderBy(*RANGE).rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("src", *RANGE, F.coalesce(ahead, F.lit(0)).alias("ahead")).join(targets, "src")
    own = Window.partitionBy("src", *RANGE).orderBy("key", "place").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.withColumn("through", F.sum("size").over(own)).join(starts, ["src", *RANGE])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("full") * F.col("source_size")
    before = F.col("ahead") + F.col("through") - F.col("size")
    more = (rest > 0) & ((rest - before) * 2 >= F.col("size"))
    return placed.withColumn("full", full).withColumn("copies", (F.col("full") + more.cast("int")).cast("int"))


def mixing_plan(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 2, seed: int = 11, digits: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of ``docs``.

    ``size`` is the number of words, 0 for null; ``target`` as in source_targets; a source's documents in the order of
    their seeded hash are taken as often as its target holds it whole, and once more up to the budget that is left:
    whole documents only, the last one if at least half of it fits. ``taken`` = copies * size, at most ``max_epochs``
    times the size. Sums are exact, so reruns agree.

    Null source: a source of its own, last. Null id: ordered as an empty one. Rows that repeat an id: each a document.
    Rows equal in id and text, however many: any of them may be the ones that are taken once more. A source without words: target 0. Empty table: no rows. ``digits`` hex digits of the hash make a source's ranges; by
    default as many as leave some RANGE_ROWS rows to a range.
    """
    planned = _planned(docs, [], share, weights, max_epochs, seed, digits, id_col, source_col, text_col)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 2, seed: int = 11, digits: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as mixing_plan takes it.

    Nulls, repeated ids, ties and empty tables as in mixing_plan; columns of any name stay as they are.
    """
    planned = _planned(docs, [F.struct(*docs.columns).alias("row")], share, weights, max_epochs, seed, digits, id_col, source_col, text_col)
    return planned.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).select("row.*")
