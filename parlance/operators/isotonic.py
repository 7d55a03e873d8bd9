"""Isotonic regression over ranges: adjacent violators are pooled where they lie, and only blocks that others still oppose move.

Each range of x pools its own points. A block is final when no block before it has a greater mean and none after it a
lesser one; pooling never reaches over it, as means of pools lie between those of their blocks. The blocks that are not
final go on in new groups, which begin half a group later each time, until none are left. So a task holds one group, and
the driver sees counts only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from parlance.operators.ranks import in_ranges, with_row_numbers
from parlance.shared import checkpointed

#: Points of a range, and blocks of a group, at most about.
GROUP_ROWS = 100_000
#: So many blocks (32 bytes each) go to all tasks when values are looked up; more meet the values in sorted ranges.
BROADCAST_BLOCKS = 100_000

_BLOCKS = "part long, low double, high double, w double, s double"


def pooled(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Where the blocks begin after adjacent ones with falling means s / w are pooled, from weights and sums in order."""
    begin, weight, total = [], [], []
    for i, (a, b) in enumerate(zip(w.tolist(), s.tolist(), strict=True)):
        at = i
        while weight and total[-1] * a >= b * weight[-1]:
            at, a, b = begin.pop(), a + weight.pop(), b + total.pop()
        begin.append(at)
        weight.append(a)
        total.append(b)
    return np.array(begin, np.int64)


def _pool(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("low", ignore_index=True)
    w, s = part["w"].to_numpy(), part["s"].to_numpy()
    begin = pooled(w, s)
    end = np.append(begin[1:], len(part)) - 1
    return pd.DataFrame({"part": part["part"].iloc[0], "low": part["low"].to_numpy()[begin], "high": part["high"].to_numpy()[end], "w": np.add.reduceat(w, begin), "s": np.add.reduceat(s, begin)})


def isotonic_blocks(df: DataFrame, y: str, x: str, weight: str | None = None, rows: int | None = None) -> DataFrame:
    """(low, high, w, value) of the least squares fit of ``y`` that does not fall with ``x``: blocks of equal value, in order of x.

    Rows of one ``x`` count as their mean; a null in ``x``, ``y`` or the weight, or a weight of 0 or less, leaves a row
    out. No rows: no blocks.
    """
    size = rows or GROUP_ROWS
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    given = df.select(F.col(x).cast("double").alias("low"), F.col(y).cast("double").alias("y"), w.alias("w")).filter("low is not null and y is not null and w > 0")
    points = given.groupBy("low").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
    open_ = in_ranges(points, [F.col("low")], "part", size).select(F.col("part").cast("long").alias("part"), "low", F.col("low").alias("high"), "w", "s")
    final, round_ = None, 0
    while True:
        blocks = checkpointed(open_.groupBy("part").applyInPandas(_pool, _BLOCKS))
        mean = F.col("s") / F.col("w")
        ends = blocks.groupBy("part").agg(F.min(mean).alias("first"), F.max(mean).alias("last"))
        order = Window.orderBy("part")
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        bounds = ends.select("part", F.max("last").over(before).alias("most"), F.min("first").over(after).alias("least"))
        ok = (F.col("most").isNull() | (mean >= F.col("most"))) & (F.col("least").isNull() | (mean <= F.col("least")))
        marked = checkpointed(blocks.join(bounds, "part").withColumn("ok", ok).drop("most", "least"))
        done = marked.filter("ok")
        final = done if final is None else final.union(done)
        left = marked.filter(~F.col("ok"))
        if left.isEmpty():
            return final.select("low", "high", "w", (F.col("s") / F.col("w")).alias("value"))
        round_ += 1
        numbered = with_row_numbers(left.drop("ok", "part"), [F.col("low")], [], "_i", size)
        shift = size // 2 if round_ % 2 else 0
        open_ = numbered.select(F.floor((F.col("_i") - 1 + shift) / size).alias("part"), "low", "high", "w", "s")


def isotonic_values(df: DataFrame, blocks: DataFrame, x: str, out: str) -> DataFrame:
    """``df`` with ``out``: the value of the block that holds ``x``, in proportion between two blocks, and the end blocks' beyond them.

    Null ``x``, or no blocks: null. ``blocks`` should be stored. Few blocks go to the tasks; otherwise the different values
    of ``x`` are sorted with the blocks, by ranges.
    """
    blocks = checkpointed(blocks)
    n = blocks.count()
    if n <= BROADCAST_BLOCKS:
        table = blocks.orderBy("low").toPandas()
        knots, values = table[["low", "high"]].to_numpy(float).ravel(), np.repeat(table["value"].to_numpy(float), 2)

        @pandas_udf("double")
        def look_up(v: pd.Series) -> pd.Series:
            return pd.Series(np.where(v.isna(), np.nan, np.interp(v.to_numpy(float), knots, values))) if len(knots) else pd.Series(np.full(len(v), np.nan))

        return df.withColumn(out, F.nanvl(look_up(F.col(x).cast("double")), F.lit(None).cast("double")))
    asked = df.select(F.col(x).cast("double").alias("v")).filter("v is not null").distinct()
    knot = F.explode(F.array(F.struct(F.col("low").alias("v"), "value"), F.struct(F.col("high").alias("v"), "value"))).alias("k")
    both = asked.withColumn("knot", F.lit(None).cast("struct<v:double,value:double>")).union(blocks.select(knot).distinct().select("k.v", "k"))
    placed = in_ranges(both, [F.col("v"), F.col("knot").isNull()], "part", GROUP_ROWS)
    ranges = placed.groupBy("part").agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    order = Window.orderBy("part")
    ranges = ranges.select("part", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    own = Window.partitionBy("part").orderBy("v", F.col("knot").isNull())
    placed = placed.withColumns({"a": F.last("knot", True).over(own.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first("knot", True).over(own.rowsBetween(0, Window.unboundedFollowing))})
    placed = placed.filter("knot is null").join(ranges, "part").select("v", F.coalesce("a", "before").alias("a"), F.coalesce("b", "after").alias("b"))
    share = (F.col("v") - F.col("a.v")) / (F.col("b.v") - F.col("a.v"))
    value = F.when(F.col("a").isNull(), F.col("b.value")).when(F.col("b").isNull() | (F.col("a.v") == F.col("v")), F.col("a.value")).otherwise(F.col("a.value") + (F.col("b.value") - F.col("a.value")) * share)
    found = placed.select(F.col("v").alias("_v"), value.alias(out))
    return df.join(found, F.col(x).cast("double") == F.col("_v"), "left").drop("_v")
