"""Running numbers, ranks and medians of whole tables, by ranges of values, so that no task holds all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.shared import checkpointed

#: Rows of a range, about: a table has as many ranges as that takes.
RANGE_ROWS = 100_000
#: So many values around a quantile are brought to the driver at most, but for ties.
NEAR = 1_500


def in_ranges(df: DataFrame, order: list[Column], out: str = "_range", rows: int | None = None) -> DataFrame:
    """``df``, stored, with the number of its range: ranges of about RANGE_ROWS rows follow each other in ``order``."""
    stored = checkpointed(df)
    ranges = max(1, math.ceil(stored.count() / (rows or RANGE_ROWS)))
    if ranges == 1:
        return stored.withColumn(out, F.lit(0))
    return checkpointed(stored.repartitionByRange(ranges, *order).withColumn(out, F.spark_partition_id()))


def running_sums(df: DataFrame, order: list[Column], partition: list[str], value: Column, out: str, rows: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over itself and the rows before it in ``order``, within ``partition``.

    A window sorts one range of one partition; what lies before it is a sum of the sums of the ranges before. ``order``
    must be total, but for rows that may change places. Nulls of ``partition`` are a value.
    """
    placed = in_ranges(df, [*map(F.col, partition), *order], rows=rows).withColumn("_value", value)
    sums = placed.groupBy(*partition, "_range").agg(F.sum("_value").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)], F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = F.col("_range") == F.col("_at")
    for i, p in enumerate(partition):
        on = on & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    own = F.sum("_value").over(Window.partitionBy(*partition, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_own", own).join(starts, on).withColumn(out, F.col("_before") + F.coalesce("_own", F.lit(0))).select(*df.columns, out)


def with_row_numbers(df: DataFrame, order: list[Column], partition: list[str], out: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``out`` from 1, in ``order`` within ``partition``."""
    return running_sums(df, order, partition, F.lit(1).cast("long"), out, rows)


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """``df`` with the average rank of ``value`` (ties share their mean); nulls have none.

    Distinct values are counted first; running counts go by range of values, and then over ranges.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    through = running_sums(counts, [F.col("_v")], [], F.col("_c"), "_t")
    found = through.select("_v", (F.col("_t") - (F.col("_c") - 1) / 2.0).alias(out))
    return df.join(found, F.col(value) == F.col("_v"), "left").drop("_v")


def _inside(x: Column, low: float | None, high: float | None) -> Column:
    return (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)


def exact_medians(df: DataFrame, columns: list[str], near: int = NEAR) -> dict[str, float | None]:
    """Median of each column, the mean of the middle two where there is none; null without values."""
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5], near).items()}


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], near: int = NEAR) -> dict[str, list[float | None]]:
    """Quantiles of each column, between two values in proportion; null without values.

    The columns are stored first. Each round is two aggregates for all columns and shares: approximate quantiles just
    beside the one sought, and how many values lie before and between them. When ``near`` values are left of each, or
    only ties, one job counts all of them, and these counts come to the driver.
    """
    if not columns:
        return {}
    c = [F.col(f"_q{i}") for i in range(len(columns))]
    df = checkpointed(df.select(*[F.col(x).cast("double").alias(f"_q{i}") for i, x in enumerate(columns)]))
    total = df.agg(*[F.count(x) for x in c]).first()
    sought = [(i, q) for i in range(len(columns)) for q in shares]
    place = {(i, q): (total[i] - 1) * q for i, q in sought}
    middle = {k: (math.floor(max(0, v)), math.ceil(max(0, v))) for k, v in place.items()}
    state = {(i, q): (None, None, 0, total[i]) for i, q in sought}  # low, high, before low, between
    open_ = [k for k in sought if state[k][3] > near]
    while open_:
        groups: dict = {}  # those of one column between the same ends share a sketch
        for k in open_:
            low, high, before, n = state[k]
            at = [min(1.0, max(0.0, (i - before) / n + d)) for i, d in zip(middle[k], (-0.001, 0.001), strict=True)]
            groups.setdefault((k[0], low, high), []).append((k, at))
        sketches = df.agg(*[F.percentile_approx(F.when(_inside(c[i], low, high), c[i]), [x for _, at in of for x in at], 10_000) for (i, low, high), of in groups.items()]).first()
        ends = {k: (row[2 * j], row[2 * j + 1]) for row, of in zip(sketches, groups.values(), strict=True) for j, (k, _) in enumerate(of)}
        row = df.agg(*[f for k in open_ for f in (F.count_if(c[k[0]] < ends[k][0]), F.count_if(c[k[0]].between(*ends[k])))]).first()
        still = []
        for j, k in enumerate(open_):
            before, n = row[2 * j], row[2 * j + 1]
            if before <= middle[k][0] and middle[k][1] < before + n and n < state[k][3]:
                state[k] = (*ends[k], before, n)
                if n > near and ends[k][0] < ends[k][1]:
                    still.append(k)
        open_ = still
    ranges = sorted({(i, *state[i, q][:2]) for i, q in sought if state[i, q][3]}, key=lambda r: (r[0], r[1] is not None, r[1], r[2]))
    counted: dict = {(i, low, high): [(low, state[i, q][3])] for i, q in sought for low, high in [state[i, q][:2]] if low is not None and low == high}
    ranges = [r for r in ranges if r not in counted]  # of ties the number is known
    if ranges:
        held = F.array_compact(F.array(*[F.when(c[i].isNotNull() & _inside(c[i], low, high), F.struct(F.lit(r).alias("r"), c[i].alias("v"))) for r, (i, low, high) in enumerate(ranges)]))
        for r, v, times in df.select(F.explode(held).alias("x")).select("x.*").groupBy("r", "v").count().collect():
            counted.setdefault(ranges[r], []).append((v, times))
    out: dict = {x: [] for x in columns}
    for i, q in sought:
        low, high, before, n = state[i, q]
        through, found = before, {}
        for v, times in sorted(counted.get((i, low, high), [])):
            found |= {m: v for m in middle[i, q] if through <= m < through + times}
            through += times
        if not found:
            out[columns[i]].append(None)
            continue
        a, b = (found[m] for m in middle[i, q])
        out[columns[i]].append(a + (b - a) * (place[i, q] - middle[i, q][0]))
    return out
