"""Categories as numbers by the means of a target, in an order in which no row sees itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.shared import checkpointed

#: Rows of a range of the order, about.
RANGE_ROWS = 5_000


def _prior(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("_y").alias("_prior"), F.count("_y").alias("_rows"))


def _smoothed(total: Column, n: Column, weight: float) -> Column:
    return (total + F.col("_prior") * weight) / (n + weight)


def ordered_target_stats(df: DataFrame, key: str, categories: list[str], target: str, seed: int = 42, weight: float = 1.0, train: Column | None = None) -> DataFrame:
    """``df`` with ``{category}_ts``: the mean target of the rows of one's category that come before it, and of ``weight`` rows of the mean of all.

    Rows come in the order of a seeded md5 of ``key``, which names a row (rows of one key: as stored values sort); only
    rows with a target, and those where ``train`` holds, are counted. A row that is not counted itself gets the mean of
    the whole category, as new data do. A null category is one of its own; one without counted rows has the mean of
    all. No counted rows at all: null.

    A category may be that of most rows: its order is cut into ranges of hashes, with sums before each, and a window
    holds one range only.
    """
    y = F.col(target).cast("double")
    counted = y.isNotNull() if train is None else y.isNotNull() & F.coalesce(train, F.lit(False))
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = checkpointed(df.withColumns({"_y": F.when(counted, y), "_h": h}))
    prior = _prior(rows)
    n = rows.count()
    digits = max(0, math.ceil(math.log(max(1, n / RANGE_ROWS), 16)))
    out = rows.withColumn("_range", F.substring("_h", 1, digits))
    for i, c in enumerate(categories):
        sums = out.groupBy(c, "_range").agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
        whole, before = Window.partitionBy(c), Window.partitionBy(c).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        of = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
        sums = sums.select(F.col(c).alias("_c"), F.col("_range").alias("_at"), of("_s", before).alias("_s0"), of("_n", before).alias("_n0"), of("_s", whole).alias("_s1"), of("_n", whole).alias("_n1"))
        own = Window.partitionBy(c, "_range").orderBy("_h", key, "_y").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"_own_s{i}": of("_y", own), f"_own_n{i}": F.count("_y").over(own)})
        out = out.join(sums, F.col(c).eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_at")))
        total = F.when(F.col("_y").isNull(), F.col("_s1")).otherwise(F.col("_s0") + F.col(f"_own_s{i}"))
        rows_seen = F.when(F.col("_y").isNull(), F.col("_n1")).otherwise(F.col("_n0") + F.col(f"_own_n{i}"))
        out = out.withColumns({f"_total{i}": total, f"_seen{i}": rows_seen}).drop("_c", "_at", "_s0", "_n0", "_s1", "_n1", f"_own_s{i}", f"_own_n{i}")
    out = out.crossJoin(F.broadcast(prior))
    stats = {f"{c}_ts": _smoothed(F.col(f"_total{i}"), F.col(f"_seen{i}"), weight) for i, c in enumerate(categories)}
    return out.select(*df.columns, *[x.alias(name) for name, x in stats.items()])


def category_stats(df: DataFrame, category: str, target: str, weight: float = 1.0) -> DataFrame:
    """(category, {category}_ts) of the whole table, to be joined to new rows; a category that is not there has the mean of all."""
    rows = df.select(category, F.col(target).cast("double").alias("_y")).filter("_y is not null")
    sums = rows.groupBy(category).agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
    return sums.crossJoin(F.broadcast(_prior(rows))).select(category, _smoothed(F.col("_s"), F.col("_n"), weight).alias(f"{category}_ts"))
