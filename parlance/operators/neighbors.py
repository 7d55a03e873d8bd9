"""Mutual information by nearest neighbours.

Points (feature, target) are scaled and rounded to whole numbers, so all comparisons are exact; equal points are one with
a weight. They are dealt into cells of at most CELL_POINTS: slabs by rank of x, and within a slab by rank of y. A cell
gives each of its points an upper bound of the distance to its k-th neighbour; only cells that the box of that radius
meets are searched besides. Marginal counts are running sums over sorted values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.ranks import running_sums, with_row_numbers
from parlance.shared import checkpointed

#: Points of a cell, at most; a task compares each with all of its cell.
CELL_POINTS = 256
#: Parts of a standard deviation to which values are rounded.
PARTS = 2**32

_FOUND = "feature string, id long, d array<long>, m array<long>"


def digamma(n: Column) -> Column:
    """Of whole numbers from 1 on: six steps up, and the asymptotic series there."""
    x = n.cast("double") + 6
    inverse = F.lit(1.0) / (x * x)
    series = F.log(x) - F.lit(0.5) / x - inverse * (F.lit(1.0 / 12) - inverse * (F.lit(1.0 / 120) - inverse * (F.lit(1.0 / 252) - inverse * (F.lit(1.0 / 240) - inverse * F.lit(1.0 / 132)))))
    return series - sum((F.lit(1.0) / (n + i) for i in range(1, 6)), F.lit(1.0) / n)


def _ten_digits(x: Column) -> Column:
    """So that the order of summing, on which the last digits depend, does not decide which distances are equal."""
    unit = F.pow(F.lit(10.0), 9 - F.floor(F.log10(x)))
    return F.when(x > 0, F.round(x * unit) / unit)


def _points(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, x, y, m): different scaled points of each feature and how many rows have them."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    long = df.select(value(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("x")) for c in columns])).alias("p")).select("p.feature", "p.x", "y").filter("x is not null and y is not null")
    scales = F.broadcast(long.groupBy("feature").agg(_ten_digits(F.stddev_pop("x")).alias("sx"), _ten_digits(F.stddev_pop("y")).alias("sy")))
    whole = lambda v, s: F.round(F.when(F.col(s) > 0, F.col(v) / F.col(s)).otherwise(0.0) * PARTS).cast("long")
    return long.join(scales, "feature").groupBy("feature", whole("x", "sx").alias("x"), whole("y", "sy").alias("y")).agg(F.count("*").alias("m"))


def _celled(points: DataFrame, cell_points: int) -> DataFrame:
    """``points`` with ``id``, their number within the feature in order of (x, y), and the numbers of their ``slab`` and ``cell``."""
    placed = with_row_numbers(points, [F.col("x"), F.col("y")], ["feature"], "id")
    n = placed.groupBy("feature").agg(F.max("id").alias("n"))
    cells = F.ceil(F.col("n") / F.lit(cell_points))
    slabs = F.ceil(F.sqrt(cells.cast("double")))
    placed = placed.join(F.broadcast(n.withColumn("slabs", slabs)), "feature")
    placed = placed.withColumn("slab", F.floor((F.col("id") - 1) * F.col("slabs") / F.col("n")).cast("long"))
    by_y = Window.partitionBy("feature", "slab").orderBy("y", "x")
    own = F.row_number().over(by_y)
    size = F.count("*").over(Window.partitionBy("feature", "slab"))
    parts = F.ceil(size / F.lit(cell_points))
    return placed.withColumn("cell", F.floor((own - 1) * parts / size).cast("long")).drop("n", "slabs")


def _nearest(of: pd.DataFrame, among: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """For each point of ``of`` the distances and weights of its nearest among the others, until their weights make ``k``."""
    x, y, m = (among[c].to_numpy() for c in ("x", "y", "m"))
    rows = []
    for i, px, py, pm in zip(of["id"], of["x"], of["y"], of["m"], strict=True):
        d = np.maximum(np.abs(x - px), np.abs(y - py))
        w = m.copy()
        if same:
            w[(x == px) & (y == py)] = pm - 1  # not itself
        near = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
        near = near[np.argsort(d[near], kind="stable")]
        near = near[w[near] > 0]
        through = np.cumsum(w[near])
        near = near[: int(np.searchsorted(through, k)) + 1]
        rows.append((i, d[near].tolist(), w[near].tolist()))
    return pd.DataFrame(rows, columns=["id", "d", "m"])


def _kth(d: Column, m: Column, k: int) -> Column:
    """The distance at which the weights of pairs (d, m), sorted, reach ``k``; null where they do not."""
    pairs = F.array_sort(F.arrays_zip(d.alias("d"), m.alias("m")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("r"))
    step = lambda a, p: F.struct((a["n"] + p["m"]).alias("n"), F.when(a["r"].isNull() & (a["n"] + p["m"] >= k), p["d"]).otherwise(a["r"]).alias("r"))
    return F.aggregate(pairs, start, step)["r"]


def _radii(placed: DataFrame, k: int) -> DataFrame:
    """(feature, id, r): the exact distance of each point to its k-th neighbour."""

    def within(part: pd.DataFrame) -> pd.DataFrame:
        return _nearest(part, part, k, True).assign(feature=part["feature"].iloc[0])[["feature", "id", "d", "m"]]

    own = checkpointed(placed.groupBy("feature", "slab", "cell").applyInPandas(within, _FOUND))
    boxes = placed.groupBy("feature", "slab", "cell").agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
    slabs = boxes.groupBy("feature", "slab").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_sort(F.collect_list(F.struct("cell", "y0", "y1"))).alias("cells"))
    outer = slabs.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("slab", "x0", "x1"))).alias("slabs"))
    far = F.lit(2**62)
    reach = placed.join(own.select("feature", "id", F.coalesce(_kth(F.col("d"), F.col("m"), k), far).alias("r")), ["feature", "id"])
    meets = lambda item, c, lo, hi: (item[lo] < F.col(c) + F.col("r")) & (item[hi] > F.col(c) - F.col("r"))
    asked = reach.filter("r > 0").join(F.broadcast(outer), "feature")
    asked = asked.select("feature", "id", "x", "y", "m", "r", F.struct("slab", "cell").alias("home"), F.explode(F.filter("slabs", lambda s: meets(s, "x", "x0", "x1"))["slab"]).alias("slab"))
    asked = asked.join(slabs.select("feature", "slab", "cells"), ["feature", "slab"])
    asked = asked.select("feature", "id", "x", "y", "m", "home", "slab", F.explode(F.filter("cells", lambda c: meets(c, "y", "y0", "y1"))["cell"]).alias("cell"))
    asked = asked.filter((F.col("slab") != F.col("home.slab")) | (F.col("cell") != F.col("home.cell"))).drop("home")

    def beyond(points: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(members):
            return pd.DataFrame({c: [] for c in ("feature", "id", "d", "m")}, dtype=object)
        return _nearest(points, members, k, False).assign(feature=points["feature"].iloc[0])[["feature", "id", "d", "m"]]

    keys = ("feature", "slab", "cell")
    asked = asked.select(*[F.col(c).alias(c) for c in (*keys, "id", "x", "y", "m")])
    others = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(beyond, _FOUND)
    found = own.union(others).groupBy("feature", "id").agg(F.flatten(F.collect_list("d")).alias("d"), F.flatten(F.collect_list("m")).alias("m"))
    return found.select("feature", "id", _kth(F.col("d"), F.col("m"), k).alias("r"))


def _below(values: DataFrame, at: DataFrame) -> DataFrame:
    """(feature, v, below): the weights of ``values`` (feature, v, m) below each different v of ``at``."""
    both = values.groupBy("feature", "v").agg(F.sum("m").alias("m")).withColumn("kind", F.lit(1)).unionByName(at.distinct().withColumns({"m": F.lit(0).cast("long"), "kind": F.lit(0)}))
    return running_sums(both, [F.col("v"), F.col("kind")], ["feature"], F.col("m"), "below").filter("kind = 0").select("feature", "v", "below")


def _counts(points: DataFrame, c: str) -> DataFrame:
    """(feature, id, n): rows whose value ``c`` is nearer than the radius, or equal where that is 0; the point's own included."""
    ends = points.select("feature", "id", (F.col(c) - F.greatest("r", F.lit(1)) + 1).alias("lo"), (F.col(c) + F.greatest("r", F.lit(1))).alias("hi"))
    ends = checkpointed(ends)
    at = ends.select("feature", F.explode(F.array("lo", "hi")).alias("v"))
    below = _below(points.select("feature", F.col(c).alias("v"), "m"), at)
    low = below.select("feature", F.col("v").alias("lo"), F.col("below").alias("a"))
    high = below.select("feature", F.col("v").alias("hi"), F.col("below").alias("b"))
    return ends.join(low, ["feature", "lo"]).join(high, ["feature", "hi"]).select("feature", "id", (F.col("b") - F.col("a")).alias(f"n{c}"))


def neighbour_information(df: DataFrame, columns: list[str], target: str, k: int = 3, cell_points: int = CELL_POINTS) -> DataFrame:
    """(feature, n, mi) in nats for each column: digamma(n) + digamma(k) less the means of digamma of the marginal counts, 0 at least.

    The radius of a row is the greater of the distances in feature and target to its k-th nearest other row, all
    values over their deviations; the counts are of rows nearer than that in one of the two, itself included (of equal
    ones where the radius is 0). Nothing random is added, so equal values stay equal. Rows with a null in a pair are left
    out of it; with ``k`` rows or fewer the information is null, and without rows the feature is missing.
    """
    points = _celled(_points(df, columns, target), cell_points)
    points = checkpointed(points)
    full = checkpointed(points.join(_radii(points, k), ["feature", "id"]))
    counted = full.join(_counts(full.filter("r is not null"), "x"), ["feature", "id"], "left").join(_counts(full.filter("r is not null"), "y"), ["feature", "id"], "left")
    m = F.col("m").cast("double")
    mean = lambda n: F.sum(m * digamma(F.col(n))) / F.sum("m")
    rows = counted.groupBy("feature").agg(F.sum("m").alias("n"), (mean("nx") + mean("ny")).alias("_means"))
    constant = -0.5772156649015329 + sum(1.0 / i for i in range(1, k))  # digamma(k)
    return rows.select("feature", "n", F.when(F.col("n") > k, F.greatest(F.lit(0.0), digamma(F.col("n")) + F.lit(constant) - F.col("_means"))).alias("mi"))
