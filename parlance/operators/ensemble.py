"""Blends of predictions, their weights, and importances."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.shared import checkpointed

#: The blend by hand.
FIXED_WEIGHTS = (0.50, 0.25, 0.25)
#: Rows among which a column is shuffled, about, where a table has more.
BLOCK_ROWS = 5_000
#: Bytes of a hash that go with a row.
MOVED_BYTES = 12


def blend(columns: list[str], weights: list[float] | tuple[float, ...] | None = None) -> Column:
    """The weighted mean of predictions; the plain mean without weights."""
    w = list(weights or [1.0] * len(columns))
    return sum((F.col(c) * F.lit(float(x)) for c, x in zip(columns, w, strict=True)), F.lit(0.0)) / F.lit(float(sum(w)))


def inverse_error_weights(df: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """A row of weights w_{column}, one over each model's mean absolute error, summing to 1."""
    row = df.agg(*[F.avg(F.abs(F.col(c) - F.col(y))).alias(f"_{i}") for i, c in enumerate(columns)])
    parts = [F.try_divide(F.lit(1.0), F.col(f"_{i}")) for i in range(len(columns))]
    whole = sum(parts[1:], parts[0])
    return row.select(*[(p / whole).alias(f"w_{c}") for p, c in zip(parts, columns, strict=True)])


def simplex(models: int, steps: int) -> list[tuple[float, ...]]:
    """All weights that are multiples of 1 / ``steps`` and sum to 1."""
    return [(*x, steps - sum(x)) for x in product(range(steps + 1), repeat=models - 1) if sum(x) <= steps]


def _errors_of(df: DataFrame, y: str, columns: list[str], points: list[tuple[float, ...]]) -> DataFrame:
    """(w0, w1, ..., mae) of each point: rows meet the fixed list of points, and errors are combined before the shuffle."""
    names = [f"w{i}" for i in range(len(columns))]
    grid = F.array(*[F.struct(*[F.lit(w).alias(n) for n, w in zip(names, point, strict=True)]) for point in points])
    own = [f"_{n}" for n in names]
    rows = df.select(F.col(y).alias("_y"), *[F.col(c).alias(n) for c, n in zip(columns, own, strict=True)], F.explode(grid).alias("_p")).select("*", "_p.*")
    blended = sum((F.col(o) * F.col(n) for o, n in zip(own, names, strict=True)), F.lit(0.0))
    return rows.groupBy(*names).agg(F.avg(F.abs(blended - F.col("_y"))).alias("mae"))


def simplex_errors(df: DataFrame, y: str, columns: list[str], steps: int = 20) -> DataFrame:
    """(w0, w1, ..., mae) of every point of the weight grid (231 for three models in steps of 0.05), from one pass over the rows."""
    return _errors_of(df, y, columns, [tuple(w / steps for w in point) for point in simplex(len(columns), steps)])


def best_weights(errors: DataFrame) -> DataFrame:
    """The row of the least error; of equal ones the one of the greatest first weights."""
    names = [c for c in errors.columns if c != "mae"]
    return errors.orderBy("mae", *[F.desc(c) for c in names]).limit(1)


def refined_weights(df: DataFrame, y: str, columns: list[str], steps: int = 20, fine: int = 5) -> DataFrame:
    """(w0, w1, ..., mae) of the least error near the grid's best point: ``fine`` steps for each of the grid's, up to one of it away."""
    best = best_weights(simplex_errors(df, y, columns, steps)).first()
    whole = steps * fine
    middle = [round(best[f"w{i}"] * whole) for i in range(len(columns))]
    moves = product(range(-fine, fine + 1), repeat=len(columns) - 1)
    points = [[m + d for m, d in zip(middle, (*move, -sum(move)), strict=True)] for move in moves]
    points = [p for p in points if min(p) >= 0]
    return best_weights(_errors_of(df, y, columns, [tuple(w / whole for w in p) for p in points]))


def lowest_point(planes: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, value): the weights from 0 that sum to 1 and have the least greatest entry of planes @ weights.

    With all entries above 0 that is the greatest sum of u under planes @ u <= 1, by pivots; the least index breaks ties.
    """
    shift = 1.0 - float(planes.min())
    rows, columns = planes.shape
    table = np.zeros((rows + 1, columns + rows + 1))
    table[:rows, :columns], table[:rows, columns:-1], table[:rows, -1] = planes + shift, np.eye(rows), 1.0
    table[-1, :columns] = -1.0
    basis = list(range(columns, columns + rows))
    while (table[-1, :-1] < -1e-12).any():
        enter = int(np.flatnonzero(table[-1, :-1] < -1e-12)[0])
        can = np.flatnonzero(table[:rows, enter] > 1e-12)
        leave = int(min(can, key=lambda i: (table[i, -1] / table[i, enter], basis[i])))
        table[leave] /= table[leave, enter]
        for i in range(rows + 1):
            if i != leave:
                table[i] -= table[i, enter] * table[leave]
        basis[leave] = enter
    u = np.zeros(columns + rows)
    u[basis] = table[:rows, -1]
    total = u[:columns].sum()
    return u[:columns] / total, 1.0 / total - shift


def least_error_weights(df: DataFrame, y: str, columns: list[str], tolerance: float = 1e-9, rounds: int = 200) -> tuple[dict[str, float], float]:
    """({column}: weight, mean absolute error): weights from 0 that sum to 1 with the least error, by cutting planes.

    The error is convex, so its slope at a point is a plane below it everywhere. A round measures two points and their
    planes in one aggregate: the lowest point of all planes so far, and the middle between it and the best point; the
    first round measures every single model and the plain mean. It ends when the lowest plane is within ``tolerance``
    of the best error. Rows with a null do not count; without rows the weights are equal and the error is not a number.
    """
    e = [F.col(c).cast("double") for c in columns]
    target = F.col(y).cast("double")
    rows = df.select(target.alias("_y"), *[x.alias(f"_m{i}") for i, x in enumerate(e)]).dropna()
    n = len(columns)
    points = [np.eye(n)[i] for i in range(n)] + ([np.full(n, 1 / n)] if n > 1 else [])
    best, at, planes = np.inf, np.full(n, 1 / n), []
    for _ in range(rounds):
        aims = []
        for k, w in enumerate(points):
            error = sum((F.col(f"_m{i}") * float(w[i]) for i in range(n)), F.lit(0.0)) - F.col("_y")
            aims += [F.avg(F.abs(error)).alias(f"f{k}"), *[F.avg(F.signum(error) * F.col(f"_m{i}")).alias(f"g{k}_{i}") for i in range(n)]]
        found = rows.agg(*aims).first()
        if found["f0"] is None:
            return dict(zip(columns, at.tolist(), strict=True)), math.nan
        for k, w in enumerate(points):
            g = np.array([found[f"g{k}_{i}"] for i in range(n)])
            planes.append(g + found[f"f{k}"] - float(g @ w))  # at weights v: the error here and g times the way, as they sum to 1
            if found[f"f{k}"] < best:
                best, at = found[f"f{k}"], w
        lowest, bound = lowest_point(np.array(planes))
        if best - bound <= tolerance * max(1.0, abs(best)):
            break
        points = [lowest, (lowest + at) / 2]
    return dict(zip(columns, map(float, at), strict=True)), float(best)


def stack(df: DataFrame, y: str, columns: list[str], alpha: float = 1.0) -> tuple[object, DataFrame]:
    """(ridge model over the predictions, ``df`` with ``stacked``)."""
    rows = VectorAssembler(inputCols=columns, outputCol="_features").transform(df)
    fitted = LinearRegression(featuresCol="_features", labelCol=y, predictionCol="stacked", regParam=alpha, elasticNetParam=0.0).fit(rows)
    return fitted, fitted.transform(rows).drop("_features")


def seed_spread(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Mean and population deviation of predictions over seeds, by row."""
    return df.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def group_importance(importances: DataFrame, groups: dict[str, str], feature: str = "feature", value: str = "importance_mean") -> DataFrame:
    """(feature_group, sum, mean, n, pct) of importances by the features' prefix; others are OTHER."""
    name = F.lit("OTHER")
    for prefix, group in groups.items():
        name = F.when(F.col(feature).startswith(prefix), group).otherwise(name)
    sums = importances.groupBy(name.alias("feature_group")).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    whole = importances.agg(F.sum(value).alias("_w"))
    return sums.crossJoin(F.broadcast(whole)).withColumn("pct", F.try_divide(F.col("sum") * 100, "_w")).drop("_w")


def mean_absolute(table: DataFrame) -> DataFrame:
    """(feature, value): the mean absolute value of every column of an attribution table."""
    row = table.agg(*[F.avg(F.abs(F.col(c))).alias(f"_{i}") for i, c in enumerate(table.columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("value")) for i, c in enumerate(table.columns)])).alias("x")).select("x.*")


def mean_over_folds(importances: DataFrame, top: int = 30) -> DataFrame:
    return importances.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(df: DataFrame, key: str, columns: list[str], y: str, predict: Callable[[DataFrame], DataFrame], repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std): how much the mean absolute error rises when a column is shuffled.

    ``predict`` adds ``prediction``; ``key`` names a row, and rows of one key stand by their values. In each repeat rows stand in the order of a seeded md5 of the
    key, and values move by one place within the rows of the same leading hex digits, as many as leave at most some
    BLOCK_ROWS of them: so no window holds all rows, and one pass of it serves all columns. Each repeat shuffles rows
    without their key, by the first MOVED_BYTES of the md5 (of n rows two have equal ones with a chance of n * n / 2**97);
    rows are stored in the order of their values, so those that go to one place compress well. ``df`` should have no
    columns but those that ``predict`` reads.
    """
    from pyspark.sql import Window

    error = lambda of: F.avg(F.abs(F.col(of) - F.col(y)))
    df = checkpointed(df.sortWithinPartitions(*columns, y))
    base, n = predict(df).agg(error("prediction"), F.count("*")).first()
    digits = max(0, math.ceil(math.log(max(1, n) / BLOCK_ROWS, 16)))
    block = F.substring(F.hex(F.substring("_h", 1, (digits + 1) // 2)), 1, digits)
    order = Window.partitionBy("_block").orderBy("_h", *columns)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rises = []
    for r in range(repeats):
        h = F.unhex(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed + r}"))))
        dealt = df.withColumn("_h", F.substring(h, 1, MOVED_BYTES)).repartition(block).withColumn("_block", block)
        rows = dealt.select("*", *[F.coalesce(F.lag(c).over(order), F.last(c).over(whole)).alias(f"_moved{i}") for i, c in enumerate(columns)])
        for i, c in enumerate(columns):
            tried = predict(rows.withColumn("_own", F.col(c)).withColumn(c, F.col(f"_moved{i}")))
            rows = tried.select(*[F.col("_own").alias(c) if x == c else F.col(x) for x in rows.columns], F.col("prediction").alias(f"_error{i}"))
        found = rows.agg(*[error(f"_error{i}") for i in range(len(columns))]).first()
        rises.append([x - base for x in found])
    out = []
    for i, c in enumerate(columns):
        mean = sum(x[i] for x in rises) / repeats
        out.append((c, float(mean), float((sum((x[i] - mean) ** 2 for x in rises) / repeats) ** 0.5)))
    return df.sparkSession.createDataFrame(out, "feature string, importance_mean double, importance_std double")
