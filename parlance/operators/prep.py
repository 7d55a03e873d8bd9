"""Preparation of feature columns: figures of all columns from one aggregation, used in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.stats import pearson
from parlance.operators.ranks import exact_medians


def figures(df: DataFrame, columns: list[str], make) -> list:
    """``make(column)`` for each column, as values: one row to the driver, whatever the table's size."""
    return list(df.agg(*[make(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()) if columns else []


def medians(train: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians, the mean of the middle two where there is none."""
    return exact_medians(train, columns)


def imputed(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in values.items()})


def _scaled(df: DataFrame, means: dict, deviations: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(means[c])) / F.lit(deviations[c]) for c in means})


def standard_scaled(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """By the mean and the population deviation of ``train``; a deviation of 0 counts as 1."""
    m, s = figures(train, columns, F.avg), figures(train, columns, F.stddev_pop)
    return _scaled(df, dict(zip(columns, m, strict=True)), {c: x or 1.0 for c, x in zip(columns, s, strict=True)})


def control_stats(train: DataFrame, columns: list[str], is_control: Column) -> dict[str, tuple[float, float]]:
    """(mean, sample deviation) of control rows; 0 and null deviations count as 1."""
    only = train.filter(is_control)
    m, s = figures(only, columns, F.avg), figures(only, columns, F.stddev_samp)
    return {c: (a, b or 1.0) for c, a, b in zip(columns, m, s, strict=True)}


def control_scaled(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return _scaled(df, {c: a for c, (a, _) in stats.items()}, {c: b for c, (_, b) in stats.items()})


def column_report(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, null_share, variance, r, f) of each column from one pass: F statistic of a linear fit to ``target``."""
    y = F.col(target).cast("double")
    parts = {"null_share": lambda c: F.avg(c.isNull().cast("double")), "variance": lambda c: F.var_pop(c), "r": lambda c: pearson(c, y), "n": lambda c: F.count_if(c.isNotNull() & y.isNotNull())}
    row = df.agg(*[make(F.col(c).cast("double")).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, make in parts.items()])
    one = lambda i, c: F.struct(F.lit(c).alias("feature"), *[F.col(f"{name}_{i}").alias(name) for name in parts])
    rows = row.select(F.explode(F.array(*[one(i, c) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    r2 = F.col("r") * F.col("r")
    return rows.withColumn("f", F.try_divide(r2 * (F.col("n") - 2), 1 - r2)).drop("n")


def null_filter(report: DataFrame, most: float = 0.30) -> DataFrame:
    return report.filter(F.col("null_share") < most)


def variance_filter(report: DataFrame, least: float = 0.01) -> DataFrame:
    return report.filter(F.col("variance") > least)


def top_by_f(report: DataFrame, k: int = 80) -> DataFrame:
    return report.filter("f is not null").orderBy(F.desc("f"), "feature").limit(k)
