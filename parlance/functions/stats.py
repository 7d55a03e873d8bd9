"""Aggregates of distributions and paired values, with the small-sample and constant cases defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS13 = ("min", "p10", "q1", "median", "q3", "p90", "max", "mean", "std", "skew", "kurt", "iqr", "mad")


def finite(x: Column) -> Column:
    """``x`` as a double, null where it is NaN or infinite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def skew(x: Column) -> Column:
    """Bias-corrected skewness; null for fewer than 3 values or equal ones."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than 4 values or equal ones."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def _quantiles(x: Column, at: list[float]) -> Column:
    return F.percentile(x, F.array(*map(F.lit, at)))


def summarise(df: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    """The 13 statistics of ``value`` in each group: columns ``{prefix}{name}``; non-finite values are ignored.

    Equal values of a group are counted first, and two aggregations read the counts: the second has the distances from
    the group's mean and median. A group without finite values has nulls; one value has std 0.
    """
    x, n = F.col("_x"), F.col("_n")
    counted = df.select(*keys, finite(F.col(value)).alias("_x")).groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    held = F.sum(F.when(x.isNotNull(), n))
    q = F.percentile(x, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))), n)
    one = counted.groupBy(*keys).agg(F.min(x).alias("min"), q.alias("q"), F.max(x).alias("max"), (F.sum(x * n) / held).alias("mean"), F.coalesce(held, F.lit(0)).cast("double").alias("_c"))
    one = one.select("*", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("p10", "q1", "median", "q3", "p90"))], (F.get("q", F.lit(3)) - F.get("q", F.lit(1))).alias("iqr"))
    joined = lambda left, right: left.alias("a").join(right.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    off = x - F.col("b.mean")
    far = joined(counted, one).select(*[F.col(f"a.{k}").alias(k) for k in keys], n, F.abs(x - F.col("b.median")).alias("far"), *[(n * F.pow(off, F.lit(float(i)))).alias(f"m{i}") for i in (2, 3, 4)])
    two = far.groupBy(*keys).agg(F.percentile("far", F.lit(0.5), n).alias("mad"), *[F.sum(f"m{i}").alias(f"m{i}") for i in (2, 3, 4)])
    c, m2 = F.col("a._c"), F.col("b.m2")
    spread = F.col("a.min") < F.col("a.max")
    figures = {
        "mad": F.col("b.mad"), "std": F.when(spread, F.sqrt(m2 / (c - 1))).when(c > 0, 0.0),
        "skew": F.when(spread & (c > 2), F.sqrt(c) * F.col("b.m3") / F.pow(m2, F.lit(1.5)) * F.sqrt(c * (c - 1)) / (c - 2)),
        "kurt": F.when(spread & (c > 3), (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * (c * F.col("b.m4") / (m2 * m2) - 3) + 6)),
    }
    return joined(one, two).select(*[F.col(f"a.{k}").alias(k) for k in keys], *[figures.get(name, F.col(f"a.{name}")).alias(prefix + name) for name in STATS13])


def deviations(df: DataFrame, keys: list[str], value: str, medians: DataFrame) -> DataFrame:
    """(keys, mad): the median distance of ``value`` from the group's ``median``."""
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    far = df.alias("x").join(medians.alias("m"), on).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.abs(F.col(f"x.{value}") - F.col("m.median")).alias("far"))
    return far.groupBy(*keys).agg(F.percentile("far", F.lit(0.5)).alias("mad"))


SEQUENCE_STATS = ("mean", "std", "min", "q1", "median", "q3", "max", "iqr", "p1", "p99", "range_p1_p99", "skewness", "kurtosis")


def sequence_stats(x: Column, prefix: str = "") -> list[Column]:
    """13 statistics for one aggregation: population std, outer percentiles; skewness and kurtosis 0 where all values are equal."""
    q = _quantiles(x, [0.01, 0.25, 0.5, 0.75, 0.99])
    at = lambda i: F.get(q, F.lit(i))
    flat = F.stddev_samp(x) == 0
    values = (F.mean(x), F.stddev_pop(x), F.min(x), at(1), at(2), at(3), F.max(x), at(3) - at(1), at(0), at(4), at(4) - at(0), F.when(flat, 0.0).otherwise(skew(x)), F.when(flat, 0.0).otherwise(kurt(x)))
    return [v.alias(prefix + n) for n, v in zip(SEQUENCE_STATS, values, strict=True)]


def pearson(x: Column, y: Column) -> Column:
    """Correlation of pairs without nulls; null where either side is constant or there are fewer than two."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def safe_div(n: Column, d: Column) -> Column:
    """n / d, null where d is 0 or less."""
    return F.when(d > 0, n / d)


def floored_ratio(n: Column, d: Column) -> Column:
    return n / F.greatest(d, F.lit(1e-6))


def minutes(seconds: Column) -> Column:
    return F.greatest(seconds / 60, F.lit(1e-6))
