"""Evaluation of predicted scores: metrics, classes, error groups and reports.

``actual`` and ``predicted`` are columns; rows with a null in either are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.scores import SEVERITIES, severity, to_score
from parlance.functions.stats import pearson
from parlance.operators.ranks import average_ranks

ERROR_CUT = 5.316


def metrics(y: Column, p: Column) -> list[Column]:
    """n, mae, rmse, r2, r; r2 and r are null where they are not defined."""
    e = p - y
    return [
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(F.when(e.isNotNull(), y)) * F.count(e))).alias("r2"), pearson(y, p).alias("r"),
    ]


def accuracies(y: Column, p: Column, within: tuple[int, ...] = (1, 5, 10)) -> list[Column]:
    """Shares of rounded predictions at most so far off, and exact."""
    off = F.abs(to_score(p) - y)
    return [*[F.avg((off <= k).cast("double")).alias(f"acc_{k}") for k in within], F.avg((off == 0).cast("double")).alias("acc_exact")]


def severity_accuracy(y: Column, p: Column) -> Column:
    return F.avg((severity(y) == severity(to_score(p))).cast("double")).alias("severity_accuracy")


def report(df: DataFrame, y: str = "actual", p: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """All of the above by group, or in one row."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    figures = [*metrics(F.col(y), F.col(p)), *accuracies(F.col(y), F.col(p)), severity_accuracy(F.col(y), F.col(p))]
    return rows.groupBy(*by).agg(*figures) if by else rows.agg(*figures)


def spearman(df: DataFrame, y: str = "actual", p: str = "predicted") -> DataFrame:
    """(rho): correlation of average ranks."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(y, p)
    ranked = average_ranks(average_ranks(rows, y, "_ry"), p, "_rp")
    return ranked.agg(pearson(F.col("_ry"), F.col("_rp")).alias("rho"))


def predictions(df: DataFrame, key: list[str], y: str = "actual", p: str = "predicted") -> DataFrame:
    """The prediction table: rounded score, classes, signed and absolute errors."""
    a, b = F.col(y), F.col(p)
    whole = to_score(b)
    return df.select(
        *key, a.alias("qa_real"), b.alias("qa_pred_cont"), whole.cast("int").alias("qa_pred_int"), severity(a).alias("severity_real"), severity(whole).alias("severity_pred"),
        (b - a).alias("error_cont"), (whole - a).alias("error_int"), F.abs(whole - a).alias("abs_error_int"),
    )


def confusion(df: DataFrame, actual: str, predicted: str, labels: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """(actual, predicted, n, share) of all pairs of ``labels``, also those that do not occur; share is of the actual class."""
    spark = df.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "actual string")
    pairs = names.crossJoin(names.withColumnRenamed("actual", "predicted"))
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("c"))
    rows = pairs.join(F.broadcast(counts), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("c", F.lit(0)).alias("n"))
    sums = rows.groupBy("actual").agg(F.sum("n").alias("s"))
    return rows.join(sums, "actual").select("actual", "predicted", "n", F.coalesce(F.try_divide("n", "s"), F.lit(0.0)).alias("share"))


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each class of a confusion table, with accuracy, macro and weighted averages; 0 for division by zero."""
    cells = matrix.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
    )).alias("c")).select("c.*")
    by = cells.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by = by.withColumn("precision", zero(F.col("hit"), F.col("said"))).withColumn("recall", zero(F.col("hit"), F.col("support")))
    by = by.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    whole = by.agg(
        total.alias("support"), zero(F.sum("hit"), total).alias("accuracy"),
        *[F.avg(x).alias(f"m_{x}") for x in names], *[zero(F.sum(F.col(x) * F.col("support")), total).alias(f"w_{x}") for x in names],
    )
    rows = whole.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(x) for x in names], F.col("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{x}").alias(x) for x in names], F.col("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"w_{x}").alias(x) for x in names], F.col("support")),
    )).alias("r")).select("r.*")
    return by.select("label", *names, "support").unionByName(rows)


def error_groups(df: DataFrame, y: str = "actual", p: str = "predicted", cut: float = ERROR_CUT) -> DataFrame:
    """n, mean and population deviation of error and score of rows up to ``cut`` off and of those beyond."""
    e = F.abs(F.col(p) - F.col(y))
    rows = df.filter(e.isNotNull()).select(F.when(e <= cut, "low").otherwise("high").alias("error_group"), e.alias("_e"), F.col(y).alias("_y"))
    return rows.groupBy("error_group").agg(F.count("*").alias("n"), F.avg("_e").alias("mae_mean"), F.stddev_pop("_e").alias("mae_std"), F.avg("_y").alias("qa_mean"), F.stddev_pop("_y").alias("qa_std"))


def welch(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """(t, df) of the difference of two groups' means without equal variances."""
    w = lambda g: F.when(F.col(group) == g, F.col(value))
    row = df.agg(*[f(w(g)).alias(f"{n}{i}") for i, g in enumerate((first, second)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = F.try_divide("v0", "n0"), F.try_divide("v1", "n1")
    return row.select(F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(a + b)).alias("t"), F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n0") - 1) + F.try_divide(b * b, F.col("n1") - 1)).alias("df"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, n) of equal bins over the observed range; bins without rows are left out."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), width), F.lit(0.0))))
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def fold_summary(by_fold: DataFrame, metric: str = "mae") -> DataFrame:
    """Mean and sample deviation of a metric over folds, and the best fold."""
    return by_fold.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min_by("fold", F.struct(metric, "fold")).alias("best_fold"))


def improvement(df: DataFrame, y: str, models: list[str], ensemble: str, small: float = 0.05) -> DataFrame:
    """(best_single, ensemble, gain, gain_pct, verdict) of mean absolute errors."""
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col(y)))
    row = df.agg(*[mae(c).alias(f"_{i}") for i, c in enumerate(models)], mae(ensemble).alias("ensemble_mae"))
    best = F.least(*[F.col(f"_{i}") for i in range(len(models))]) if len(models) > 1 else F.col("_0")
    row = row.select(best.alias("best_single_mae"), "ensemble_mae").withColumn("gain", F.col("best_single_mae") - F.col("ensemble_mae"))
    verdict = F.when(F.col("gain") <= 0, "no gain").when(F.col("gain") < small, "small gain").otherwise("gain")
    return row.withColumn("gain_pct", F.try_divide(F.col("gain") * 100, "best_single_mae")).withColumn("verdict", verdict)


def against_baseline(metrics_row: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """Columns ``delta_{name}`` of the metrics less published ones."""
    return metrics_row.select("*", *[(F.col(k) - F.lit(v)).alias(f"delta_{k}") for k, v in baseline.items()])


def error_correlates(df: DataFrame, error: str, covariates: list[str], least: float = 0.15) -> DataFrame:
    """(covariate, r) with the absolute error, where abs(r) is over ``least``; nulls are left out pair by pair, in one pass."""
    row = df.agg(*[pearson(F.col(c), F.abs(F.col(error))).alias(f"_{i}") for i, c in enumerate(covariates)])
    rows = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(f"_{i}").alias("r")) for i, c in enumerate(covariates)])).alias("x")).select("x.*")
    return rows.filter(F.abs("r") > least)


def critical_cases(errors: DataFrame, error: str, data: DataFrame, key: list[str], over: float = 20.0) -> DataFrame:
    """Rows more than ``over`` off, the worst first, with the columns of ``data`` that they lack."""
    extra = data.drop(*[c for c in data.columns if c in errors.columns and c not in key])
    return errors.filter(F.abs(F.col(error)) > over).join(extra, key, "left").orderBy(F.desc(F.abs(F.col(error))), *key)


def bad_against_all(df: DataFrame, bad: Column, value: str) -> DataFrame:
    """Means of ``value`` over bad rows and over all, with a verdict."""
    row = df.agg(F.avg(F.when(bad, F.col(value))).alias("bad_mean"), F.avg(value).alias("all_mean"))
    return row.withColumn("verdict", F.when(F.col("bad_mean") < F.col("all_mean"), "bad cases are shorter").otherwise("bad cases are not shorter"))
