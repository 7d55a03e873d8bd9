"""Records of runs, and questions to them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of a record.
RECORD = "logged_at timestamp, config map<string,string>, results map<string,double>, params map<string,string>"
#: Metrics of which less is better; of all others more is.
LESS = ("mae", "rmse", "error", "time")


def record(spark: SparkSession, config: dict, results: dict[str, float], params: dict | None = None, at: datetime | None = None) -> DataFrame:
    """One row of a run: its configuration, figures and parameters, whose model prefixes (``model__``) are taken off."""
    stripped = {str(k).rpartition("__")[2]: str(v) for k, v in (params or {}).items()}
    row = (at or datetime.now(), {str(k): str(v) for k, v in config.items()}, {str(k): float(v) for k, v in results.items() if v is not None}, stripped)
    return spark.createDataFrame([row], RECORD)


def less_is_better(metric: str) -> bool:
    return any(x in metric.lower() for x in LESS)


def best_run(history: DataFrame, metric: str, key: str, minimise: bool | None = None, where: dict[str, str] | None = None) -> DataFrame:
    """The row of the best ``metric`` among those that match ``where``; of equal ones the least ``key``."""
    for column, value in (where or {}).items():
        history = history.filter(F.col(column) == value)
    first = F.asc(metric) if (less_is_better(metric) if minimise is None else minimise) else F.desc(metric)
    return history.filter(F.col(metric).isNotNull()).orderBy(first, key).limit(1)


def summary(history: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) of every value of every dimension, from one aggregation."""
    long = history.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")).select("x.*")
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def compare(history: DataFrame, by: str, metric: str, seconds: str | None = None) -> DataFrame:
    """n, mean, sample deviation and ends of ``metric`` by value of ``by``, and the mean time."""
    extra = [F.avg(seconds).alias("mean_time")] if seconds else []
    return history.groupBy(by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"), *extra)


def top_runs(history: DataFrame, metric: str, key: str, n: int, types: list[str] | None = None, type_col: str = "model_type", minimise: bool = True) -> DataFrame:
    """The best ``n`` runs with weights by the inverse of the metric, summing to 1."""
    rows = history.filter(F.col(metric).isNotNull() & (F.col(metric) > 0))
    if types:
        rows = rows.filter(F.col(type_col).isin(*types))
    best = rows.orderBy(F.asc(metric) if minimise else F.desc(metric), key).limit(n)
    whole = best.agg(F.sum(1 / F.col(metric)).alias("_w"))
    return best.crossJoin(F.broadcast(whole)).withColumn("weight", 1 / F.col(metric) / F.col("_w")).drop("_w")


def sweep(settings: list[dict], run, metric: str) -> DataFrame:
    """The metric rows of ``run(setting)`` for all settings, with ``setting``, the best first."""
    out: DataFrame | None = None
    for i, s in enumerate(settings):
        row = run(s).withColumn("setting", F.lit(i))
        out = row if out is None else out.unionByName(row)
    order: Column = F.asc(metric) if less_is_better(metric) else F.desc(metric)
    return out.orderBy(order, "setting")
