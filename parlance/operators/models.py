"""Regressors by name, searches, out-of-fold predictions, calibration, saved models."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.estimators import AdditiveRegressor, KernelRegressor
from parlance.operators.isotonic import isotonic_blocks, isotonic_values
from parlance.shared import checkpointed

#: name -> (estimator, {parameter: values}). ``svr`` is a kernel machine and ``ebm`` a boosted additive model with pairs, both
#: fitted by aggregates; the boosters share one native estimator and so have other numbers than the originals.
REGISTRY: dict[str, tuple[Callable[[], Estimator], dict[str, list]]] = {
    "elasticnet": (lambda: LinearRegression(), {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]}),
    "ridge": (lambda: LinearRegression(elasticNetParam=0.0), {"regParam": [0.1, 1.0, 10.0]}),
    "svr": (lambda: KernelRegressor(), {"C": [0.1, 1.0, 10.0, 100.0], "epsilon": [0.01, 0.1, 0.5, 1.0], "gamma": [0.0, 0.001, 0.01]}),
    "rf": (lambda: RandomForestRegressor(seed=42), {"numTrees": [100, 200], "maxDepth": [5, 10]}),
    "lgbm": (lambda: GBTRegressor(seed=42), {"maxIter": [50, 100], "maxDepth": [4, 6], "stepSize": [0.05, 0.1]}),
    "xgb": (lambda: GBTRegressor(seed=42, subsamplingRate=0.8), {"maxIter": [50, 100], "maxDepth": [3, 5], "stepSize": [0.05, 0.1]}),
    "catboost": (lambda: GBTRegressor(seed=42, featureSubsetStrategy="onethird"), {"maxIter": [50, 100], "maxDepth": [4, 6]}),
    "ebm": (lambda: AdditiveRegressor(interactions=10), {"maxBins": [128, 256], "maxInteractionBins": [16, 32], "interactions": [5, 10, 20], "stepSize": [0.01, 0.05], "minInstancesPerNode": [2, 5]}),
}

#: Ranges of the published searches, under the names of the native parameters, as far as there are such:
#: ("log" or "uniform", least, most), ("step", least, most, step), ("share", least, most) as text, ("of", values). A
#: ``gamma`` of 0 is one over the number of features.
SPACES: dict[str, dict[str, tuple]] = {
    "svr": {"C": ("log", 0.1, 100.0), "epsilon": ("log", 0.01, 1.0), "gamma": ("of", (0.0,))},
    "lgbm": {"maxIter": ("step", 500, 2000, 500), "stepSize": ("log", 0.01, 0.2), "maxDepth": ("step", 3, 20, 1), "minInstancesPerNode": ("step", 10, 100, 1), "subsamplingRate": ("uniform", 0.6, 1.0), "featureSubsetStrategy": ("share", 0.6, 1.0)},
    "xgb": {"maxIter": ("step", 500, 2000, 500), "stepSize": ("log", 0.01, 0.2), "maxDepth": ("step", 3, 15, 1), "minInstancesPerNode": ("step", 1, 10, 1), "subsamplingRate": ("uniform", 0.6, 1.0), "featureSubsetStrategy": ("share", 0.6, 1.0)},
    "catboost": {"maxIter": ("step", 500, 2000, 500), "stepSize": ("log", 0.01, 0.2), "maxDepth": ("step", 4, 10, 1)},
    "rf": {"numTrees": ("step", 100, 500, 100), "maxDepth": ("step", 5, 30, 1), "minInstancesPerNode": ("step", 1, 10, 1), "featureSubsetStrategy": ("of", ("sqrt", "log2"))},
    "elasticnet": {"regParam": ("log", 0.001, 10.0), "elasticNetParam": ("uniform", 0.1, 0.9)},
    "ebm": {"maxBins": ("step", 128, 512, 128), "maxInteractionBins": ("step", 16, 64, 16), "interactions": ("step", 5, 30, 1), "stepSize": ("log", 0.01, 0.1), "minInstancesPerNode": ("step", 2, 10, 1)},
}


def drawn(name: str, n: int, seed: int = 42) -> list[dict]:
    """``n`` points of the model's published ranges; the same for the same seed."""
    rng = random.Random(seed)
    draw = {
        "log": lambda a, b: math.exp(rng.uniform(math.log(a), math.log(b))),
        "uniform": rng.uniform,
        "step": lambda a, b, step: rng.randrange(a, b + 1, step),
        "share": lambda a, b: str(round(rng.uniform(a, b), 3)),
        "of": rng.choice,
    }
    if name not in SPACES:
        raise ValueError(f"no published ranges for {name}; there are some for {', '.join(sorted(SPACES))}")
    return [{p: draw[kind](*of) for p, (kind, *of) in SPACES[name].items()} for _ in range(n)]


def estimator(name: str) -> tuple[Estimator, dict[str, list]]:
    if name not in REGISTRY:
        raise ValueError(f"no model {name}; there are {', '.join(sorted(REGISTRY))}")
    make, grid = REGISTRY[name]
    return make(), grid


def pipeline(columns: list[str], model: Estimator, target: str, scale: bool = True) -> Pipeline:
    """Impute by medians, assemble, scale, fit."""
    filled = [f"{c}_filled" for c in columns]
    model = model.copy({model.getParam("labelCol"): target, model.getParam("featuresCol"): "features"})
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=filled, relativeError=0.001), VectorAssembler(inputCols=filled, outputCol="raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, model])


def _grid(model: Estimator, values: dict[str, list]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(model.getParam(name), options)
    return builder.build()


def search(df: DataFrame, columns: list[str], target: str, name: str, folds: int = 5, fold_col: str | None = None, draws: int | None = None, parallelism: int = 4, seed: int = 42, published: bool = False) -> CrossValidatorModel:
    """The best of the model's grid by cross-validated mean absolute error, fitted again on all rows; of ``draws`` points drawn from the grid if given.

    With ``published``, of ``draws`` points (50 if not given) drawn from the model's published ranges.
    """
    model, values = estimator(name)
    pipe = pipeline(columns, model, target)
    last = pipe.getStages()[-1]
    if published:
        grid = [{last.getParam(p): v for p, v in point.items()} for point in drawn(name, draws or 50, seed)]
    else:
        grid = _grid(last, values)
        if draws is not None:
            grid = random.Random(seed).sample(grid, min(draws, len(grid)))
    judge = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="mae")
    options = {"foldCol": fold_col} if fold_col else {"seed": seed}
    return CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, parallelism=parallelism, **options).fit(df)


def out_of_fold(df: DataFrame, columns: list[str], target: str, name: str, k: int, fold: str = "fold", params: dict | None = None) -> DataFrame:
    """Rows with a fold, each with ``predicted`` by a model that has not seen its fold; rows without one only train.

    ``df`` is stored first, as every fold's steps read it; it should have no columns but those that are used.
    """
    out, df = None, checkpointed(df)
    for i in range(k):
        model, _ = estimator(name)
        model.setParams(**(params or {}))
        fitted = pipeline(columns, model, target).fit(df.filter((F.col(fold) != i) | F.col(fold).isNull()))
        part = fitted.transform(df.filter(F.col(fold) == i)).select(*df.columns, F.col("prediction").alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(df: DataFrame, y: str = "actual", p: str = "predicted", out: str = "calibrated", train: DataFrame | None = None) -> DataFrame:
    """``df`` with an isotonic fit of ``y`` on ``p``, kept within 0 and 100 and at its ends beyond them."""
    return calibrated(df, isotonic_blocks(train if train is not None else df, y, p), p, out)


def calibrated(df: DataFrame, blocks: DataFrame, p: str = "predicted", out: str = "calibrated") -> DataFrame:
    """``df`` with the value of its block of an isotonic fit, within 0 and 100; null where ``p`` is."""
    scored = isotonic_values(df, blocks, p, out)
    return scored.withColumn(out, F.when(F.col(out).isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(out)))))


def score_external(fitted: PipelineModel, df: DataFrame, language: str, languages: list[str], blocks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Predictions of the final model for each external language; with ``blocks`` of an isotonic fit, also ``calibrated``, within 0 and 100."""
    if blocks is None:
        return {x: fitted.transform(df.filter(F.col(language) == x)) for x in languages}
    blocks = checkpointed(blocks)
    return {x: calibrated(fitted.transform(df.filter(F.col(language) == x)), blocks, "prediction") for x in languages}


def save(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load_all(paths: list[str]) -> list[PipelineModel]:
    return [PipelineModel.load(p) for p in paths]
