"""The additive and the kernel model as estimators, for pipelines, searches and saving like the native ones.

A fitted model is a text in a parameter, so that saving and loading parameters saves and loads the model.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.additive import Additive, fit_additive
from parlance.operators.kernel import KernelMachine, fit_kernel_machine


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _Fitted(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    state = _param("state", "the fitted model, as text", TypeConverters.toString)

    def _of(self, estimator: _Fitting, text: str) -> _Fitted:
        return self._set(state=text, featuresCol=estimator.getFeaturesCol(), predictionCol=estimator.getPredictionCol())


class _Fitting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    def setParams(self, **values):
        return self._set(**values)


class AdditiveModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        model = Additive.of_text(self.getOrDefault(self.state))
        x = vector_to_array(F.col(self.getFeaturesCol()))
        wide = df.withColumns({c: F.nanvl(x[i], F.lit(None).cast("double")) for i, c in enumerate(model.columns)})
        return model.predicted(wide, self.getPredictionCol()).drop(*model.columns)


class AdditiveRegressor(_Fitting):
    """Boosted step functions of single features and of pairs; see ``additive.fit_additive``."""

    maxBins = _param("maxBins", "bins of a feature", TypeConverters.toInt)
    maxInteractionBins = _param("maxInteractionBins", "bins of a feature in pairs", TypeConverters.toInt)
    interactions = _param("interactions", "pairs", TypeConverters.toInt)
    stepSize = _param("stepSize", "learning rate", TypeConverters.toFloat)
    minInstancesPerNode = _param("minInstancesPerNode", "rows of an interval, at least", TypeConverters.toInt)
    maxIter = _param("maxIter", "rounds", TypeConverters.toInt)

    def __init__(self, **values):
        super().__init__()
        self._setDefault(maxBins=128, maxInteractionBins=16, interactions=0, stepSize=0.1, minInstancesPerNode=2, maxIter=50)
        self._set(**values)

    def _fit(self, df: DataFrame) -> AdditiveModel:
        of = self.getOrDefault
        x = vector_to_array(F.col(self.getFeaturesCol()))
        first = df.select(F.size(x)).first()
        names = [f"_x{i}" for i in range(first[0] if first else 0)]
        rows = df.select(F.col(self.getLabelCol()).alias("_y"), *[F.nanvl(x[i], F.lit(None).cast("double")).alias(c) for i, c in enumerate(names)])
        model = fit_additive(rows, names, "_y", of(self.maxBins), of(self.maxIter), of(self.stepSize), 3, of(self.minInstancesPerNode), of(self.interactions), of(self.maxInteractionBins))
        return AdditiveModel()._of(self, model.text())


class KernelModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        model = KernelMachine.of_text(self.getOrDefault(self.state))
        return model.predicted(df, vector_to_array(F.col(self.getFeaturesCol())), self.getPredictionCol())


class KernelRegressor(_Fitting):
    """Epsilon-insensitive regression with a Gaussian kernel; see ``kernel.fit_kernel_machine``."""

    C = _param("C", "weight of the errors", TypeConverters.toFloat)
    epsilon = _param("epsilon", "errors up to so much do not count", TypeConverters.toFloat)
    gamma = _param("gamma", "one over the square of the kernel's width; 0: one over the number of features", TypeConverters.toFloat)
    dims = _param("dims", "random features", TypeConverters.toInt)
    tol = _param("tol", "least fall of the objective in a round, as a share of it", TypeConverters.toFloat)

    def __init__(self, **values):
        super().__init__()
        self._setDefault(C=1.0, epsilon=0.1, gamma=0.0, dims=256, tol=1e-3, seed=42)
        self._set(**values)

    def _fit(self, df: DataFrame) -> KernelModel:
        of = self.getOrDefault
        rows = df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).alias("y"))
        model = fit_kernel_machine(rows, F.col("x"), "y", of(self.C), of(self.epsilon), of(self.gamma) or None, of(self.dims), tolerance=of(self.tol), seed=self.getSeed())
        return KernelModel()._of(self, model.text())
