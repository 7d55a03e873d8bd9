"""Support vector regression with a Gaussian kernel, by random Fourier features.

The kernel of two rows is the product of their features' cosines and sines along random directions, so the kernel
machine is a linear one over them. Its loss counts errors beyond ``epsilon`` by their size. Each round bounds it from
above by squares about the errors of the round before, touching there, and solves for these: the matrix and the right
side are one aggregate over the rows, so a round is one pass, and the loss never rises.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from parlance.shared import checkpointed

#: Rows of a block of features in a task's memory.
BLOCK_ROWS = 4_096


def directions(columns: int, dims: int, gamma: float, seed: int) -> np.ndarray:
    """``dims`` // 2 random directions whose cosines and sines give exp(-gamma * squared distance); in blocks they are orthogonal, which lowers the error."""
    rng, half = np.random.default_rng(seed), dims // 2
    blocks = []
    while sum(map(len, blocks)) < half:
        q, _ = np.linalg.qr(rng.standard_normal((columns, columns)))
        blocks.append(q * np.sqrt(rng.chisquare(columns, columns))[:, None])
    return np.concatenate(blocks)[:half].T * np.sqrt(2 * gamma)


def mapped(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    return np.concatenate([np.cos(z), np.sin(z)], axis=1) / np.sqrt(w.shape[1])


@dataclass
class KernelMachine:
    gamma: float
    dims: int
    seed: int
    columns: int
    weights: np.ndarray  # the last is the intercept

    def values(self, x: np.ndarray) -> np.ndarray:
        return mapped(x, directions(self.columns, self.dims, self.gamma, self.seed)) @ self.weights[:-1] + self.weights[-1]

    def predicted(self, df: DataFrame, features: Column, out: str = "prediction") -> DataFrame:
        """``df`` with ``out``, from an array column; null where a feature is null."""
        own = self

        @pandas_udf("double")
        def predict(x):
            import pandas as pd

            held = x.notna()
            found = np.full(len(x), np.nan)
            if held.any():
                found[held] = own.values(np.stack(x[held].to_numpy()).astype(float))
            return pd.Series(found)

        whole = F.when(~F.exists(features, lambda v: v.isNull()), features)
        return df.withColumn(out, F.nanvl(predict(whole), F.lit(None).cast("double")))

    def text(self) -> str:
        return json.dumps([self.gamma, self.dims, self.seed, self.columns, self.weights.tolist()])

    @staticmethod
    def of_text(text: str) -> KernelMachine:
        *rest, weights = json.loads(text)
        return KernelMachine(*rest, np.array(weights))


def bound_of(error: np.ndarray, epsilon: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight, shift) of the squares weight * (error - shift)**2 / 2 that bound max(0, |error| - epsilon), up to a constant, and touch it here."""
    beyond = np.abs(error) - epsilon
    out = beyond > 0
    weight = np.where(out, 1 / np.maximum(beyond, least), 1 / np.maximum(-2 * beyond, least))
    return weight, np.where(out, np.sign(error) * epsilon, error)


def _sums(w: np.ndarray, weights: np.ndarray | None, epsilon: float, least: float):
    """Entries of the upper triangle of the weighted products of (features, 1, aim), and the loss so far, from rows (x, y, times)."""
    n = 2 * w.shape[1] + 2
    upper = np.triu_indices(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros((n, n)), 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x, y, times = part.column(0), part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                z = np.concatenate([mapped(x, w), np.ones((len(y), 1)), y[:, None]], axis=1)
                weight = times.astype(float)
                if weights is not None:
                    error = y - z[:, :-1] @ weights
                    loss += float(weight @ np.maximum(0, np.abs(error) - epsilon))
                    bound, shift = bound_of(error, epsilon, least)
                    z[:, -1] = y - shift
                    weight *= bound
                z *= np.sqrt(weight)[:, None]
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]) + 1), pa.int32()), pa.array(np.append(total[upper], loss))], names=["at", "v"])

    return run


def fit_kernel_machine(df: DataFrame, features: Column, target: str, c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, dims: int = 256, rounds: int = 40, tolerance: float = 1e-4, seed: int = 42) -> KernelMachine:
    """The machine of least |weights|**2 / 2 + ``c`` * sum of max(0, |error| - ``epsilon``) over ``dims`` random features.

    ``features`` is an array column of scaled numbers; ``gamma`` is by default one over their number. Rows with a null in a
    feature or the target do not count; without rows all weights are 0. Equal rows are counted once and stored, and every
    round reads these counts. Each round brings dims**2 / 2 sums to the driver, and ends by a fall of the objective below ``tolerance`` of it.
    """
    rows = df.select(features.cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).filter(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    rows = checkpointed(rows.groupBy("x", "y").agg(F.count("*").alias("times")))
    first = rows.select(F.size("x")).first()
    if first is None:
        return KernelMachine(gamma or 1.0, 2, seed, 1, np.zeros(3))
    columns, half = first[0], dims // 2
    gamma = gamma or 1.0 / columns
    w = directions(columns, dims, gamma, seed)
    n, weights, before = 2 * half + 2, None, np.inf
    middle = F.lit(rows.agg(F.sum(F.col("times") * F.col("y")) / F.sum("times")).first()[0])
    scale = 1e-6 * (rows.agg(F.sqrt(F.sum(F.col("times") * (F.col("y") - middle) ** 2) / F.sum("times"))).first()[0] or 1.0)
    for _ in range(rounds):
        entries = rows.mapInArrow(_sums(w, weights, epsilon, scale), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow().sort_by("at")["v"].to_numpy()
        g = np.zeros((n, n))
        g[np.triu_indices(n)] = entries[:-1]
        g = g + np.triu(g, 1).T
        if weights is not None:
            now = c * entries[-1] + float(weights[:-1] @ weights[:-1]) / 2
            if before - now <= tolerance * now:
                break
            before = now
        a, b = c * g[:-1, :-1], c * g[:-1, -1]
        a[np.diag_indices(n - 2)] += 1.0  # the intercept, which is last, is not held down
        a[-1, -1] += 1e-12
        weights = np.linalg.solve(a, b)
    return KernelMachine(float(gamma), 2 * half, seed, columns, weights)
