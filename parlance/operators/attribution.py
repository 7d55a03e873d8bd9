"""Exact attributions (Shapley values) of predictions to features, for linear models and ensembles of trees.

A tree's expectation when only some features are known splits into its leaves: each is a product over the features of its
path, 1 or 0 where the row's value is known to fit the path, and else the share of training rows that go that way. The
Shapley values of such a product depend on which of the path's features fit only, so each leaf has one table of 2**features
rows, made once from the model, and a row of data looks up one entry for each leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Features of a path, at most: a leaf's table has two to that power rows.
PATH_FEATURES = 16
NODES = "tree int, id int, feature int, threshold double, left int, right int, value double, cover double, weight double"


def linear_attributions(df: DataFrame, weights: dict[str, float], background: DataFrame | None = None, prefix: str = "phi_") -> DataFrame:
    """``df`` with ``phi_{feature}``: the weight times the value's distance from the mean of ``background``, by default ``df``. Nulls have none."""
    names = list(weights)
    means = (df if background is None else background).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)])
    joined = df.crossJoin(F.broadcast(means))
    return joined.select(*df.columns, *[(F.lit(float(weights[c])) * (F.col(c) - F.col(f"_m{i}"))).alias(f"{prefix}{c}") for i, c in enumerate(names)])


def fitted_nodes(spark: SparkSession, model: Model) -> DataFrame:
    """NODES of a fitted native tree, forest or booster: a row goes left where its feature is at most the threshold.

    ``value`` is a node's prediction, ``cover`` its share of training rows in rows, ``weight`` that of its tree. Splits
    by categories are an error.
    """
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    weights = [1.0 / len(trees)] * len(trees) if "Forest" in type(model).__name__ else list(getattr(model, "treeWeights", [1.0]))
    rows = []
    for t, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        todo, n = [(tree._java_obj.rootNode(), 0)], 1
        while todo:
            node, at = todo.pop()
            cover = float(node.impurityStats().count())
            if node.subtreeDepth() == 0:
                rows.append((t, at, None, None, None, None, float(node.prediction()), cover, float(weight)))
                continue
            split = node.split()
            if "Continuous" not in split.getClass().getName():
                raise ValueError("splits by categories have no threshold")
            rows.append((t, at, int(split.featureIndex()), float(split.threshold()), n, n + 1, float(node.prediction()), cover, float(weight)))
            todo += [(node.leftChild(), n), (node.rightChild(), n + 1)]
            n += 2
    return spark.createDataFrame(rows, NODES)


def counted_cover(nodes: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """``nodes`` with the cover and, at the leaves, nothing else changed: rows of ``df`` that reach each node, counted by one aggregate."""
    found = nodes.collect()
    of = {(r["tree"], r["id"]): r for r in found}
    reached: dict[tuple[int, int], Column] = {}

    def walk(tree: int, at: int, here: Column) -> None:
        reached[tree, at] = here
        node = of[tree, at]
        if node["feature"] is not None:
            left = F.coalesce(F.col(columns[node["feature"]]) <= node["threshold"], F.lit(False))
            walk(tree, node["left"], here & left)
            walk(tree, node["right"], here & ~left)

    for tree in sorted({r["tree"] for r in found}):
        walk(tree, 0, F.lit(True))
    keys = list(reached)
    counts = dict(zip(keys, df.agg(*[F.count_if(reached[k]) for k in keys]).first(), strict=True))
    rows = [(*tuple(r)[:7], float(counts[r["tree"], r["id"]]), r["weight"]) for r in found]
    return nodes.sparkSession.createDataFrame(rows, NODES)


@dataclass
class Leaf:
    """``features`` of the path with the bounds low < x <= high; ``table`` has by fitting features, as bits, the values of each."""

    features: list[int]
    low: list[float]
    high: list[float]
    nulls: list[bool]
    table: np.ndarray
    mean: float


def leaf_table(shares: list[float], value: float) -> np.ndarray:
    """[bits, j]: Shapley value of feature ``j`` in the game value * product of (fits ? 1 : 0 if known, else its share)."""
    d = len(shares)
    out = np.zeros((1 << d, d))
    size = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]
    for bits in range(1 << d):
        fits = [bits >> j & 1 for j in range(d)]
        for j in range(d):
            sums = np.array([1.0])  # over the others: by how many are known, the sum of the products
            for i in range(d):
                if i != j:
                    sums = np.append(sums * shares[i], 0.0) + np.append(0.0, sums * fits[i])
            out[bits, j] = value * (fits[j] - shares[j]) * float(sums @ size[: len(sums)])
    return out


def leaves_of(nodes: DataFrame) -> list[Leaf]:
    """The leaves of all trees, with tables; the model comes to the driver, not data. A null goes right, as a value above all."""
    found = nodes.collect()
    of = {(r["tree"], r["id"]): r for r in found}
    out = []
    for tree in sorted({r["tree"] for r in found}):
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            node = of[tree, at]
            if node["feature"] is None:
                names = sorted(path)
                if len(names) > PATH_FEATURES:
                    raise ValueError(f"a path of {len(names)} features; {PATH_FEATURES} at most")
                low, high, share = zip(*(path[f] for f in names), strict=True) if names else ((), (), ())
                value = node["value"] * node["weight"]
                out.append(Leaf(names, list(low), list(high), [h == np.inf for h in high], leaf_table(list(share), value), value * float(np.prod(share))))
                continue
            f = node["feature"]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, lo, hi in ((node["left"], low, min(high, node["threshold"])), (node["right"], max(low, node["threshold"]), high)):
                part = of[tree, child]["cover"] / node["cover"] if node["cover"] else 0.0
                todo.append((child, path | {f: (lo, hi, share * part)}))
    return out


def _attributed(leaves: list[Leaf], columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(columns)])
            out, mean = np.zeros((len(x), columns)), 0.0
            missing = np.isnan(x)
            for leaf in leaves:
                mean += leaf.mean
                bits = np.zeros(len(x), np.int64)
                for j, f in enumerate(leaf.features):
                    fits = np.where(missing[:, f], leaf.nulls[j], (x[:, f] > leaf.low[j]) & (x[:, f] <= leaf.high[j]))
                    bits |= fits.astype(np.int64) << j
                if leaf.features:
                    out[:, leaf.features] += leaf.table[bits]
            phi = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * columns, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), phi, pa.array(np.full(len(x), mean))], names=["row", "phi", "base"])

    return run


def tree_attributions(df: DataFrame, columns: list[str], nodes: DataFrame, prefix: str = "phi_") -> DataFrame:
    """``df`` with ``base``, the model's mean by its covers, and ``phi_{column}`` for each: exact Shapley values that add up to prediction - base.

    ``nodes`` (NODES) number features as ``columns`` do; a feature may be on a path more than once. Nulls and NaN go
    right, as a value above all. Each row is worked on where it lies, with a table of the model's leaves: no shuffle.
    """
    row = df.select(F.struct(*df.columns).alias("row"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    kind = row.schema["row"].dataType.simpleString()
    found = row.mapInArrow(_attributed(leaves_of(nodes), len(columns)), f"row {kind}, phi array<double>, base double")
    return found.select("row.*", "base", *[F.col("phi")[i].alias(f"{prefix}{c}") for i, c in enumerate(columns)])


def model_attributions(df: DataFrame, model: Model, features: str, names: list[str], prefix: str = "phi_") -> DataFrame:
    """tree_attributions of a fitted native model by its vector column ``features``, whose entries have ``names``."""
    x = vector_to_array(F.col(features))
    wide = df.withColumns({f"_f{i}": x[i] for i in range(len(names))})
    found = tree_attributions(wide.drop(features), [f"_f{i}" for i in range(len(names))], fitted_nodes(df.sparkSession, model), prefix)
    return found.withColumnsRenamed({f"{prefix}_f{i}": f"{prefix}{c}" for i, c in enumerate(names)}).drop(*[f"_f{i}" for i in range(len(names))])
