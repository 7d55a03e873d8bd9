"""Attributions against all subsets, and isotonic fits against plain pooling."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from parlance.operators import attribution, isotonic, models

NAMES = list("abcdef")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 6)), 2)
    y = x[:, 0] * 3 + (x[:, 1] > 0) * x[:, 2] * 4 + x[:, 3] ** 2 + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in NAMES) + ", y double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


def by_subsets(nodes, x):
    """Shapley values of the game 'expectation of the trees, unknown features by their covers'."""
    of = {(r["tree"], r["id"]): r for r in nodes}

    def value(tree, at, known):
        n = of[tree, at]
        if n["feature"] is None:
            return n["value"] * n["weight"]
        if n["feature"] in known:
            return value(tree, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], known)
        both = (n["left"], n["right"])
        return sum(value(tree, c, known) * of[tree, c]["cover"] for c in both) / n["cover"]

    game = {}
    for size in range(7):
        for s in combinations(range(6), size):
            game[frozenset(s)] = sum(value(t, 0, s) for t in {r["tree"] for r in nodes})
    phi = [sum(factorial(len(s)) * factorial(5 - len(s)) / 720 * (game[s | {j}] - v) for s, v in game.items() if j not in s) for j in range(6)]
    return game[frozenset()], phi


@pytest.mark.parametrize("make", [lambda: DecisionTreeRegressor(maxDepth=5), lambda: RandomForestRegressor(numTrees=4, maxDepth=4, seed=1), lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=1)])
def test_equal_all_subsets_and_add_up(spark, rows, make):
    model = make().setLabelCol("y").fit(rows)
    nodes = attribution.fitted_nodes(spark, model).collect()
    found = attribution.model_attributions(model.transform(rows), model, "features", NAMES).collect()
    assert len(found) == 300
    for r in found:
        assert r["base"] + sum(r[f"phi_{c}"] for c in NAMES) == pytest.approx(r["prediction"])
    for r in found[:15]:
        base, phi = by_subsets(nodes, [r[c] for c in NAMES])
        assert r["base"] == pytest.approx(base) and [r[f"phi_{c}"] for c in NAMES] == pytest.approx(phi, abs=1e-9)


def test_nulls_go_right_and_covers_are_counted(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 1.0, 1, 2, None, None, 1.0), (0, 1, None, None, None, None, 5.0, None, 1.0), (0, 2, 0, 3.0, 3, 4, None, None, 1.0), (0, 3, None, None, None, None, 7.0, None, 1.0), (0, 4, None, None, None, None, 9.0, None, 1.0)], attribution.NODES)
    df = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, None), (4, 8.0)], "row int, x double")
    nodes = attribution.counted_cover(nodes, df, ["x"])
    assert [r["cover"] for r in nodes.orderBy("id").collect()] == [4, 1, 3, 1, 2]
    got = {r["row"]: (r["base"], r["phi_x"]) for r in attribution.tree_attributions(df, ["x"], nodes).collect()}
    assert got == {1: (7.5, -2.5), 2: (7.5, -0.5), 3: (7.5, 1.5), 4: (7.5, 1.5)}
    assert attribution.tree_attributions(df.limit(0), ["x"], nodes).count() == 0


def test_linear(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, None)], "a double, b double")
    got = attribution.linear_attributions(df, {"a": 2.0, "b": -1.0}).collect()
    assert [(r["phi_a"], r["phi_b"]) for r in got] == [(-2.0, 0.0), (2.0, None)]


def plain_fit(x, y, w):
    points = {}
    for a, b, c in zip(x, y, w):
        s = points.setdefault(a, [0.0, 0.0])
        s[0] += c
        s[1] += b * c
    blocks = []
    for a in sorted(points):
        blocks.append([a, a, *points[a]])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1][1:] = [b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [(a, b, w, s / w) for a, b, w, s in blocks]


SHAPES = {
    "noise": lambda x, rng: rng.normal(size=len(x)),
    "falling": lambda x, rng: -x,
    "rising": lambda x, rng: x,
    "steps": lambda x, rng: np.floor(x / 100) - (x % 100) / 300 + rng.normal(0, 0.2, len(x)),
    "waves": lambda x, rng: np.sin(x / 60) + x / 500,
    "saw": lambda x, rng: x % 97,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_isotonic_over_ranges(spark, shape):
    rng = np.random.default_rng(2)
    x = rng.permutation(np.repeat(np.arange(900), 2))[:1500].astype(float)
    y, w = SHAPES[shape](x, rng), rng.integers(0, 4, 1500)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, w)], "x double, y double, w int")
    got = sorted(tuple(r) for r in isotonic.isotonic_blocks(df, "y", "x", "w", rows=64).collect())
    kept = w > 0
    want = plain_fit(x[kept], y[kept], w[kept])
    assert [g[:2] for g in got] == [b[:2] for b in want]
    assert [v for g in got for v in g[2:]] == pytest.approx([v for b in want for v in b[2:]])


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_isotonic_values(spark, broadcast, monkeypatch):
    monkeypatch.setattr(isotonic, "BROADCAST_BLOCKS", broadcast)
    monkeypatch.setattr(isotonic, "GROUP_ROWS", 3)
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 3.0), (4.0, 6.0), (5.0, 10.0), (None, 1.0), (6.0, None)], "p double, y double")
    new = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 4.25, 5.0, 9.0, 9.0, None)], "p double")
    got = isotonic.isotonic_values(new, isotonic.isotonic_blocks(df, "y", "p"), "p", "v").collect()
    assert sorted(((r["p"] or 0) - (r["p"] is None), r["v"]) for r in got) == [(-1, None), (0, 4), (1, 4), (1.5, 4), (2, 4), (3, 5), (4, 6), (4.25, 7), (5, 10), (9, 10), (9, 10)]
    none = isotonic.isotonic_blocks(df.limit(0), "y", "p")
    assert none.count() == 0 and {r["v"] for r in isotonic.isotonic_values(new, none, "p", "v").collect()} == {None}
    assert models.calibrate(df.withColumnsRenamed({"p": "predicted", "y": "actual"})).filter("calibrated is null").count() == 1
