"""Folds balanced by rows, weights to the minimum, elimination, beginnings of names and tags in context, against plain forms."""

import math
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import ensemble, folds, merge, ranks, selection, tagging


def deviation(rows, fold_of, k):
    """The mean over strata of the deviation between folds of their shares of the stratum."""
    table = defaultdict(lambda: np.zeros(k))
    for group, stratum in rows:
        table[stratum][fold_of[group]] += 1
    return np.mean([np.std(v / v.sum()) for v in table.values()])


def greedy(rows, k):
    """Group by group, the most uneven first, to the fold that leaves the least deviation."""
    strata = sorted({s for _, s in rows}, key=str)
    vectors = defaultdict(lambda: np.zeros(len(strata)))
    for g, s in rows:
        vectors[g][strata.index(s)] += 1
    whole, now, out = sum(vectors.values()), np.zeros((k, len(strata))), {}
    for g in sorted(vectors, key=lambda g: (-np.std(vectors[g]), str(g))):
        def cost(f):
            now[f] += vectors[g]
            found = np.mean(np.std(now / whole, axis=0))
            now[f] -= vectors[g]
            return round(found, 12), now[f].sum(), f
        out[g] = min(range(k), key=cost)
        now[out[g]] += vectors[g]
    return out


@pytest.mark.parametrize(("seed", "kinds"), [(0, 100_000), (1, 100_000), (2, 30)])
def test_rows_are_balanced_at_least_as_well_as_by_groups_in_turn(spark, seed, kinds, monkeypatch):
    monkeypatch.setattr(folds, "KINDS", kinds)
    rng = np.random.default_rng(seed)
    rows = [(f"g{g}" if g else None, None if s == 3 else f"s{s}") for g in range(150) for s in rng.choice(4, int(rng.pareto(1.2) * 3) + 1, p=[0.6, 0.3, 0.08, 0.02])]
    df = spark.createDataFrame(rows, "g string, s string")
    got = {r["g"]: r["fold"] for r in folds.row_balanced_group_folds(df, "g", "s", 4).collect()}
    assert set(got) == {g for g, _ in rows} and set(got.values()) == {0, 1, 2, 3}
    if kinds > 1000:
        by_groups = {r["g"]: r["fold"] for r in folds.stratified_group_folds(df, "g", "s", 4).collect()}
        assert deviation(rows, got, 4) <= deviation(rows, greedy(rows, 4), 4) * 1.05 + 1e-9
        assert deviation(rows, got, 4) < deviation(rows, by_groups, 4)
    assert deviation(rows, got, 4) < deviation(rows, greedy(rows, 4), 4) + 0.1  # also of rounded counts
    assert folds.row_balanced_group_folds(df.limit(0), "g", "s").count() == 0


def test_like_groups_are_dealt_evenly(spark):
    df = spark.range(4003).select((F.col("id") / 2).cast("long").alias("g"), F.lit("a").alias("s"))
    counts = [r["count"] for r in folds.row_balanced_group_folds(df, "g", "s", 4).groupBy("fold").count().collect()]
    assert sum(counts) == 2002 and max(counts) - min(counts) <= 1


def test_weights_reach_the_minimum(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(50, 15, 800)
    cols = [y + rng.normal(0, s, 800) + b for s, b in ((4, 1), (6, -2), (9, 0))]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, *cols)], "y double, m1 double, m2 double, m3 double").cache()
    weights, error = ensemble.least_error_weights(df, "y", ["m1", "m2", "m3"])
    w = np.array(list(weights.values()))
    mae = lambda w: float(np.abs(np.array(cols).T @ w - y).mean())
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and error == pytest.approx(mae(w))
    assert error <= ensemble.refined_weights(df, "y", ["m1", "m2", "m3"]).first()["mae"] + 1e-9
    for _ in range(200):  # no direction leads further down
        d = rng.dirichlet(np.ones(3))
        assert error <= mae(0.99 * w + 0.01 * d) + 1e-7
    assert ensemble.least_error_weights(df, "y", ["m1"]) == ({"m1": 1.0}, pytest.approx(mae(np.array([1.0, 0, 0]))))
    assert math.isnan(ensemble.least_error_weights(df.limit(0), "y", ["m1", "m2"])[1])


def test_elimination_equals_refits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 7)) @ rng.normal(size=(7, 7)) + 5
    y = x @ rng.normal(size=7) + rng.normal(0, 3, 400)
    names = list("abcdefg")
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in names) + ", y double").withColumns({"flat": F.lit(3.0), "twice": F.col("a") * 2})
    left, gone = list(range(7)), {}
    while len(left) > 2:
        z = np.column_stack([np.ones(400), x[:, left]])
        weight = np.abs(np.linalg.lstsq(z, y, rcond=None)[0][1:]) * x[:, left].std(0)
        out = [left[i] for i in np.argsort(weight)[:1]]
        gone |= {names[i]: len(left) for i in out}
        left = [i for i in left if i not in out]
    got = dict(selection.recursive_elimination(df, names, "y", keep=2, step=1))
    assert {c for c, r in got.items() if r == 1} == {names[i] for i in left}
    assert sorted(gone, key=gone.get) == sorted((c for c in got if got[c] > 1), key=got.get)
    odd = dict(selection.recursive_elimination(df, [*names, "flat", "twice"], "y", keep=7, step=2))
    assert odd["flat"] == odd["twice"] == 2 and odd["a"] == 1
    assert len(selection.recursive_elimination(df.limit(0), names, "y", keep=2)) == 7


@pytest.mark.parametrize("rows", [None, 7])
def test_beginnings(spark, rows):
    rng = np.random.default_rng(8)
    names = ["", None, "é", "éa", "a", *("".join(rng.choice(list("ab漢"), rng.integers(1, 7))) for _ in range(150)), *("common" * 9 + "x" * i for i in range(20))]
    a, b = names[::2] + ["a"], names[1::2] + ["a"]
    df = lambda x: spark.createDataFrame([(v,) for v in x], "n string")
    got = [tuple(r) for r in merge.prefix_matches(df(a), df(b), "n", "n", rows).collect()]
    want = {(x, y) for x in set(a) for y in set(b) if x and y and (x.startswith(y) or y.startswith(x))}
    assert len(got) == len(set(got)) and set(got) == want
    every = {tuple(r) for r in merge.beginnings(df(names), "n", rows).collect()}
    known = {n for n in names if n is not None}
    assert every == {(x, y) for x in known for y in known if x.startswith(y)}
    assert merge.prefix_matches(df([]), df(b), "n", "n").count() == 0


def test_quantiles_in_few_jobs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 6))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(6)))
    shares = [i / 10 for i in range(1, 10)]
    spark.sparkContext.setJobGroup("quantiles", "")
    got = ranks.exact_quantiles(df, [f"c{i}" for i in range(6)], shares)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles"))
    spark.sparkContext.setJobGroup("", "")
    for i in range(6):
        assert got[f"c{i}"] == pytest.approx(np.quantile(x[:, i], shares))
    assert jobs <= 14  # two for an aggregate, one to store


def test_tags_are_the_most_probable(spark):
    rows = [("the dog runs".split(), ["D", "N", "V"]), ("dog dog".split(), ["N", "V"]), ("a run".split(), ["D", "N"]), ("the run ends".split(), ["D", "N", "V"]), (None, ["D"]), (["x"], None)]
    model = tagging.train_tagger(spark.createDataFrame(rows, "w array<string>, t array<string>"), "w", "t")
    assert model.tags == ["D", "N", "V"]
    known = {r["word"]: r["scores"] for r in model.emissions.collect()}
    texts = ["the run runs", "dog", "run dog zzz the", "", "zzz zzz", "dog the run run dog a"]
    df = spark.createDataFrame([(i, x.split()) for i, x in enumerate(texts)] + [(90, None), (91, ["the", None])], "id int, w array<string>")
    got = {r["id"]: r["tags"] for r in tagging.viterbi(df, ["id"], "w", model).collect()}
    assert len(got) == 8 and got[3] == [] == got[90] and len(got[91]) == 2
    for i, x in enumerate(texts):
        words = x.split()
        if not words:
            continue
        def score(path):
            e = sum(known.get(w, model.unknown)[t] for w, t in zip(words, path))
            return model.first[path[0]] + e + sum(model.steps[a][b] for a, b in zip(path, path[1:])) + model.last[path[-1]]
        best = max(product(range(3), repeat=len(words)), key=score)
        assert score([model.tags.index(t) for t in got[i]]) == pytest.approx(score(best))
    assert got[0] == ["D", "N", "V"]
    for s in range(3):
        assert sum(map(math.exp, [*model.steps[s], model.last[s]])) == pytest.approx(1)
