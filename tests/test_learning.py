"""Models that are fitted by aggregates, against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import additive, encoding, kernel, models, neighbors


def frame(spark, columns):
    n = len(next(iter(columns.values())))
    kind = ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame([tuple(None if v[i] is None or v[i] != v[i] else float(v[i]) for v in columns.values()) for i in range(n)], kind)


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-3, 3, (1500, 3))
    y = 3 * np.sin(x[:, 0]) + np.where(x[:, 1] > 1, 4.0, 0.0) + 2 * (x[:, 0] > 0) * (x[:, 2] > 0) + rng.normal(0, 0.2, 1500)
    holes = np.where(rng.random(1500) < 0.1, np.nan, x[:, 1])
    return frame(spark, {"a": x[:, 0], "b": holes, "c": x[:, 2], "flat": np.ones(1500), "y": y}).cache()


def plain_rounds(x, y, edges, rounds, rate, leaves, least):
    """Shapes by the definition, over rows."""
    bins = [np.where(np.isnan(c), 0, 1 + np.array([sum(v > e for e in es) for v in c])) for c, es in zip(x, edges)]
    shapes, r = [np.zeros(len(e) + 2) for e in edges], y - y.mean()
    for _ in range(rounds):
        steps = []
        for b, e in zip(bins, edges):
            cuts = [0, len(e) + 2]
            while len(cuts) <= leaves:
                tried = []
                for lo, hi in zip(cuts, cuts[1:]):
                    for m in range(lo + 1, hi):
                        left, right = r[(b >= lo) & (b < m)], r[(b >= m) & (b < hi)]
                        if min(len(left), len(right)) >= least:
                            tried.append((left.sum() ** 2 / len(left) + right.sum() ** 2 / len(right) - (left.sum() + right.sum()) ** 2 / (len(left) + len(right)), -m))
                if not tried or max(tried)[0] <= 1e-12:
                    break
                cuts = sorted([*cuts, -max(tried)[1]])
            step = np.zeros(len(e) + 2)
            for lo, hi in zip(cuts, cuts[1:]):
                inside = (b >= lo) & (b < hi)
                step[lo:hi] = rate * r[inside].mean() if inside.any() else 0
            steps.append(step)
        g = sum(s[b] for s, b in zip(steps, bins))
        length = min(1.0, (g @ r) / (g @ g))
        r = r - length * g
        shapes = [s + length * t for s, t in zip(shapes, steps)]
    return shapes


def test_additive_rounds_equal_the_definition(spark, waves):
    edges = [[-1.0, 0.0, 1.0], [-2.0, 1.0, 2.0], [0.0]]
    rows = waves.toPandas()
    model = additive.fit_additive(waves, ["a", "b", "c"], "y", rounds=5, rate=0.5, leaves=3, least=20, edges=edges, tolerance=0)
    want = plain_rounds([rows[c].to_numpy(float) for c in "abc"], rows["y"].to_numpy(), edges, 5, 0.5, 3, 20)
    for got, shape in zip(model.tables, want, strict=True):
        assert got == pytest.approx(shape)
    again = additive.Additive.of_text(model.text())
    first = again.predicted(waves).first()
    bins = [0 if first[c] is None else 1 + sum(first[c] > e for e in es) for c, es in zip("abc", edges)]
    assert first["prediction"] == pytest.approx(rows["y"].mean() + sum(s[b] for s, b in zip(want, bins)))
    assert model.shapes(spark).count() == 5 + 5 + 3


def test_additive_finds_shapes_and_pairs(spark, waves):
    error = lambda m: m.predicted(waves).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    alone = additive.fit_additive(waves, ["a", "b", "c", "flat"], "y", bins=32, rounds=25, rate=0.4)
    pairs = additive.fit_additive(waves, ["a", "b", "c", "flat"], "y", bins=32, rounds=25, rate=0.4, interactions=1)
    assert pairs.terms[-1] == (0, 2) and len(pairs.terms) == 5
    assert error(pairs) < 0.75 * error(alone) < 0.6
    assert np.abs(alone.tables[3]).max() < 1e-9
    empty = additive.fit_additive(waves.limit(0), ["a", "b"], "y", interactions=1)
    assert empty.intercept == 0 and empty.predicted(waves).agg(F.max("prediction")).first()[0] == 0


def exact_machine(x, y, test, c, epsilon, gamma, rounds=400):
    """The kernel machine in the kernel's own space, by the same kind of bounds, run to its end."""
    k = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1))
    gram, n = k(x, x), len(y)
    weight, shift = np.ones(n), np.zeros(n)
    for _ in range(rounds):
        a = np.block([[gram + np.diag(1 / (c * weight)), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        alpha = np.linalg.solve(a, np.append(y - shift, 0))
        weight, shift = kernel.bound_of(y - gram @ alpha[:-1] - alpha[-1], epsilon, 1e-7)
    return k(test, x) @ alpha[:-1] + alpha[-1]


def test_kernel_machine_is_near_the_exact_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 2))
    y = 4 * np.sin(2 * x[:, 0]) * np.cos(x[:, 1]) + x[:, 1] + rng.normal(0, 0.3, 700)
    y[::50] += 30  # the loss is of absolute errors
    df = frame(spark, {"p": x[:500, 0], "q": x[:500, 1], "y": y[:500]}).cache()
    test = frame(spark, {"p": x[500:, 0], "q": x[500:, 1], "y": y[500:]})
    model = kernel.fit_kernel_machine(df, F.array("p", "q"), "y", c=5.0, epsilon=0.2, gamma=0.5, dims=512)
    got = np.array([r["prediction"] for r in kernel.KernelMachine.of_text(model.text()).predicted(test, F.array("p", "q")).collect()])
    want = exact_machine(x[:500], y[:500], x[500:], 5.0, 0.2, 0.5)
    error = lambda p: np.median(np.abs(p - y[500:]))
    mean = lambda p: np.abs(p - y[500:]).mean()
    assert abs(mean(got) - mean(want)) < 0.05 * mean(want) and error(got) < 0.6
    odd = spark.createDataFrame([(1.0, None), (0.0, 0.0)], "p double, q double")
    assert [r["prediction"] is None for r in model.predicted(odd, F.array("p", "q")).collect()] == [True, False]
    assert kernel.fit_kernel_machine(df.limit(0), F.array("p", "q"), "y").weights.tolist() == [0, 0, 0]


def test_bounds_touch_and_lie_above():
    e, z = np.array([-3.0, -1.0, -0.2, 0.0, 0.5, 0.9, 4.0]), np.linspace(-6, 6, 241)
    loss = lambda r: np.maximum(0, np.abs(r) - 1.0)
    for at, w, s in zip(e, *kernel.bound_of(e, 1.0, 1e-6)):
        above = lambda r: w * (r - s) ** 2 / 2 - w * (at - s) ** 2 / 2 + loss(at)  # noqa: B023, E731
        assert (above(z) >= loss(z) - 1e-9).all()


def test_fitted_models_are_saved(spark, waves, tmp_path):
    for name in ("svr", "ebm"):
        model, _ = models.estimator(name)
        fitted = models.pipeline(["a", "b", "c"], model.setParams(**({"maxIter": 3, "interactions": 1} if name == "ebm" else {"dims": 32})), "y").fit(waves)
        models.save(fitted, str(tmp_path / name))
        again = models.load_all([str(tmp_path / name)])[0]
        assert again.transform(waves).select("prediction").collect() == fitted.transform(waves).select("prediction").collect()
    found = models.search(waves.limit(300), ["a", "c"], "y", "svr", folds=2, draws=1, published=True)
    assert len(found.avgMetrics) == 1


def test_ordered_statistics(spark, monkeypatch):
    monkeypatch.setattr(encoding, "RANGE_ROWS", 10)
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"c{i % 5}", None if i % 13 == 0 else float(rng.normal()), i % 17 != 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, cat string, y double, known boolean")
    got = {r["id"]: r["cat_ts"] for r in encoding.ordered_target_stats(df, "id", ["cat"], "y", weight=2.0, train=F.col("known")).collect()}
    import hashlib

    counted = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i, c, y) for i, c, y, known in rows if y is not None and known)
    prior, seen = np.mean([y for *_, y in counted]), {}
    for _, i, c, y in counted:
        before = seen.setdefault(c, [])
        assert got[i] == pytest.approx((sum(before) + 2 * prior) / (len(before) + 2))
        before.append(y)
    for i, c, y, known in rows:
        if y is None or not known:
            assert got[i] == pytest.approx((sum(seen.get(c, [])) + 2 * prior) / (len(seen.get(c, [])) + 2))
    assert len(got) == 400 and encoding.ordered_target_stats(df.limit(0), "id", ["cat"], "y").count() == 0
    stats = {r["cat"]: r["cat_ts"] for r in encoding.category_stats(df, "cat", "y").collect()}
    hot = [y for _, c, y, _ in rows if c == "hot" and y is not None]
    assert stats["hot"] == pytest.approx((sum(hot) + np.mean([r[2] for r in rows if r[2] is not None])) / (len(hot) + 1))


def plain_information(x, y, k):
    """By comparing each row with each, over the same whole numbers."""
    whole = lambda v: np.round(v / float(f"{v.std():.9e}") * 2**32).astype(np.int64) if v.std() > 0 else np.zeros(len(v), np.int64)
    x, y = whole(x), whole(y)
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    total = 0.0
    for i in range(len(x)):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        r = np.sort(np.delete(np.maximum(dx, dy), i))[k - 1]
        near = lambda d: int((d < r).sum() if r else (d == 0).sum())  # noqa: B023, E731
        total += psi(near(dx)) + psi(near(dy))
    return max(0.0, psi(len(x)) + psi(k) - total / len(x))


@pytest.mark.parametrize("cell", [5, 64])
def test_information_by_neighbours(spark, cell):
    rng = np.random.default_rng(9)
    y = rng.normal(size=600)
    cols = {"near": y + rng.normal(0, 0.3, 600), "alone": rng.exponential(size=600) ** 3, "steps": np.round(y * 2), "flat": np.ones(600), "y": np.where(rng.random(600) < 0.3, 1.0, y)}
    df = frame(spark, cols)
    names = ["near", "alone", "steps", "flat"]
    got = {r["feature"]: r for r in neighbors.neighbour_information(df, names, "y", cell_points=cell).collect()}
    for c in names:
        assert got[c]["n"] == 600 and got[c]["mi"] == pytest.approx(plain_information(cols[c], cols["y"], 3), abs=1e-9)
    assert got["near"]["mi"] > 0.3 > got["alone"]["mi"]


def test_information_of_few_rows(spark):
    df = frame(spark, {"a": [1.0, 2.0, None], "b": [None, None, None], "y": [1.0, 5.0, 2.0]})
    got = {r["feature"]: (r["n"], r["mi"]) for r in neighbors.neighbour_information(df, ["a", "b"], "y").collect()}
    assert got == {"a": (2, None)}
    x = spark.range(1, 60).select(neighbors.digamma(F.col("id")).alias("v")).collect()
    assert [r["v"] for r in x] == pytest.approx([-0.5772156649015329 + sum(1 / i for i in range(1, n)) for n in range(1, 60)], abs=1e-11)


def test_kernel_machine_reads_equal_rows_once(spark, monkeypatch):
    """Rounds read one row for all equal ones, and the fit is that of all rows."""
    kept = []
    monkeypatch.setattr(kernel, "checkpointed", lambda df: kept.append(df) or df.cache())
    rows = [(float(i % 7), float(i % 3), float(i % 7 * 2 + i % 3 + (i % 2) / 4)) for i in range(420)]
    df = spark.createDataFrame(rows, "p double, q double, y double")
    got = kernel.fit_kernel_machine(df, F.array("p", "q"), "y", c=2.0, epsilon=0.2, dims=32)
    once = kernel.fit_kernel_machine(df.distinct(), F.array("p", "q"), "y", c=20.0, epsilon=0.2, dims=32)
    assert [k.count() for k in kept] == [42, 42] and kept[0].agg(F.sum("times")).first()[0] == 420
    x = np.array([r[:2] for r in rows[:42]])
    assert np.abs(got.values(x) - once.values(x)).max() < 1e-2
