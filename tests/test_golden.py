"""Published figures, as numbers."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import stats
from parlance.functions.scores import SEVERITIES
from parlance.operators import ensemble, evaluate


def test_class_report_of_published_matrix(spark):
    matrix = ((5, 19, 15, 5), (0, 17, 35, 3), (0, 20, 99, 37), (2, 2, 37, 123))
    rows = [(SEVERITIES[i], SEVERITIES[j], n) for i, row in enumerate(matrix) for j, n in enumerate(row)]
    got = {r["label"]: r for r in evaluate.class_report(spark.createDataFrame(rows, "actual string, predicted string, n long")).collect()}
    for name, p, r in zip(SEVERITIES, (0.714286, 0.293103, 0.532258, 0.732143), (0.113636, 0.309091, 0.634615, 0.75), strict=True):
        assert (got[name]["precision"], got[name]["recall"]) == (pytest.approx(p, abs=1e-6), pytest.approx(r, abs=1e-6))
    assert got["accuracy"]["f1"] == pytest.approx(0.582339, abs=1e-6)
    assert got["macro avg"]["f1"] == pytest.approx(0.454219, abs=1e-6)
    assert got["weighted avg"]["f1"] == pytest.approx(0.565656, abs=1e-6)


def test_metrics_of_four_published_predictions(spark):
    df = spark.createDataFrame([(77.3, 56.147079), (83.8, 60.910303), (62.6, 42.104790), (77.6, 50.353656)], "actual double, predicted double")
    row = evaluate.report(df).first()
    assert row["mae"] == pytest.approx(22.946043, abs=1e-6)
    assert row["rmse"] == pytest.approx(23.096543, abs=1e-6)
    assert row["r2"] == pytest.approx(-7.787313, abs=1e-5)
    assert row["r"] == pytest.approx(0.942147, abs=1e-6)
    assert row["acc_10"] == 0 and row["severity_accuracy"] == 0
    assert evaluate.spearman(df).first()["rho"] == pytest.approx(0.8)


def test_welch_from_published_groups(spark):
    """Groups of the published sizes, means and deviations."""
    def rows(name, n, mean, sd):
        return [(name, mean + (sd if i % 2 else -sd) * (n / (n - n % 2)) ** 0.5 * (0 if n % 2 and i == n - 1 else 1)) for i in range(n)]

    df = spark.createDataFrame(rows("low", 126, 66.58730, 16.90734) + rows("high", 293, 62.71368, 26.07472), "g string, x double")
    assert evaluate.welch(df, "g", "x", "low", "high").first()["t"] == pytest.approx(1.803, abs=0.002)


def test_moments(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.5, 7.0, 11.0, 0.3)] + [("b", 5.0), ("c", float("nan")), ("d", 1.0), ("d", 1.0), ("d", 1.0), ("d", 1.0)], "k string, x double")
    got = {r["k"]: r for r in stats.summarise(df, ["k"], "x").collect()}
    a = got["a"]
    assert [round(a[n], 7) for n in ("p10", "q1", "median", "q3", "p90", "skew", "kurt")] == [0.65, 1.25, 2.25, 5.875, 9.0, 1.1986534, 0.2557547]
    assert got["b"]["std"] == 0 and got["b"]["skew"] is None and got["b"]["mad"] == 0
    assert got["c"]["mean"] is None and got["c"]["std"] is None
    assert got["d"]["std"] == 0 and got["d"]["skew"] is None and got["d"]["kurt"] is None


def test_importance_groups(spark):
    df = spark.createDataFrame([("den_a", 2.0), ("den_b", 1.0), ("dys_c", 6.0), ("z", 1.0)], "feature string, importance_mean double")
    got = {r["feature_group"]: (r["sum"], r["n"], r["pct"]) for r in ensemble.group_importance(df, {"den_": "DEN", "dys_": "DYS"}).collect()}
    assert got == {"DEN": (3.0, 2, 30.0), "DYS": (6.0, 1, 60.0), "OTHER": (1.0, 1, 10.0)}


def test_safe_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = df.agg(stats.pearson(F.col("x"), F.col("y")).alias("r")).first()
    assert row["r"] is None
    assert evaluate.report(df.filter("x > 5"), "x", "y").first()["mae"] is None
