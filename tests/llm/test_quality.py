import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from parlance.llm import rules, weak_labels
from parlance.llm.calibration import calibrated_cut
from parlance.llm.queries import op7_quality_rules, op10_quality_classifier
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def counts(text):
    w = brute.words(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if brute.words(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(covered), "n_distinct_words": len(set(w))}


@pytest.mark.parametrize("table", ["sf", "awkward"])
def test_rule_counts(spark, sf, table):
    df = spark.read.parquet(f"{sf}/documents.parquet") if table == "sf" else brute.awkward(spark).filter("doc_id <> 1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in rules.quality_rules(df, labels).collect():
        want = counts(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def _verdicts(spark, rows):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["kept"] for r in rows}
    good = [kept[i] for i, q in labels.items() if q == 1]
    bad = [kept[i] for i, q in labels.items() if q == 0]
    return np.mean(good), 1 - np.mean(bad)


def test_rules_catch_bad_and_keep_good(spark):
    good, caught = _verdicts(spark, op7_quality_rules(spark, SF).filter("not base_failed or kept is not null").collect())
    assert good > 0.95 and caught > 0.9


def test_classifier_catches_bad_and_keeps_good(spark):
    good, caught = _verdicts(spark, op10_quality_classifier(spark, SF).collect())
    assert good > 0.99 and caught > 0.9


def test_posteriors_know_the_classes(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    weak = {r["doc_id"]: r["weak_good"] for r in op10_quality_classifier(spark, SF).collect()}
    assert np.mean([(weak[i] > 0.5) == (q == 1) for i, q in labels.items()]) > 0.97


@pytest.mark.parametrize("name", ["rules", "classifier"])
def test_verdicts_hold_on_labels_that_set_no_cut(spark, name):
    """The cut is of one half of the labels; the rates are of the other."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    run = rules.quality_rules if name == "rules" else weak_labels.quality_scores
    for half in (0, 1):
        mine = labels.filter(f"crc32(cast(doc_id as string)) % 2 = {half}")
        kept = {r["doc_id"]: r["kept"] for r in run(docs, mine).collect()}
        failed = {r["doc_id"] for r in rules.quality_rules(docs, mine).filter("base_failed").collect()}
        other = [(r["doc_id"], r["quality"]) for r in labels.join(mine, "doc_id", "left_anti").collect() if name != "rules" or r["doc_id"] not in failed]
        good = np.mean([kept[i] for i, q in other if q == 1])
        caught = 1 - np.mean([kept[i] for i, q in other if q == 0])
        assert good > 0.97 and caught > 0.9, (half, good, caught)


def test_one_odd_good_row_does_not_set_the_cut(spark):
    rows = [(i, 0.1 + 0.001 * (i % 50)) for i in range(300)] + [(1000 + i, 0.8) for i in range(60)] + [(999, 0.99)]
    labels = [(i, 1) for i in range(300)] + [(999, 1)] + [(1000 + i, 0) for i in range(60)]
    cut = calibrated_cut(spark.createDataFrame(rows, "doc_id long, score double"), spark.createDataFrame(labels, "doc_id long, quality int"), 0.998, 0.5)
    assert 0.15 < cut < 0.8


def test_expected_path_is_the_search_tree_s():
    assert [rules.expected_path(n) for n in (0, 1, 2, 3)] == [0, 0, 1, pytest.approx(5 / 3)]


def test_forest_and_cut_equal_a_plain_form(spark, sf):
    """Scores by walking each tree row by row, and the verdict by the cut that leaves them."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = rules.quality_rules(docs, labels).collect()
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    hashed = [r[0] for r in rules.document_statistics(docs).selectExpr("doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").collect()]
    by = {r["doc_id"]: r for r in rows}
    sample = [by[i] for i in hashed if i in good and not by[i]["base_failed"]]
    table = lambda found: rules.features({k: np.array([r[k] for r in found]) for k in rules.COUNTS})
    forest = rules.grow(table(sample))
    x = table(rows)
    for i, r in enumerate(rows):
        total = 0.0
        for tree in range(rules.TREES):
            node = 0
            while forest["feature"][tree, node] >= 0:
                node = 2 * node + 1 + int(x[i, forest["feature"][tree, node]] >= forest["cut"][tree, node])
            total += forest["length"][tree, node]
        assert r["score"] == pytest.approx(min(1, 2 ** (-total / rules.TREES / rules.expected_path(min(256, len(sample))))))
    scores = {kept: [r["score"] for r in rows if r["kept"] == kept and not r["base_failed"]] for kept in (True, False)}
    assert not scores[False] or max(scores[True]) < min(scores[False])


def test_scorer_equals_a_plain_form(spark, sf):
    """Scores of the classifier's query by adding up the weights of each feature of each text, and its verdict by the cut."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, _ = weak_labels.fit(docs, labels)
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    for r in op10_quality_classifier(spark, sf).collect():
        raw = np.frombuffer(texts[r["doc_id"]], np.uint8)
        parts, _ = weak_labels._parts(raw, np.array([0, len(raw)]))
        z = model.bias + sum(scale * np.mean([float(model.weights[i]) for i in ids.tolist()]) for (ids, _), scale in zip(parts, weak_labels._SCALES, strict=True) if len(ids))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)
        assert r["kept"] == (r["score"] <= model.cut)


def test_long_and_repeated_texts_can_train_the_scorer(spark):
    """A sample of all rows takes a text of any length, and equal rows once."""
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), *[(2, "plain words of a text") for _ in range(50)], (3, None)], "doc_id long, text string")
    model, scored = weak_labels.fit(df, None)
    assert scored.count() == 52 and np.count_nonzero(model.weights) > 30_000


def test_labeller_model_recovers_rates():
    rng = np.random.default_rng(0)
    y = (rng.random(40_000) < 0.85).astype(int)
    votes = np.full((len(y), 3), weak_labels.NONE)
    for j, (if_bad, if_good, vote) in enumerate(((0.6, 0.01, 0), (0.5, 0.02, 0), (0.2, 0.9, 1))):
        votes[rng.random(len(y)) < np.where(y == 1, if_good, if_bad), j] = vote
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    theta, share = weak_labels.fit_labellers(patterns, n.astype(float), np.array([0, 0, 1]))
    assert abs(share - 0.85) < 0.05 and abs(theta[0, 0, 0] - 0.6) < 0.1 and abs(theta[2, 1, 1] - 0.9) < 0.03


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    forest = rules.grow(rng.normal(size=(2000, 4)))
    inside, outside = rules.anomaly(forest, rng.normal(size=(200, 4))), rules.anomaly(forest, rng.normal(size=(200, 4)) + 8)
    assert inside.max() < outside.min()


def test_awkward(spark, sf):
    df = brute.awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (13, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert rules.quality_rules(df, labels).count() == df.count()
    assert weak_labels.quality_scores(df, labels).count() == df.count()
    left = weak_labels.drop_low_quality(df, labels)
    assert left.columns == df.columns and 0 < left.count() <= df.count()
    none = df.limit(0)
    assert rules.quality_rules(none, labels).count() == weak_labels.quality_scores(none, labels).count() == weak_labels.drop_low_quality(none, labels).count() == 0
    assert rules.quality_rules(df, labels.limit(0)).count() == df.count()
    assert weak_labels.quality_scores(df, None).count() == df.count()
    assert not any(r["kept"] for r in rules.quality_rules(df.filter("doc_id in (5, 6, 7)"), labels).collect())


def test_features_of_the_sample_have_a_bound(spark):
    rows = [(h, list(range(n))) for h, n in ((5, 10), (-7, 40), (3, 30), (9, 100))]
    df = spark.createDataFrame(rows, "h long, index array<int>")
    assert [weak_labels._last_hash(df, n) for n in (1, 40, 41, 71, 81, 10_000)] == [-7, -7, 3, 5, 9, 9]
    assert weak_labels._last_hash(df.limit(0), 5) == 0
