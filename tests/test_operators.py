import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import stats
from parlance.operators import ensemble, folds, history, language_model as lm, lexicon, merge, models, prep, ranks, selection, timing
from parlance.plans import language_queries
from parlance.sources import files


def test_pause_boundaries(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.15, 2.0), ("a", 2.4, 3.0), ("a", 6.0, 7.0), ("a", 7.1, 7.0), ("a", None, 1.0), ("b", 0.0, 1.0)]
    words = timing.tidy_words(spark.createDataFrame(rows, "patient_id string, start_sec double, end_sec double"))
    assert words.count() == 6 and words.filter("start_sec = 7.1").first()["end_sec"] == pytest.approx(7.11)
    got = timing.pauses(timing.gaps(words), low=0.1499999).orderBy("start_sec").collect()
    assert [(round(r["gap"], 6), r["kind"]) for r in got] == [(0.15, "short"), (0.4, "short")]  # 3.0 is no pause


def test_quiet_gaps(spark):
    gaps = spark.createDataFrame([("a", 1, 0.5, 2.5), ("a", 2, 3.0, 3.2), ("b", 3, 0.0, 1.0)], "patient_id string, gap_id int, gap_start double, gap_end double")
    frames = spark.createDataFrame([("a", 0.5, -40.0), ("a", 1.0, -40.0), ("a", 1.5, -40.0), ("a", 2.0, -40.0), ("a", 2.4, -10.0), ("a", 2.5, -10.0)], "patient_id string, t double, rms_db double")
    got = {r["gap_id"]: (r["quiet_share"], r["silent"]) for r in timing.quiet_gaps(gaps, frames).collect()}
    assert got == {1: (0.8, True), 2: (None, True), 3: (None, False)}


def test_language_model_sums_to_one(spark):
    seqs = spark.createDataFrame([(1, ["A", "B", "A"]), (2, ["B"]), (3, ["A", "A"])], "id int, tags array<string>")
    model = lm.train(seqs.select("tags"), "tags")
    every = spark.createDataFrame([([c], t) for c in ("<s>", "A", "B") for t in ("A", "B", "</s>", "<s>")], "context array<string>, tag string")
    p = lm.probabilities(every, model, 2).groupBy("context").agg(F.sum("prob").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in p)
    p = lm.probabilities(every.filter("tag <> '<s>'"), model, 2, "kneser-ney").groupBy("context").agg(F.sum("prob").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in p)
    unseen = lm.probabilities(spark.createDataFrame([(["Z", "Z"], "A")], "context array<string>, tag string"), model, 3).first()
    assert unseen["prob"] == pytest.approx(0.4 * 0.4 * (4 + 1) / (9 + 4))
    ce = {r["id"]: r["ce"] for r in lm.cross_entropy(seqs, ["id"], "tags", model, 2).collect()}
    assert ce[2] is None and ce[1] > 0


def test_folds_keep_groups_and_strata(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    dealt = folds.stratified_group_folds(orders, "o_custkey", "o_orderpriority", 4)
    assert dealt.groupBy("o_custkey").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    spread = dealt.groupBy("o_orderpriority", "fold").count().groupBy("o_orderpriority").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.filter("d > 1").count() == 0
    rows = folds.with_folds(orders, dealt, "o_custkey", F.col("o_orderstatus") == "F")
    assert rows.filter("o_orderstatus = 'F' and fold is not null").count() == 0


def test_phones_fall_back_to_lemma(spark):
    words = spark.createDataFrame([("cats", "cat"), ("dog", "dog"), ("x", "y")], "word string, lemma string")
    table = spark.createDataFrame([("cat", 1, 3), ("dog", 2, 9), ("dog", 1, 4)], "word string, variant int, n_phones int")
    assert {r["word"]: r["n_phones"] for r in lexicon.phones(words, table).collect()} == {"cats": 3, "dog": 4, "x": None}


def test_merge_rules(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, g string, x double")
    b = spark.createDataFrame([(1, "z", 5.0), (3, "y", 6.0)], "k int, g string, y double")
    assert merge.merge(a, b, "k").first()["g"] == "a" and merge.merge(a, b, "k", prefer="right").first()["g"] == "z"
    assert merge.empty_columns(a.withColumn("e", F.lit(None).cast("int")), ["x", "e"]) == ["e"]
    assert merge.prefixed(a, "g", "x") == ["g", "x"] and merge.numeric_named(a, "x") == ["x"]
    assert merge.without(a, ["x", "nope"])[1] == ["nope"]
    assert merge.synonyms(a, {"Key": ["K", "id"], "none": ["q"]}).columns == ["Key", "none"]
    with pytest.raises(ValueError, match="q"):
        merge.require_columns(a, ["k", "q"])
    names = spark.createDataFrame([("ab",), ("abcd",), ("x",)], "n string")
    others = spark.createDataFrame([("abc",), ("a",), ("xyz",)], "n string")
    got = {tuple(r) for r in merge.prefix_matches(names, others, "n", "n").collect()}
    assert got == {("ab", "abc"), ("ab", "a"), ("abcd", "abc"), ("abcd", "a"), ("x", "xyz")}
    ranked = ranks.average_ranks(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (9.0,), (None,)], "v double"), "v")
    assert sorted((r["v"], r["rank"]) for r in ranked.filter("v is not null").collect()) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (9.0, 4.0)]


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, "c"), (2.0, "c"), (3.0, "p"), (4.0, "p"), (None, "p")], "x double, g string")
    assert prep.medians(df, ["x"]) == {"x": 2.5}
    assert [r["x"] for r in prep.imputed(df, {"x": 2.5}).collect()][-1] == 2.5
    stats = prep.control_stats(df, ["x"], F.col("g") == "c")
    assert stats["x"] == (1.5, pytest.approx(0.70710678))
    one = prep.control_stats(df.filter("x = 1"), ["x"], F.col("g") == "c")
    assert one["x"] == (1.0, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = 50 + 10 * x[:, 0] - 4 * x[:, 2] + rng.normal(size=400)
    return spark.createDataFrame([(i, *map(float, r), float(v), i % 4) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, d double, y double, fold int").cache()


def test_selection(table):
    cols = list("abcd")
    assert [c for c, _ in selection.forward_selection(table, cols, "y")][:2] == ["a", "c"]
    ranks = dict(selection.recursive_elimination(table, cols, "y", keep=2, step=1))
    assert ranks["a"] == ranks["c"] == 1 and {ranks["b"], ranks["d"]} == {2, 3}
    assert selection.by_importance(table, cols, "y", 1)[0][0] == "a"
    mi = {r["feature"]: r["mi"] for r in selection.mutual_information(table, cols, "y").collect()}
    assert max(mi, key=mi.get) == "a"
    assert selection.simple_set(["lex_ttr", "zzz", "poslm_kn_bigram_ce_mean"], ("kn",)) == ["lex_ttr", "poslm_kn_bigram_ce_mean"]


def test_forward_selection_equals_fits_on_rows(spark, table):
    """Against fits of the rows themselves, with nulls, an empty column, rows that only train and rows without a target."""
    rows = [r.asDict() for r in table.select("a", "b", "c", "d", "y", "fold").collect()]
    for i, r in enumerate(rows):
        r |= {"b": None if i % 9 == 0 else r["b"], "empty": None, "fold": None if i % 10 == 0 else r["fold"], "y": None if i % 50 == 1 else r["y"]}
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, empty double, y double, fold int")
    middle = float(np.median([r["b"] for r in rows if r["b"] is not None]))
    kept = [r for r in rows if r["y"] is not None]
    x = {c: np.array([middle if r[c] is None else r[c] for r in kept]) for c in "abcd"}
    y, fold = np.array([r["y"] for r in kept]), np.array([-1 if r["fold"] is None else r["fold"] for r in kept])

    def error(names):
        m, off = np.column_stack([np.ones(len(y)), *[x[c] for c in names]]), []
        for f in range(4):
            w = np.linalg.lstsq(m[fold != f], y[fold != f], rcond=None)[0]
            off.extend(np.abs(m[fold == f] @ w - y[fold == f]))
        return float(np.mean(off))

    names, path = [], []
    while len(names) < 4:
        e, c = min((error([*names, c]), c) for c in "abcd" if c not in names)
        names.append(c)
        path.append((c, e))
    best = min(range(4), key=lambda n: path[n][1])
    got = selection.forward_selection(df, ["a", "b", "c", "d", "empty"], "y")
    assert [c for c, _ in got] == names[: best + 1] and [e for _, e in got] == pytest.approx([e for _, e in path[: best + 1]])
    assert selection.forward_selection(df.limit(0), ["a", "b"], "y") == []


def test_columns_before_the_search(spark, table):
    df = table.select("*", F.lit(1.0).alias("flat"), F.when(F.col("id") % 3 == 0, F.col("a")).alias("holes"))
    assert selection.prefiltered(df, ["flat", "d", "holes", "c", "a"], "y") == ["d", "c", "a"]
    assert selection.prefiltered(df, ["flat", "d", "holes", "c", "a"], "y", k=2) == ["c", "a"]


def test_published_ranges(table):
    for name, space in models.SPACES.items():
        model = models.estimator(name)[0]
        points = models.drawn(name, 20)
        assert points == models.drawn(name, 20) != models.drawn(name, 20, seed=1)
        for point in points:
            assert set(point) == set(space) and all(model.hasParam(p) for p in point)
            for p, (kind, *of) in space.items():
                assert point[p] in of[0] if kind == "of" else of[0] <= float(point[p]) <= of[1]
                assert kind != "step" or (point[p] - of[0]) % of[2] == 0
    found = models.search(table, ["a", "c"], "y", "elasticnet", folds=2, draws=2, published=True)
    assert len(found.avgMetrics) == 2
    with pytest.raises(ValueError, match="ridge"):
        models.drawn("ridge", 1)


def test_models(spark, table, tmp_path):
    out = models.out_of_fold(table, ["a", "c"], "y", "elasticnet", 4)
    assert out.count() == 400 and out.agg(F.avg(F.abs(F.col("predicted") - F.col("y")))).first()[0] < 1.2
    found = models.search(table, ["a", "c"], "y", "ridge", folds=2, draws=2)
    models.save(found.bestModel, str(tmp_path / "m"))
    again = models.load_all([str(tmp_path / "m")])[0].transform(table)
    assert again.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 6
    cal = models.calibrate(out.withColumnsRenamed({"y": "actual"})).orderBy("predicted").select("calibrated")
    values = [r[0] for r in cal.collect()]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 100
    with pytest.raises(ValueError, match="nope"):
        models.estimator("nope")


def test_every_registered_model_fits(table):
    for name in models.REGISTRY:
        model, _ = models.estimator(name)
        if model.hasParam("maxIter"):
            model.set(model.maxIter, 5)
        if model.hasParam("numTrees"):
            model.set(model.numTrees, 3)
        assert models.pipeline(["a", "c"], model, "y").fit(table).transform(table).count() == 400


def test_ensembles(spark, table):
    rows = table.select("id", "y", (F.col("y") + 1).alias("m1"), (F.col("y") - 1).alias("m2"))
    best = ensemble.best_weights(ensemble.simplex_errors(rows, "y", ["m1", "m2"], 10)).first()
    assert (best["w0"], best["w1"]) == (0.5, 0.5) and best["mae"] == pytest.approx(0)
    _, stacked = ensemble.stack(rows, "y", ["m1", "m2"], 0.01)
    assert stacked.agg(F.avg(F.abs(F.col("stacked") - F.col("y")))).first()[0] < 0.2
    imp = ensemble.permutation_importance(table, "id", ["a", "b"], "y", lambda d: d.withColumn("prediction", 50 + 10 * F.col("a")), repeats=2).collect()
    assert imp[0]["importance_mean"] > 3 and imp[1]["importance_mean"] == pytest.approx(0)
    assert sorted(tuple(r) for r in ensemble.mean_absolute(spark.createDataFrame([(1.0, -2.0), (-3.0, 2.0)], "a double, b double")).collect()) == [("a", 2.0), ("b", 2.0)]


@pytest.mark.parametrize("form", ["json", "csv"])
def test_run_log_reads_back(spark, tmp_path, form):
    path = str(tmp_path / "log")
    for i in range(2):
        files.append_record(history.record(spark, {"model": f"a,{i}", "note": 'say "x"\\'}, {"mae": 1.5 + i}, {"model__C": 3}), path, form)
    got = files.read_records(spark, path, history.RECORD, form).collect()
    assert sorted((r["config"]["model"], r["config"]["note"], r["results"]["mae"], r["params"]["C"]) for r in got) == [("a,0", 'say "x"\\', 1.5, "3"), ("a,1", 'say "x"\\', 2.5, "3")]
    assert all(r["logged_at"] is not None for r in got)


def test_history(spark):
    runs = spark.createDataFrame([(1, "svr", 3.0), (2, "rf", 2.0), (3, "rf", 4.0), (4, "rf", None)], "run int, model_type string, mae double")
    assert history.best_run(runs, "mae", "run").first()["run"] == 2
    assert history.best_run(runs, "mae", "run", where={"model_type": "svr"}).first()["run"] == 1
    top = history.top_runs(runs, "mae", "run", 2).collect()
    assert sum(r["weight"] for r in top) == pytest.approx(1) and {r["run"] for r in top} == {1, 2}
    swept = history.sweep([{"x": 3}, {"x": 1}], lambda s: spark.createDataFrame([(float(s["x"]),)], "mae double"), "mae")
    assert [r["setting"] for r in swept.collect()] == [1, 0]


def test_quantiles_in_rounds_are_exact(spark):
    """Brackets of few values, ties, nulls and empty columns."""
    rng = np.random.default_rng(4)
    x, y = rng.lognormal(size=4001), rng.integers(0, 3, 4001).astype(float)
    rows = [(float(a), None if i % 7 == 0 else float(b), None) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    shares = [0.1, 0.5, 0.93]
    got = ranks.exact_quantiles(df, ["x", "y", "z"], shares, near=50)
    seen = [r[1] for r in rows if r[1] is not None]
    assert got["x"] == pytest.approx(np.quantile(x, shares)) and got["y"] == pytest.approx(np.quantile(seen, shares)) and got["z"] == [None] * 3
    assert ranks.exact_medians(df, ["x"]) == {"x": pytest.approx(float(np.median(x)))}


def test_running_sums_over_ranges(spark):
    rows = [(None if i % 4 == 0 else i % 4, i % 50, i, None if i % 9 == 0 else i) for i in range(1000)]
    df = spark.createDataFrame(rows, "p int, v int, k int, x int")
    got = ranks.running_sums(df, [F.desc("v"), F.col("k")], ["p"], F.col("x"), "s", rows=70).collect()
    for p in (None, 1, 2, 3):
        through = 0
        for r in sorted((r for r in got if r["p"] == p), key=lambda r: (-r["v"], r["k"])):
            through += r["x"] or 0
            assert r["s"] == through
    assert len(got) == 1000 and ranks.running_sums(df.limit(0), [F.col("v")], [], F.col("x"), "s").count() == 0


def test_row_numbers_over_ranges(spark):
    rows = [(i % 3, (i * 7919) % 1000, f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "p int, v int, k string")
    got = ranks.with_row_numbers(df, [F.col("v"), F.col("k")], ["p"], "n", rows=150).collect()
    for p in range(3):
        part = sorted((r["v"], r["k"], r["n"]) for r in got if r["p"] == p)
        assert [n for *_, n in part] == list(range(1, 1001))


def test_weights_are_refined_around_the_best(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame([(float(u), float(v), float(0.37 * u + 0.63 * v)) for u, v in zip(a, b, strict=True)], "a double, b double, y double")
    best = ensemble.refined_weights(df, "y", ["a", "b"]).first()
    assert (best["w0"], best["w1"]) == (pytest.approx(0.37), pytest.approx(0.63)) and best["mae"] == pytest.approx(0, abs=1e-9)


def test_permutation_moves_within_the_blocks_of_each_repeat(spark, monkeypatch):
    """Blocks are other rows in each repeat, so a value may go anywhere in the table; rows of one key stand by their values."""
    monkeypatch.setattr(ensemble, "BLOCK_ROWS", 50)
    data = [(i // 2 if i < 20 else i, float(i * i % 97), float(i % 7)) for i in range(600)]
    got = ensemble.permutation_importance(spark.createDataFrame(data, "id long, a double, y double"), "id", ["a"], "y", lambda d: d.withColumn("prediction", F.col("a") / 10), repeats=3).first()
    base = sum(abs(a / 10 - y) for _, a, y in data) / len(data)
    rises = []
    for r in range(3):
        blocks = {}
        for key, a, y in sorted(data, key=lambda d: (hashlib.md5(f"{d[0]}:{42 + r}".encode()).hexdigest(), d[1])):
            blocks.setdefault(hashlib.md5(f"{key}:{42 + r}".encode()).hexdigest()[:1], []).append((a, y))
        rises.append(sum(abs(rows[i - 1][0] / 10 - y) for rows in blocks.values() for i, (_, y) in enumerate(rows)) / len(data) - base)
    mean = sum(rises) / 3
    assert got["importance_mean"] == pytest.approx(mean, abs=1e-12)
    assert got["importance_std"] == pytest.approx((sum((x - mean) ** 2 for x in rises) / 3) ** 0.5, abs=1e-12)


def test_out_of_fold_stores_its_rows_once(spark, table, monkeypatch):
    kept = []
    monkeypatch.setattr(models, "checkpointed", lambda df: kept.append(df) or df.localCheckpoint())
    assert models.out_of_fold(table, ["a", "c"], "y", "ridge", 4).count() == table.filter("fold is not null").count()
    assert len(kept) == 1


def test_block_features_read_sequences_once(spark):
    """All blocks from one pass over the n-grams, equal to each block by itself; keys that repeat or are null, short and missing sequences too."""
    rows = [("a", 1, ["A", "B", "A", "C"]), ("a", 2, ["B"]), ("a", 3, ["A", "A"]), ("b", 1, ["C", "C", "D"]), ("b", 1, ["A"]), ("b", 1, ["A", "B", "C", "D"]), ("c", 1, ["A"]), ("d", 1, None), (None, 1, ["A", "B", "C"])]
    seqs = spark.createDataFrame(rows, "who string, utt int, tags array<string>")
    model = lm.train(seqs.filter("who = 'a'").select("tags"), "tags", 3)
    found = lm.block_features(seqs, "who", ["who", "utt"], "tags", model)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 2
    got = {r["who"]: r.asDict() for r in found.collect()}
    for prefix, (method, n) in lm.BLOCKS.items():
        for r in lm.speaker_features(lm.cross_entropy(seqs, ["who", "utt"], "tags", model, n, method), "who", prefix).collect():
            for c in r.asDict():
                assert got[r["who"]][c] == (pytest.approx(r[c], abs=1e-9) if isinstance(r[c], float) else r[c])


@pytest.mark.parametrize("query", ["poslm_features", "poslm_blocks"])
def test_one_pass_over_texts_trains_and_finds_ngrams(spark, sf, monkeypatch, query):
    stored = []
    monkeypatch.setattr(lm, "checkpointed", lambda df: stored.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.localCheckpoint())
    language_queries.QUERIES[query](spark, sf)
    assert sum("posexplode" in plan for plan in stored) == 1


def test_lines_are_not_shuffled_for_labels(spark, sf, monkeypatch):
    hinted = lambda: "ResolvedHint (strategy=broadcast)" in language_queries._sequences(spark, sf)._jdf.queryExecution().analyzed().toString()
    assert hinted()
    monkeypatch.setattr(language_queries, "BROADCAST_LABELS", 0)
    assert not hinted()


def test_training_within_equals_training(spark):
    """Rows that are not of the training, or where that is null, give n-grams to score and no counts."""
    rows = [(True, ["A", "B", "A"]), (True, ["A", "A"]), (False, ["C", "A", "B"]), (None, ["D"]), (True, None), (True, [])]
    seqs = spark.createDataFrame(rows, "training boolean, tags array<string>")
    within, seen = lm.train_within(seqs, "tags", F.col("training"))
    plain = lm.train(seqs.filter("training"), "tags")
    rows_of = lambda df: sorted(map(str, df.collect()))
    assert within.vocabulary == plain.vocabulary == 4
    for k in (1, 2, 3):
        assert rows_of(within.counts[k]) == rows_of(plain.counts[k]) == rows_of(lm.ngrams(seqs.filter("training"), [], "tags", 3).select(F.slice("context", 4 - k, k - 1).alias("context"), "tag").groupBy("context", "tag").agg(F.count("*").alias("c")))
    assert rows_of(seen) == rows_of(lm.ngrams(seqs, [], "tags", 3).select("context", "tag").distinct())


def test_statistics_read_counts_of_values(spark):
    rows = [("a", float(i % 4)) for i in range(40)] + [("b", 0.1)] * 3 + [("c", None), ("d", 5.0), (None, 1.0), (None, 2.0), ("a", float("nan"))]
    found = stats.summarise(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    assert "count(1) AS _n" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: r.asDict() for r in found.collect()}
    x = np.arange(40) % 4
    n, d = 40, x - x.mean()
    g1, g2 = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    assert got["a"]["std"] == pytest.approx(x.std(ddof=1)) and got["a"]["mad"] == 1.0 and got["a"]["skew"] == pytest.approx(g1, abs=1e-12)
    assert got["a"]["kurt"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    assert (got["b"]["std"], got["b"]["skew"], got["b"]["mad"]) == (0.0, None, 0.0) and got["c"]["mean"] is None and got["c"]["std"] is None
    assert got["d"]["std"] == 0.0 and got[None]["mean"] == 1.5 and got[None]["mad"] == 0.5


def test_density_stores_utterances_once(spark, monkeypatch):
    kept = []
    real = lexicon.checkpointed
    monkeypatch.setattr(lexicon, "checkpointed", lambda df: kept.append(df.columns) or real(df))
    words = spark.createDataFrame([("a", 0, "dogs", "NOUN", "dog"), ("a", 1, "run", "VERB", "run"), ("a", 1, "fast", "ADV", "fast")], "k string, utt_idx int, word string, tag string, lemma string")
    row = lexicon.density_features(lexicon.tag_counts(words, ["k", "utt_idx"]), spark.createDataFrame([("a", 60.0)], "k string, speech_sec double"), "k").first()
    assert row["den_words_per_min"] == pytest.approx(3) and row["den_words_utt_mean"] == 1.5
    assert len(kept) == 1


def test_quantiles_do_not_count_ties_again(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 2).cast("double").alias("v"))
    monkeypatch.setattr(ranks.F, "array_compact", lambda *a: pytest.fail("rows of ties are counted again"))
    assert ranks.exact_quantiles(df, ["v"], [0.25, 0.75], near=100) == {"v": [0.0, 1.0]}
