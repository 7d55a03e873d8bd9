from collections import defaultdict

import pytest

from parlance.llm import mixing
from parlance.llm.mixing import RANGE, mix_sources, mixing_plan
from parlance.llm.queries import ORACLE_SQL, op4_source_mixing
from tests import oracle
from tests.llm import brute


def test_equals_sql(spark, sf):
    oracle.same(op4_source_mixing(spark, sf), oracle.connect(sf), ORACLE_SQL["op4_source_mixing"])


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("share", [0.4, 1.5, 5.0])
def test_targets_and_takes(spark, sf, share):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = mixing_plan(docs, share=share).collect()
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        longest[source[r["doc_id"]]] = max(longest[source[r["doc_id"]]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    want = targets(sizes, share=share)
    for r in rows:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in sizes)


@pytest.fixture
def crowded(spark, tmp_path):
    """Two thirds of the rows are equal in id and text, some without an id; a hot id has many texts."""
    words = lambda i: " ".join(["w"] * (i % 7 + 1) + [str(i)])
    rows = [(7, "the same text", "a")] * 900 + [(None, None, "b")] * 500 + [(None, "no id", None)] * 400
    rows += [(9, words(i), "a") for i in range(300)] + [(i, words(i), "abc"[i % 3]) for i in range(20, 600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("range_rows", [20, 5_000])
def test_rows_of_one_id_equal_sql(spark, crowded, monkeypatch, range_rows):
    import duckdb

    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{crowded}/documents.parquet/*.parquet'")
    oracle.same(op4_source_mixing(spark, crowded), con, ORACLE_SQL["op4_source_mixing"])


def test_no_range_holds_a_hot_key_whole(spark, crowded, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    docs = spark.read.parquet(f"{crowded}/documents.parquet")
    placed = mixing._planned(docs, [], 1.5, (5, 2, 1), 2, 11, None, "doc_id", "source", "text")
    sizes = [r["count"] for r in placed.groupBy("src", *RANGE).count().collect()]
    assert sum(sizes) == docs.count() and max(sizes) < 4 * 20 + 20
    assert mix_sources(docs).count() == placed.agg({"copies": "sum"}).first()[0]


def test_awkward(spark):
    df = brute.awkward(spark)
    plan = mixing_plan(df)
    assert plan.count() == df.count()
    mixed = mix_sources(df)
    assert mixed.columns == df.columns
    n = plan.agg({"copies": "sum"}).first()[0]
    assert mixed.count() == n
    assert mixing_plan(df.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing_plan(df.filter("trim(coalesce(text, '')) in ('', '\n\t')")).collect())
