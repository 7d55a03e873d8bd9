"""Each stage against a plain form, on what its predecessor kept."""

import corpus_pipeline as cp
from parlance.llm.mixing import mixing_plan
from parlance.llm.storage import application_dir, written
from tests.llm import brute
from tests.llm.test_decontaminate import overlaps


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    first = written(cp.quality_classifier(spark, docs, sf), "t")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in first.collect()}
    assert first.columns == columns and kept < {r["doc_id"] for r in docs.collect()}
    assert sum(i in kept for i, q in quality.items() if q == 1) >= 0.95 * sum(q == 1 for q in quality.values())
    assert sum(i not in kept for i, q in quality.items() if q == 0) >= 0.9 * sum(q == 0 for q in quality.values())

    second = written(cp.near_dedup(spark, first, sf), "t")
    roots = brute.components({r["doc_id"]: r["text"] for r in first.collect()}, 80)
    assert second.columns == columns and {r["doc_id"] for r in second.collect()} == {i for i, c in roots.items() if i == c}

    third = written(cp.decontamination(spark, second, sf), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _ in overlaps([(r["doc_id"], r["text"]) for r in second.collect()], items)}
    assert third.columns == columns and {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in second.collect()} - leaks

    fourth = written(cp.source_mixing(spark, third, sf), "t")
    copies = {r["doc_id"]: r["copies"] for r in mixing_plan(third).collect() if r["copies"]}
    assert fourth.columns == columns and {r["doc_id"]: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == copies

    last = cp.shuffled_shards(spark, fourth, sf)
    assert last.columns == [*columns, "shard", "slot"]
    assert sorted(tuple(r) for r in last.drop("shard", "slot").collect()) == sorted(tuple(r) for r in fourth.collect())
    sizes = [r["count"] for r in last.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]


def test_run_leaves_its_rows_only(spark, sf):
    from pathlib import Path
    from urllib.parse import urlparse

    folder = Path(urlparse(application_dir(spark)).path)
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = cp.run(spark, sf)
    (left,) = set(folder.iterdir()) - before
    assert rows.count() > 0 and left.name.startswith("pipeline-") and all(str(left) in f for f in rows.inputFiles())
