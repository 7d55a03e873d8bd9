import shutil
import zlib
from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from parlance.llm import sharding
from parlance.llm.queries import op2_sharding
from parlance.llm.sharding import file_position, write_shards
from tests.llm import brute


def test_law_and_slots(spark, sf):
    rows = op2_sharding(spark, sf).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == 200 == len({r["doc_id"] for r in rows})
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r["law"] for r in rows} == {"rows"}


def test_columns_equal_a_plain_reading_of_the_files(spark, sf, tmp_path):
    """Sizes and checksums from the texts themselves; shard and slot from the written files, read one by one."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_sharding(spark, sf).collect():
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), None)
    path = str(tmp_path / "shards")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = {(r["shard"], r["slot"]): r["doc"]["doc_id"] for r in write_shards(docs, 5, path=path).collect()}
    found = {}
    for shard in range(5):
        for file in sorted(Path(path, f"shard={shard}").glob("*.parquet")):
            for row in pq.ParquetFile(file).read().to_pylist():
                found[shard, row["slot"]] = row["doc"]["doc_id"]
    assert found == told and len(found) == len(texts)
    n = len(texts)
    assert [sum(k[0] == s for k in found) for s in range(5)] == [(s + 1) * n // 5 - s * n // 5 for s in range(5)]


@pytest.mark.parametrize("keyed", [True, False])
def test_equal_rows_part(spark, tmp_path, keyed):
    """Of pairs of equal rows about one in ``shards`` has both in one shard, and they are not neighbours."""
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat(cast(id as string), 40) as text")
    docs = docs.union(docs)
    if keyed:
        docs.coalesce(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    out = write_shards(docs, 8, bucket_bytes=8_000, row_key=file_position() if keyed else None)
    at = defaultdict(list)
    for r in out.select("doc.doc_id", "shard", "slot").collect():
        at[r[0]].append((r[1], r[2]))
    pairs = list(at.values())
    assert len(pairs) == 2000 and all(len(x) == 2 for x in pairs)
    same = [abs(a[1] - b[1]) for a, b in pairs if a[0] == b[0]]
    assert 0.09 < len(same) / 2000 < 0.165
    assert sorted(same)[len(same) // 2] > 50


def test_positions_in_folders_differ(spark, tmp_path):
    """Partitions and folders that hold files of one name; a moved table keeps its positions below its root."""
    docs = spark.range(100).selectExpr("1 as doc_id", "'same' as text", "id % 2 as half")
    docs.coalesce(1).write.partitionBy("half").parquet(f"{tmp_path}/a/table")
    docs.filter("half = 0").drop("half").coalesce(1).write.parquet(f"{tmp_path}/b/plain-{'0' * 32}/x")
    for folder in ("c", "d"):
        shutil.copytree(f"{tmp_path}/a/table", f"{tmp_path}/{folder}/table")
    shutil.copytree(f"{tmp_path}/b/plain-{'0' * 32}/x", f"{tmp_path}/b/plain-{'1' * 32}/x")
    at = lambda key, *paths: {r[0] for r in spark.read.parquet(*(f"{tmp_path}/{p}" for p in paths)).select(key).collect()}
    assert len(at(file_position(), "a/table")) == len(at(file_position("table"), "a/table")) == 100
    assert len(at(file_position(), "c/table/half=0", "d/table/half=0")) == 100
    assert at(file_position("table"), "c/table") == at(file_position("table"), "d/table") == at(file_position("table"), "a/table")
    assert at(file_position(), f"b/plain-{'0' * 32}/x") == at(file_position(), f"b/plain-{'1' * 32}/x")  # runs


def test_several_buckets_a_task(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = lambda: [tuple(r) for r in write_shards(docs, 3, bucket_bytes=20_000, row_key=file_position()).selectExpr("shard", "slot", "doc.doc_id").orderBy("shard", "slot").collect()]
    once = order()
    monkeypatch.setattr(sharding, "MAX_TASKS", 3)
    assert order() == once


def test_shuffles_and_repeats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two, other = (write_shards(docs, 3, seed=s, bucket_bytes=40_000) for s in (1, 1, 2))
    order = lambda df: [r[0] for r in df.orderBy("shard", "slot").select("doc.doc_id").collect()]
    assert order(one) == order(two) != order(other)
    assert sorted(order(one)) == list(range(200)) != order(one)
    assert {tuple(r) for r in one.select("doc.*").collect()} == {tuple(r) for r in docs.collect()}


def test_awkward(spark):
    df = brute.awkward(spark)
    out = write_shards(df, 40)
    assert out.select("doc.*").columns == df.columns and out.count() == df.count()
    assert out.groupBy("shard").count().filter("count > 1").count() == 0
    assert write_shards(df.limit(0), 4).count() == 0
