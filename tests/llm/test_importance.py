import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import importance
from parlance.llm.importance import Features, bracket, draw_highest, drawn_documents, importance_resample, word_crcs
from parlance.llm.queries import op11_importance_resampling
from parlance.llm.storage import written
from parlance.llm.text import buffers
from tests.llm import brute


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, share=(5, 100), least=20):
    """id -> (n_features, weight, score, rank), straight from the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for counts, texts in ((s, docs.values()), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 10000) / ((a + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s.tolist(), t.tolist())]
    out, can = {}, []
    for i, text in docs.items():
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(found), weight, score, None]
        can += [(-score, i)] * (len(words) >= least)
    for k, (_, i) in enumerate(sorted(can)[: share[0] * len(can) // share[1]]):
        out[i][3] = k + 1
    return {i: tuple(x) for i, x in out.items()}


def test_query_equals_the_definition(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = op11_importance_resampling(spark, sf).collect()
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows}
    assert len(rows) == len(docs) and got == plain(docs, target)


@pytest.mark.parametrize("share", [(0, 100), (37, 100), (1, 1)])
def test_shares_and_ranges(spark, sf, share, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 7)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain({r["doc_id"]: r["text"] for r in docs.collect()}, [r["text"] for r in target.collect()], share)
    ranked = importance_resample(docs, target, share)
    assert {r["doc_id"]: r["rank"] for r in ranked.collect()} == {i: x[3] for i, x in want.items()}
    assert drawn_documents(docs, ranked).count() == sum(x[3] is not None for x in want.values())


def test_crcs_of_words_and_runs():
    rng = np.random.default_rng(1)
    words = ["a", "ab", "é漢", "x" * 63, "y" * 64, "z" * 65, "w" * 300, "v" * 129, *("".join(map(chr, rng.integers(97, 123, n))) for n in range(1, 140, 3))]
    texts = [" ".join(words), "", " ".join(reversed(words)).upper(), "one", "?!", "a-b_c"]
    ((_, raw, off),) = buffers(pa.array([t.encode() for t in texts], pa.binary()))
    found = Features(raw, off)
    got = sorted(x for _, bucket in found.runs(3, 10000) for x in bucket.tolist())
    assert got == sorted(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])
    assert word_crcs(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int)).tolist() == []


@pytest.mark.parametrize("half_width", [1e-9, 0.002, 0.3])
def test_bracket_holds_the_kth(spark, half_width):
    """Also where the sketch is coarse, the bracket is far too narrow at first, and one score is that of a third of the rows."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 50).otherwise(F.pmod(F.xxhash64("id"), F.lit(100))).cast("long").alias("score"))
    values = sorted((r["score"] for r in rows.collect()), reverse=True)
    for k in (1, 2, 700, 1500, 2999, 3000):
        low, high, above, within = bracket(rows, "score", 3000, k, half_width, accuracy=5)
        held = [v for v in values if (low is None or v >= low) and (high is None or v <= high)]
        assert above == sum(high is not None and v > high for v in values) and within == len(held)
        assert held[k - above - 1] == values[k - 1]


def test_ties_and_repeats(spark):
    rows = [(i % 5 if i % 7 else None, 3) for i in range(40)] + [(9, 4), (8, 2)]
    scored = written(spark.createDataFrame(rows, "doc_id long, score long"), "scored")
    out = draw_highest(scored, (1, 2), F.lit(True)).collect()
    assert len(out) == 42 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 22))
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])]
    assert order == sorted((-s, i is None, i or 0) for i, s in rows)[:21]


def test_awkward(spark):
    df = brute.awkward(spark)
    target = df.select(F.col("text").alias("said"))
    out = importance_resample(df, target, (1, 2), least_words=3, target_text_col="said")
    rows = out.collect()
    assert len(rows) == df.count() and all(r["weight"] == 0 == r["n_features"] for r in rows if r["doc_id"] in (5, 6, 7, 13))
    n = sum(r["n_words"] >= 3 for r in rows)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, n // 2 + 1))
    assert importance_resample(df.limit(0), target, target_text_col="said").count() == 0
    assert importance_resample(df, target.limit(0), target_text_col="said").count() == df.count()
    assert drawn_documents(df, out).columns == df.columns
