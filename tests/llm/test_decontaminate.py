import itertools
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import decontaminate as dc
from parlance.llm.queries import op6_decontamination
from tests.llm import brute


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def overlaps(docs, items, window=13, share=0.8):
    """All pairs by common seeds and windows around them, in plain form."""
    span, out = 9, {}
    seeds = {}
    for item, text in items:
        w = words(text)
        for p in range(len(w) - span + 1):
            for m, mask in enumerate(dc.MASKS):
                seeds.setdefault((m, *(w[p + i] for i in mask)), []).append((item, p, w))
    for doc, text in docs:
        d = words(text)
        for p in range(len(d) - span + 1):
            for m, mask in enumerate(dc.MASKS):
                for item, at, w in seeds.get((m, *(d[p + i] for i in mask)), ()):
                    low = max(0, at - window + 1)
                    part, first = w[low : low + 2 * window + span], p - at + low
                    equal = [0 <= first + k < len(d) and d[first + k] == x for k, x in enumerate(part)]
                    wide = min(len(part), window)
                    best = max(sum(equal[s : s + wide]) for s in range(len(part) - wide + 1))
                    if best >= wide * share:
                        out[doc, item] = max(out.get((doc, item), 0), best)
    return out


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rng = random.Random(2)
    rows = [tuple(r) for r in docs]
    for i in range(60):  # passages with substituted words, and cut ones
        w = rng.choice(items)[1].split()
        w = [x if rng.random() > 0.12 else "changed" for x in w][rng.randrange(4) : len(w) - rng.randrange(4)]
        rows.append((1000 + i, " ".join(["before"] * rng.randrange(20) + w + ["after"] * rng.randrange(20))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = overlaps(rows, items)
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in dc.benchmark_overlaps(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len({d for d, _ in want if d >= 1000}) > 40
    whole = {d for d, t in rows if any(i[1] in t for i in items)}
    assert whole <= {d for d, _ in want}


def test_native_plan(spark, sf):
    plan = op6_decontamination(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_shuffled_benchmark_is_the_same(spark, sf, monkeypatch):
    once = {tuple(map(str, r)) for r in op6_decontamination(spark, sf).collect()}
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    assert {tuple(map(str, r)) for r in op6_decontamination(spark, sf).collect()} == once


def test_awkward(spark):
    df = brute.awkward(spark)
    bench = spark.createDataFrame([(1, brute.BASE), (2, None), (3, "one two"), (None, ""), (4, brute.BASE)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    rows = dc.contamination(df, bench).collect()
    assert len(rows) == df.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["items"] == [1, 4] and by[2]["contaminated"] and not by[8]["contaminated"] and by[5]["items"] == []
    left = dc.drop_contaminated(df, bench)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {None, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14}
    assert [r["text"] for r in left.filter("doc_id is null").collect()] == [None]  # the other row of a null id has the item
    assert dc.contamination(df.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in dc.contamination(df, bench.limit(0)).collect())


def every_window(docs, items, window=13, share=0.8):
    """All pairs by every window at every place, without seeds."""
    out = {}
    for doc, d in docs:
        for item, w in items:
            wide = min(len(w), window)
            for first in range(-len(w), len(d) + 1) if w else ():
                equal = [0 <= first + k < len(d) and d[first + k] == x for k, x in enumerate(w)]
                best = max(sum(equal[s : s + wide]) for s in range(len(w) - wide + 1))
                if best >= wide * share:
                    out[doc, item] = max(out.get((doc, item), 0), best)
    return out


def test_every_allowed_substitution_is_found(spark, monkeypatch):
    items, docs = [], []
    for n in range(1, 16):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, item))
        for k in range(4):
            for lost in itertools.combinations(range(n), k):
                edited = ["other" if i in lost else x for i, x in enumerate(item)]
                docs += [(len(docs), edited), (len(docs) + 1, ["before", *edited, "after"])]
        docs += [(len(docs) + i, item[a : n - b]) for i, (a, b) in enumerate(itertools.product(range(3), range(3)))]
    want = every_window(docs, items)
    assert len(want) > 800 and {i for _, i in want} == set(range(1, 16))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for seeds in (dc.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(dc, "BROADCAST_SEEDS", seeds)
        assert {(r["doc_id"], r["item_id"]): r["matched"] for r in dc.benchmark_overlaps(df, bench, short_items=True).collect()} == want


def test_rows_of_one_id_go_by_their_texts(spark):
    rows = [(None, brute.BASE), (None, "a clean text of no interest"), (5, f"x {brute.BASE} y"), (5, "another clean one"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_leak", F.lit(1)).withColumn("text_hash", F.lit(2))
    bench = spark.createDataFrame([(1, brute.BASE)], "item_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in dc.drop_contaminated(df, bench).collect()} == {rows[1], rows[3], rows[4]}
    assert sorted(map(str, ((r["doc_id"], r["contaminated"]) for r in dc.contamination(df, bench).collect()))) == sorted(map(str, [(None, True), (None, False), (5, True), (5, False), (6, False)]))


def test_long_words_are_not_broadcast(spark, monkeypatch):
    """The benchmark's bytes are bounded, not only its rows; the result is the same."""
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 1)
    bench = spark.createDataFrame([(1, brute.BASE), (2, "w" * 100_000 + " " + brute.BASE)], "item_id long, text string")
    df = spark.createDataFrame([(1, brute.BASE), (2, "nothing here"), (2, brute.BASE)], "doc_id long, text string")
    assert "ResolvedHint (strategy=broadcast)" not in dc.benchmark_overlaps(df, bench)._jdf.queryExecution().analyzed().toString()
    assert sorted((r["doc_id"], r["n_items"]) for r in dc.contamination(df, bench).collect()) == [(1, 2), (2, 0), (2, 2)]


def test_scripts_without_spaces(spark):
    item = "北京是中华人民共和国的首都也是全国政治中心"
    docs = [(1, f"我们知道{item}没有问题"), (2, f"我们知道{item[:5]}某{item[6:]}没有"), (3, "这是完全不同的一段文字没有任何关系的内容"), (4, "ภาษาไทยเป็นภาษาที่สวยงามมากจริงๆ")]
    bench = spark.createDataFrame([(1, item), (2, "เป็นภาษาที่สวยงาม")], "item_id long, text string")
    found = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, short_items=True).collect()
    assert {r["doc_id"]: r["items"] for r in found} == {1: [1], 2: [1], 3: [], 4: [2]}


def test_query_finds_short_items(spark, tmp_path):
    spark.createDataFrame([(1, "who wrote the iliad"), (2, "an unrelated line of text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Who wrote the Iliad?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"]: r["items"] for r in op6_decontamination(spark, str(tmp_path)).collect()} == {1: [7], 2: []}
    left = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r["doc_id"] for r in left.collect()] == [2]


def test_stretches_are_as_whole_texts(spark, monkeypatch):
    """Passages across the edges of stretches, copies of an item, and both joins: as in plain form."""
    monkeypatch.setattr(dc, "STRETCH", 7)
    rng = random.Random(5)
    item = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(["a"] * rng.randrange(30) + [x if rng.random() > 0.1 else "b" for x in item[rng.randrange(12) :]] + ["c"] * rng.randrange(30))) for i in range(60)]
    items = [(1, " ".join(item)), (2, " ".join(item).upper()), (3, " ".join(item[5:21])), (4, "c c c c c c c c c c"), (None, " ".join(item))]
    want = overlaps(rows, items)
    assert len(want) > 200
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for seeds, size in ((dc.BROADCAST_SEEDS, dc.BROADCAST_BYTES), (0, dc.BROADCAST_BYTES), (0, 1)):
        monkeypatch.setattr(dc, "BROADCAST_SEEDS", seeds)
        monkeypatch.setattr(dc, "BROADCAST_BYTES", size)
        assert {(r["doc_id"], r["item_id"]): r["matched"] for r in dc.benchmark_overlaps(df, bench).collect()} == want


def test_a_hit_holds_the_words_around_it_only(spark):
    """A long text of passages throughout; with its words in each of its 72,000 hits it took 50 GB."""
    rows = [(1, f"{brute.BASE} " * 1500), (2, "nothing here " * 15_000)]
    bench = spark.createDataFrame([(1, brute.BASE)], "item_id long, text string")
    assert [tuple(r) for r in dc.benchmark_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).select("doc_id", "item_id", "matched").collect()] == [(1, 1, 13)]


def test_copies_of_items_are_no_more_seeds(spark, monkeypatch):
    bench = spark.createDataFrame([(i, brute.BASE) for i in range(500)], "item_id long, text string")
    df = spark.createDataFrame([(1, brute.BASE), (2, "nothing here")], "doc_id long, text string")
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 100)  # the item has 48 seeds
    assert "ResolvedHint (strategy=broadcast)" in dc.benchmark_overlaps(df, bench)._jdf.queryExecution().analyzed().toString()
    assert [(r["doc_id"], r["n_items"]) for r in dc.contamination(df, bench).orderBy("doc_id").collect()] == [(1, 500), (2, 0)]


def test_stage_drops_a_text_of_passages(spark, tmp_path):
    """Copies of an item and passages throughout a long text: the pipeline's stage asks for one overlap only."""
    spark.createDataFrame([(i, brute.BASE) for i in range(200)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"{brute.BASE} " * 1500), (2, "nothing here"), (1, "a clean text of the same id")]
    left = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(tuple(r) for r in left.collect()) == [rows[2], rows[1]]
