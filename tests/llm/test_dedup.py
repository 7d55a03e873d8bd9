import random

import pytest

from parlance.llm.components import connected_components
from parlance.llm.dedup import banding, drop_near_duplicates, near_duplicates
from tests.llm import brute


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_equals_brute_force(spark, threshold):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    docs, base = {}, [rng.choices(vocab, k=60) for _ in range(12)]
    for i in range(220):
        w = list(base[i % 12])
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_duplicates(df, threshold).collect()}
    want = brute.components(docs, round(threshold * 100))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(brute.shingles(t)) and got[i]["kept"] == (want[i] == i) for i, t in docs.items())


def test_large_bucket_in_blocks(spark, monkeypatch):
    """More members than a block holds: links across blocks are found."""
    from parlance.llm import dedup

    monkeypatch.setattr(dedup, "BLOCK_DOCS", 5)
    words = brute.BASE.split() * 3
    docs = {i: " ".join([*words[:i], "odd", *words[i + 1 :]]) for i in range(50)}
    got = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.components(docs, 80)


@pytest.mark.parametrize("block", [3, 512])
def test_random_sets_in_small_blocks(spark, monkeypatch, block):
    """Chains of edits, so that a bucket's first set links with few of its members, and components meet across blocks only."""
    from parlance.llm import dedup

    monkeypatch.setattr(dedup, "BLOCK_DOCS", block)
    rng, docs = random.Random(9), {}
    for c in range(6):
        w = rng.choices([f"v{i}" for i in range(400)], k=80)
        for _ in range(30):
            for _ in range(rng.choice((0, 1, 1, 2))):
                w = list(w)
                w[rng.randrange(len(w))] = rng.choice("abcdefgh") + str(c)
            docs[len(docs) * 7 % 1009] = " ".join(w)
    got = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.components(docs, 80)


def test_pages_of_one_template_do_not_meet_again(spark, monkeypatch):
    """Sets of a hot bucket that share frequent shingles only go to no second comparison; near copies among them link."""
    from parlance.llm import dedup

    monkeypatch.setattr(dedup, "BLOCK_DOCS", 20)
    sent, across = [], dedup._across_blocks

    def seen(*args):
        pairs = across(*args)
        sent.append(pairs.count())
        return pairs

    monkeypatch.setattr(dedup, "_across_blocks", seen)
    rnd = random.Random(4)
    template = " ".join(f"t{i}" for i in range(70))
    own = {i: [f"w{rnd.randrange(10**7)}" for _ in range(33)] for i in range(300)}
    texts = {i: f"{template} {' '.join(w)}" for i, w in own.items()}
    texts |= {1000 + i: f"{template} {' '.join([*own[i][:-2], 'x', 'y'])}" for i in range(0, 300, 60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(df, 0.85).collect()}
    assert found == brute.components(texts, 85) and sum(i != c for i, c in found.items()) == 5
    assert sent and sum(sent) <= 5 * 40  # a near copy and its source share some 20 rare shingles, most as one bucket


@pytest.mark.parametrize("ids", [4_000_000, 0])
def test_only_texts_to_compare_are_shuffled(spark, monkeypatch, ids):
    """Each comparison, also that across blocks, drops the texts of other ids by a broadcast; beyond its bound links are the same."""
    from parlance.llm import dedup

    seen, verified = [], dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda pairs, sets, h: seen.append(sets._jdf.queryExecution().analyzed().toString()) or verified(pairs, sets, h))
    monkeypatch.setattr(dedup, "BLOCK_DOCS", 5)
    monkeypatch.setattr(dedup, "BROADCAST_IDS", ids)
    rnd, words = random.Random(6), brute.BASE.split() * 3
    docs = {i: " ".join([*words[:i], "odd", *words[i + 1 :]]) for i in range(40)}
    docs |= {100 + i: " ".join(f"w{rnd.randrange(10**7)}" for _ in range(40)) for i in range(60)}
    df = spark.createDataFrame([*docs.items(), (3, docs[3])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 0.8).collect()}
    assert got == brute.components(docs, 80)
    assert seen and all(("ResolvedHint (strategy=broadcast)" in plan) == (ids > 0) for plan in seen)


def test_repeated_ids_of_different_texts(spark):
    """Each text of an id keeps its links, and what links with one text of an id links with all."""
    rng, rows, edges = random.Random(5), [], []
    text = lambda: rng.choices([f"u{i}" for i in range(900)], k=40)
    for i in range(40):
        one, two = text(), text()
        near = lambda w: [*w[:20], "changed", *w[21:]]
        rows += [(i, " ".join(one)), (i, " ".join(two)), (1000 + i, " ".join(near(one) + ["x"] * 8)), (500 + i, " ".join(near(two) + ["x"] * 8))]
        edges += [{i, 500 + i, 1000 + i}]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, 0.65).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == min(next(e for e in edges if r["doc_id"] in e)) for r in got)
    left = drop_near_duplicates(df, 0.65).collect()
    least = {i: min(t for d, t in rows if d == i) for i in range(40)}
    assert {r["doc_id"]: r["text"] for r in left} == least and len(left) == 40


def test_awkward(spark):
    df = brute.awkward(spark)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in near_duplicates(df, 0.8).collect()), key=str)
    by = {x[0]: x for x in got if x[0] is not None}
    assert len(got) == df.count()
    assert by[2][1] == by[3][1] == 1 and by[9][1] == 8 and by[11][1] == 10
    assert by[5] == (5, 5, True, 0) and by[7] == (7, 7, True, 0)
    assert sum(x[0] is None and x[2] for x in got) == 2
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {1, 5, 6, 7, 8, 10, 12, 13, 14} <= {r["doc_id"] for r in kept.collect()} and not {2, 3, 9, 11} & {r["doc_id"] for r in kept.collect()}
    assert kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id is null").count() == 2


def test_rows_that_go_by_a_shuffle(spark, monkeypatch):
    from parlance.llm import dedup

    df = brute.awkward(spark)
    rows = lambda: sorted(map(str, drop_near_duplicates(df).collect()))
    once = rows()
    monkeypatch.setattr(dedup, "BROADCAST_IDS", 0)
    assert rows() == once


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 100}


def test_banding_misses_little():
    bands, rows = banding(0.85)
    assert (1 - 0.85**rows) ** bands <= 1e-8
