import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import periodic
from parlance.llm.periodic import WaveletTree, periodic_runs, repeated_ranks, runs_of
from parlance.llm.queries import op12_periodic_runs
from tests.llm import brute


def plain_runs(words, least=24, powers=3):
    """All runs by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, powers * q) and not any(all(words[t] == words[t + p] for t in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_query_equals_the_definition(spark, sf):
    rows = op12_periodic_runs(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    tried = 0
    for r in rows:
        words = brute.words(docs[r["doc_id"]])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs, tried = plain_runs(words), tried + 1
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(collapsed(words, runs))
    assert tried > 150 and sum(r["n_runs"] > 0 for r in rows) > 5


piece = st.one_of(
    st.lists(st.integers(0, 20), min_size=1, max_size=40),
    st.builds(lambda base, k, cut: (base * k)[: len(base) * k - cut], st.lists(st.integers(0, 3), min_size=1, max_size=30), st.integers(2, 8), st.integers(0, 3)),
    st.builds(lambda n, m, k: ([0] * n + [1] + [0] * m) * k, st.integers(0, 40), st.integers(0, 9), st.integers(1, 6)),
    st.builds(lambda a, k, b, m: ((a * k) + b) * m, st.lists(st.integers(0, 2), min_size=1, max_size=4), st.integers(1, 12), st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 6)),
)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(piece, max_size=3), min_size=1, max_size=4))
def test_runs_equal_all_periods_at_all_places(texts):
    texts = [np.array([w for x in t for w in x][:300], np.int64) for t in texts]
    for text, got in zip(texts, runs_of(texts), strict=True):
        assert [tuple(r) for r in got.tolist()] == plain_runs(text.tolist())


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    values = rng.permutation(1000)[:700]
    tree = WaveletTree(values)
    low = rng.integers(0, 699, 500)
    high = low + 1 + rng.integers(0, 700 - low)
    x = rng.integers(0, 1400, 500)
    assert tree.less(low, high, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, x)]
    k = rng.integers(0, high - low)
    assert tree.smallest(low, high, k).tolist() == [sorted(values[a:b])[i] for a, b, i in zip(low, high, k)]


def test_ranks_are_of_equal_words_and_nested():
    text = np.random.default_rng(4).integers(0, 2, 400)
    levels = repeated_ranks(text)
    for (b, ranks), (_, above) in zip(levels, [(0, np.zeros(400, int)), *levels]):
        words = [tuple(text[i : i + b]) for i in range(400 - b + 1)]
        assert all((words.count(w) > 1) == (r < 400) for w, r in zip(words, ranks))
        assert len({(w, r) for w, r in zip(words, ranks) if r < 400}) == len({r for r in ranks if r < 400}) == len({w for w in words if words.count(w) > 1})
        held = np.flatnonzero(ranks < 400)
        assert (np.diff(above[held][np.argsort(ranks[held], kind="stable")]) >= 0).all()


@pytest.mark.parametrize("words", [10, 250_000])
def test_awkward(spark, words, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_WORDS", words)
    df = brute.awkward(spark)
    rows = periodic_runs(df).collect()
    assert len(rows) == df.count()
    for r, text in zip(rows, (x["text"] for x in df.collect()), strict=True):
        found = brute.words(text)
        assert r["n_words"] == len(found)
        if len(found) < 1000:
            runs = plain_runs(found)
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == collapsed(found, runs)
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, least=8)
