import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parlance.llm import ngram_model as nm
from tests.llm import brute

START = b"<s>"

def model(texts, order):
    """Base and modified Kneser-Ney scores in plain form; ``prob`` takes the words before and the word."""
    count = Counter(w for x in texts for w in x)
    size, n = len(count), sum(count.values())
    grams = Counter(g for x in texts for g in zip(*(([START] * (order - 1) + x)[i:] for i in range(order)), strict=False))
    by = lambda c: nm.discounts(*(Counter(c.values())[i] for i in (1, 2, 3, 4)))
    levels = []  # from the highest order to bigrams: counts, discounts, sums and counts of counts by context
    while True:
        levels.append((grams, by(grams), Counter(), defaultdict(Counter)))
        for g, k in grams.items():
            levels[-1][2][g[:-1]] += k
            levels[-1][3][g[:-1]][min(k, 3)] += 1
        grams = Counter(g[1:] for g in grams)  # after how many words
        if len(levels) == order - 1:
            break
    dc, types = by(grams), max(sum(grams.values()), 1)
    left = sum(dc[min(k, 3) - 1] for k in grams.values()) / types if texts else 1.0
    cut = lambda c, d: max(c - (d[min(c, 3) - 1] if c else 0), 0)

    def prob(before, w):
        p = cut(grams[(w,)], dc) / types + left / (size + 1)
        for i, (counts, d, total, follow) in enumerate(reversed(levels)):
            context = before[len(before) - i - 1 :]
            if total[context]:
                p = (cut(counts[(*context, w)], d) + sum(d[k - 1] * m for k, m in follow[context].items()) * p) / total[context]
        return p

    return count, n, prob, lambda w: (count[w] + 1) / (n + size + 1)


@pytest.mark.parametrize(("order", "sent"), [(2, 1_000_000), (2, 50), (3, 1_000_000), (3, 50)])
def test_equals_plain_form(spark, sf, monkeypatch, order, sent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(nm, "SENT_ENTRIES", sent)
    monkeypatch.setattr(nm, "FILE_ENTRIES", 4_000 if sent == 50 else 4_000_000)
    texts = {r["doc_id"]: [*(w.lower() for w in r["text"].encode().split()), b"</s>"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count, n, prob, base = model([t for i, t in texts.items() if not held[i]], order)
    for before in [(b"the",), (START,)] if order == 2 else [(b"of", b"the"), (START, START), (b"never seen", b"the")]:
        assert sum(prob(before, w) for w in count) + prob(before, b"never seen") == pytest.approx(1)
    gain = []
    for r in nm.held_out_scores(docs, order=order).collect():
        x = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(x), sum(w in count for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(base(w)) for w in x))
        padded = [START] * (order - 1) + x
        assert r["score"] == pytest.approx(sum(math.log10(prob(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(x)))
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"]) / r["n_tokens"])
    assert sum(gain) / len(gain) > 0.3


def test_awkward(spark):
    df = brute.awkward(spark)
    rows = nm.held_out_scores(df).collect()
    assert len(rows) == df.count() and all(r["score"] < 0 and r["n_tokens"] > 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (5, 6, 7)} == {1}
    assert nm.held_out_scores(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="order"):
        nm.train(df, order=4)


@pytest.mark.parametrize("largest", [200, 60_000, 2**31, 2**40])
def test_counts_of_any_width(tmp_path, largest):
    counts = np.array([1, largest, 7], np.uint64)
    nm._save(str(tmp_path), "times-0", nm._narrow(counts))
    assert nm._map_narrow(str(tmp_path), "times-0", 3).tolist() == counts.tolist()
    merged = nm._merged([np.array([5, 9, 9], np.uint64)], [counts], [np.array([1, 2, 3])])
    assert [x.tolist() for x in merged] == [[5, 9], [1, largest + 7], [1, 2]]
