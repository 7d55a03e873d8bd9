"""Plain forms of the operators' contracts, and a small table of awkward documents."""

import re
from collections import defaultdict

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def awkward(spark):
    """Nulls, empty and blank texts, ties, repeated rows and ids, a very long text, clashing names of columns."""
    words = BASE.split()
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, BASE, "a"), (2, BASE.upper(), "a"), (3, BASE + " phi", "b"), (4, " ".join(words[:-1] + ["chi"]), None),
        (5, None, "a"), (6, "", "b"), (7, " \n\t ", "b"), (8, "one two", "a"), (9, "one two", None), (10, long, "a"),
        (11, long + " end", "c"), (None, BASE, "a"), (None, None, None), (12, "\n".join(["same line here"] * 6), "c"),
        (13, "!!! ### $$$ *** " * 20, "c"), (1, BASE, "a"), (14, "été naïve — ünïcode 漢字 <|im_end|>", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extras = ("id", "size", "bucket", "shard", "slot", "doc", "row", "key", "h", "seed", "words", "score", "kept", "component", "n_shingles", "target", "copies", "path", "_leak", "bands")
    from pyspark.sql import functions as F

    return df.withColumns({x: F.lit(f"own {x}") for x in extras})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words(re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, hundredths):
    """id -> smallest id reachable, by all pairs of different sets that share a shingle."""
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    tried = set()
    for found in holders.values():
        for a in found:
            for b in found:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= hundredths * len(sets[a] | sets[b]):
                        p, q = root(a), root(b)
                        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}
