"""Benchmark decontamination by spaced-seed hashing, in native expressions only.

A mask takes some positions of a run of words and ignores the others, so a run with a substituted word still hits
by a mask that ignores its place. Hashes of the benchmark's runs are joined with those of each document's; around a
hit the words of both are compared position by position.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.storage import checkpointed, small_side

#: Positions that count, of runs of 9 words. In 9 to 13 words of which four fifths stay, one of them fits somewhere.
MASKS = ((0, 2, 4, 7, 8), (0, 1, 4, 5, 6), (2, 3, 5, 7, 8), (1, 2, 3, 6, 8))
#: The benchmark's seeds, each with the words around it, are broadcast up to so many rows and bytes; more are joined by a shuffle.
BROADCAST_SEEDS, BROADCAST_BYTES = 200_000, 64 << 20
#: Bytes of a seed alone; where those of all fit, runs that hit none go before the shuffle.
BARE_SEED = 32
#: So many documents that go are broadcast (some 40 bytes each); more are joined by a shuffle.
BROADCAST_LEAKS = 1_000_000
#: Runs of a text are taken so many at a time, with the words around them: a row of words, and the hits that a task holds at once, have a bound.
STRETCH = 512


#: Thai, Lao, Burmese, Khmer, kana and Han, which are written without spaces.
_UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case; empty for null. A letter of a script without spaces is a word."""
    low, gap = F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"
    by_letter = F.split(low, rf"{gap}|(?<={_UNSPACED})|(?={_UNSPACED})")
    return F.array_remove(F.when(text.rlike(_UNSPACED), by_letter).otherwise(F.split(low, gap)), "")


def _substituted(words: int, share: float) -> int:
    """How many of ``words`` may differ."""
    return words - ceil(words * share)


def _stretches(rows: DataFrame, keep: list[str], span: int, over: int, before: int, after: int) -> DataFrame:
    """Stretches of ``rows.words``: (``keep``..., stretch, words, low, high), whose runs begin at ``low`` to ``high`` of its words.

    Runs have ``span`` words and begin up to ``over`` words before the first and end as many after the last; each is in
    one stretch. That has ``before`` words ahead of its first run and ``after`` from where its last begins, if there are any.

    The outer explode keeps Spark from asking for the array's size below, which would make the words twice.
    """
    last = F.size("words") - span + over
    starts = F.when((F.size("words") > 0) & (last >= -over), F.sequence(F.lit(-over), last, F.lit(STRETCH)))

    def cut(start: Column) -> Column:
        first, end = F.greatest(F.lit(0), start - before), F.least(start + (STRETCH - 1), last)
        return F.struct(start.alias("stretch"), F.slice("words", first + 1, end - first + after).alias("words"), (start - first).alias("low"), (end - first).alias("high"))

    return rows.select(*keep, F.explode_outer(F.transform(starts, cut)).alias("cut")).filter("cut is not null").select(*keep, "cut.*")


def _seeds(rows: DataFrame, masks: list[tuple[int, tuple[int, ...]]], keep: list[str], low: Column, high: Column) -> DataFrame:
    """A row for each run of ``rows.words`` from place ``low`` to ``high`` and numbered mask: (``keep``..., words, pos, seed).

    A hash lacks the words that are not there: those before the first, and those behind the last.

    The outer explode keeps Spark from asking for the array's size below, which would make the words twice. All from
    the first explode to the join is one generated loop, so ``words`` is passed on without a copy. Nothing but the words
    around a hit may leave that loop, which holds all the hits of a row before it hands on the first.
    """
    hashed = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    places = F.when(low <= high, F.sequence(low, high))
    placed = hashed.select(*keep, "words", "h", F.explode_outer(places).alias("pos")).filter("pos is not null")
    seeds = [F.xxhash64(F.lit(m), *[F.get("h", F.col("pos") + i) for i in mask]) for m, mask in masks]
    return placed.select(*keep, "words", "pos", F.explode(F.array(*seeds)).alias("seed"))


def _most_equal(near: Column, item: Column, window: int) -> Column:
    """The greatest number of equal words, place by place, in ``window`` consecutive places of ``item``."""
    wide = F.least(F.size(item), F.lit(window))
    equal = F.zip_with(near, item, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    starts = F.sequence(F.lit(0), F.size(item) - wide)
    sums = lambda e: F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(e, s + 1, wide), F.lit(0), lambda x, y: x + y)))
    return F.get(F.transform(F.array(equal), sums), F.lit(0))  # equal is made once


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def _matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, masks: tuple[tuple[int, ...], ...] = MASKS, short_items: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, own, matched) of documents and different items, and the (item_id, own) of all; see benchmark_overlaps.

    ``own`` is the MD5 of an item's words: items of equal words are compared once, however often they are there.
    """
    span = max(map(max, masks)) + 1
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words")).withColumn("own", F.md5(F.concat_ws(" ", "words")))
    named_items = items.select("item_id", "own").distinct()
    items = items.select("own", "words").dropDuplicates(["own"])
    by_span = {span: list(enumerate(masks))}
    in_item = lambda rows, n: _seeds(rows, by_span[n], ["own"], F.lit(0), F.size("h") - n)
    seeds = in_item(items, span)
    if short_items:  # at most one round for each number of words under the span
        wide = F.least(F.size("words"), F.lit(window))
        number = len(masks)
        for n in sorted(r[0] for r in items.filter((wide > 0) & (wide < span)).select(wide).distinct().collect()):
            by_span[n] = list(enumerate(combinations(range(n), n - _substituted(n, share)), number))
            number += len(by_span[n])
            seeds = seeds.union(in_item(items.filter(wide == n), n))
    seeds = seeds.select("seed", "own", F.col("pos").alias("at"), F.col("words").alias("item"))
    all_masks, least = [m for found in by_span.values() for m in found], min(by_span)
    over = max(_substituted(n, share) for n in range(1, window + 1))
    # only the words that a check around the hit can reach
    low, around = F.greatest(F.lit(0), F.col("at") - window + 1), 2 * window + span
    seeds = seeds.select("seed", "own", F.col("at") - low, F.slice("item", low + 1, F.lit(around))).toDF("seed", "own", "at", "item").distinct()
    size = F.aggregate("item", F.lit(64).cast("long"), lambda n, w: n + F.octet_length(w) + 16)
    n_seeds, n_bytes = seeds.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    keep = ["doc_id", "text_hash"]
    texts = docs.select(F.col(id_col).alias("doc_id"), _text_hash(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    parts = _stretches(texts, keep, least, over, window - 1, around)
    runs = _seeds(parts, all_masks, [*keep, "stretch"], F.col("low"), F.col("high"))
    if n_seeds <= BROADCAST_SEEDS and n_bytes <= BROADCAST_BYTES:
        hits = runs.join(F.broadcast(seeds), "seed")
    else:  # words would be copied for each run that is sent, so they are joined to the hits
        sent = runs.select(*keep, "stretch", "pos", "seed")
        if n_seeds * BARE_SEED <= BROADCAST_BYTES:
            sent = sent.join(F.broadcast(seeds.select("seed").distinct()), "seed", "left_semi")
        # slices overlap, so their shuffled bytes are few, and Spark would take them for a small side
        found = sent.join(seeds.hint("merge"), "seed").drop("seed").distinct().hint("merge")
        named = parts.select(*[F.col(c).alias(f"_{c}") for c in (*keep, "stretch")], "words").dropDuplicates(["_doc_id", "_text_hash", "_stretch"])
        hits = named.join(found, F.col("_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_text_hash") == F.col("text_hash")) & (F.col("_stretch") == F.col("stretch")))
    first = F.col("pos") - F.col("at")  # where the item's slice begins in the stretch
    over = F.greatest(F.lit(0), -first)
    near = F.concat(F.array_repeat(F.lit(None).cast("string"), over), F.slice("words", first + over + 1, F.size("item")))
    # by an explode of its own the slice is made in the loop of the join; as a part of what follows it would take the stretch along
    hits = hits.select(*keep, "own", "item", F.explode(F.array(F.slice(near, F.lit(1), F.size("item")))).alias("near"))
    matched = _most_equal(F.col("near"), F.col("item"), window)
    enough = F.least(F.size("item"), F.lit(window)) * F.lit(share)
    # the filter comes after a maximum, else it would be the join's condition and end the generated loop
    found = hits.select(*keep, "own", F.get(F.transform(F.array(matched), lambda m: F.when(m >= enough, m)), F.lit(0)).alias("matched"))
    return found.groupBy(*keep, "own").agg(F.max("matched").cast("long").alias("matched")).filter("matched is not null"), named_items


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, masks: tuple[tuple[int, ...], ...] = MASKS, short_items: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, matched) of each document and item that overlap.

    They overlap if, at a common seed, ``window`` consecutive words of the item (all of a shorter one) that hold a part
    of the seed's run stand in the document with at least ``share`` of them equal, place by place. ``matched`` is the
    greatest number of equal words in such a window.

    With the masks as given, every window of 9 to 13 words of which four fifths are equal has a common seed, also at the
    edges of a document; other windows and shares need masks of their own. With ``short_items``, items of fewer words
    than a mask spans (9) are found too, by all choices of words that may be equal; without, they overlap with nothing.
    A document is an id (null too) with the xxhash64 of its text, so rows that repeat an id are told apart by their texts.
    Null and empty texts overlap with nothing. Items of null id count. Repeated rows: one row for a pair. Other columns are ignored. Empty tables: no rows.
    """
    pairs, items = _matches(docs, benchmark, window, share, masks, short_items, id_col, text_col, item_col, item_text_col)
    return pairs.join(items, "own").groupBy("doc_id", "text_hash", "item_id").agg(F.max("matched").alias("matched"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, contaminated, n_items, items, matched) of each row of ``docs``: the items its text overlaps, in order.

    Null id: a row like others. Rows that repeat an id: each by its own text. See benchmark_overlaps.
    """
    pairs = benchmark_overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    by_doc = pairs.groupBy(F.col("doc_id").alias("found"), "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.count("*").alias("n"), F.max("matched").alias("matched"))
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_hash(text_col).alias("own_hash"))
    return rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("found")) & (F.col("own_hash") == F.col("text_hash")), "left").select(
        "doc_id",
        (F.coalesce("n", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose own text overlaps an item; all columns stay, whatever their names.

    Null id and rows that repeat an id: each row goes or stays by its text. See benchmark_overlaps.
    """
    pairs, _ = _matches(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    leaks = checkpointed(pairs.select(F.col("doc_id").alias("_leak"), F.col("text_hash").alias("_leak_hash")).distinct())
    leaks = small_side(leaks, BROADCAST_LEAKS)
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["_leak"]) & (F.xxhash64(docs[text_col]) == leaks["_leak_hash"]), "left_anti")
