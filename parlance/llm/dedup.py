"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, components.

1. One pass over the texts gives each document its number of distinct word shingles, a 128-bit fingerprint of
   the set, and one key for each band of minima.
2. Documents of one set fold to one, by a combined aggregate, so exact copies cost nothing further. A set goes by
   the number of its first row, not by an id, so rows that repeat an id are no trouble.
3. Band buckets with the same members fold to one. What is left is dealt into blocks of bounded weight, each with the
   bucket's first set; in a block links are verified on the full sets and a spanning forest is given out.
4. Alternating large-star and small-star joins the links.
5. In buckets of several blocks, sets that are not yet joined to the bucket's largest component are compared with
   those of other blocks. Two sets that link share a shingle among the rarest of either, (1 - threshold) of its size
   and one, so such shingles are the buckets of this step: pages of one template, which share frequent shingles only,
   do not meet again. A bucket of near copies costs as many sets as it has; none is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.components import connected_components
from parlance.llm.storage import checkpointed, small_side, written
from parlance.llm.text import COEF, Words, buffers, mix, text_sets

#: Shingles in a block of a bucket, at most (one document may have more).
BLOCK_SHINGLES = 200_000
#: Documents in a block, at most.
BLOCK_DOCS = 512
#: So many ids, of documents that go or of those whose sets are compared, are broadcast (some 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def banding(threshold: float, rows: int = 5, miss: float = 1e-8) -> tuple[int, int]:
    """(bands, rows): so many bands that a pair exactly at ``threshold`` has no common bucket with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)), rows


def _minima(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the multiply-shift functions a * x + b (32 bits) over a set."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * a + b).min(axis=0), out=low)
    return low


def _profile(k: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * COEF[40])
        for batch in batches:
            for at, raw, off in buffers(batch.column(1)):
                size, one, two, keys = [], [], [], []
                for x in text_sets(Words(raw, off), k):
                    size.append(len(x))
                    m = mix(x)
                    one.append(int(m.sum(dtype=np.uint64)))
                    two.append(int(np.bitwise_xor.reduce(mix(x ^ COEF[41]))) if len(x) else 0)
                    if len(x):
                        low = _minima(x, a, b).reshape(bands, rows).astype(np.uint64)
                        key = salt.copy()
                        for i in range(rows):
                            key = mix(key ^ (low[:, i] * COEF[i]))
                        keys.append(key.view(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
                n = len(size)
                ends = np.cumsum([0, *(len(x) for x in keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        batch.column(2).slice(at, n),
                        pa.array(size, pa.int64()),
                        pa.array(np.array(one, np.uint64).view(np.int64)),
                        pa.array(np.array(two, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))),
                    ],
                    names=["id", "h", "n_shingles", "fp1", "fp2", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, off in buffers(batch.column(1)):
                sets = [x.tobytes() for x in text_sets(Words(raw, off), k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, shingles) -> a row for each shingle."""
    for batch in batches:
        for sid, shingles in zip(batch.column(0), batch.column(1), strict=True):
            one = np.frombuffer(shingles.as_buffer(), np.int64)
            for at in range(0, len(one), 1 << 16):
                part = one[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), sid.as_py(), np.int64)), pa.array(part)], names=["sid", "shingle"])


def _forest(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, hundredths: int, within: bool) -> list[tuple[int, int]]:
    """Links of a block pair that a spanning forest needs. Sizes of intersections are exact: counted through postings.

    ``within``: both blocks are the same; else only pairs from one to the other count.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    by_term = owner[np.argsort(term, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(term))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in np.flatnonzero(side == 0) if not within else range(len(sets)):
        own = term[at[i] : at[i + 1]]
        first, length = ends[own], ends[own + 1] - ends[own]
        run = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        shared = np.bincount(by_term[np.repeat(first, length) + run], minlength=len(sets))
        near = 100 * shared >= hundredths * (sizes + sizes[i] - shared)
        near[: i + 1 if within else 0] = False
        if not within:
            near &= side == 1
        for j in np.flatnonzero(near):
            p, q = root(i), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _links(hundredths: int):
    """Over rows sorted by group: (key, lo, hi, side, id, shingles) -> links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            sets = [np.frombuffer(x[2], np.uint64) for x in held]
            return _forest(np.array([x[1] for x in held]), sets, np.array([x[0] for x in held]), hundredths, key[1] == key[2])

        def packed(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            cols = [c.to_pylist() for c in batch.columns[:5]]
            for i, row in enumerate(zip(*cols, strict=True)):
                if row[:3] != key:
                    found += close()
                    held.clear()
                    key = row[:3]
                held.append((row[3], row[4], batch.column(5)[i].as_buffer()))
            if found:
                yield packed(found)
        if found := close():
            yield packed(found)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """Links (a, b) within groups of (band, lo, hi, side, sid)."""
    grouped = pairs.join(sets, "sid").select("band", "lo", "hi", "side", "sid", "shingles")
    grouped = grouped.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "side", "sid")
    return grouped.mapInArrow(_links(hundredths), "a long, b long")


def _blocks(n: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(weight / BLOCK_SHINGLES), F.ceil(n / BLOCK_DOCS)).cast("int")


def _dealt(blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("sid", F.lit(seed)), blocks).cast("int")


def _within_blocks(members: DataFrame, seed: int) -> DataFrame:
    """Groups of one block each; the bucket's first set is in all of its blocks, the others in one."""
    own = F.when(F.col("sid") == F.col("low"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_dealt(F.col("blocks"), seed)))
    return members.select("band", F.explode(own).alias("lo"), "sid").select("band", "lo", F.col("lo").alias("hi"), F.lit(0).alias("side"), "sid")


def _rare_buckets(large: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """(band, sid, n_shingles, component) of buckets of common rare shingles, for the sets of ``large`` (same columns).

    Only buckets of ``large`` count that several components share. Of each of their sets the rarest shingles among all
    of them, ties by value, are taken: n - ceil(threshold * n) + 1 of n, so any two sets that link have one in common.
    Buckets with the same sets fold to one.
    """
    mixed = large.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    own = checkpointed(large.join(mixed.select("band"), "band", "left_semi").select("sid", "n_shingles", "component").distinct())
    each = sets.join(own.select("sid"), "sid", "left_semi").mapInArrow(_exploded, "sid long, shingle long")
    each = written(each, "shingles")
    common = each.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1")  # those of one set are its rarest
    ranked = each.join(common, "shingle").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("common"))
    taken = F.col("n_shingles") - F.ceil(F.col("n_shingles") * hundredths / 100) + 1
    taken = F.greatest(F.lit(0), taken - (F.col("n_shingles") - F.size("common"))).cast("int")
    rare = ranked.join(own, "sid").select("sid", "n_shingles", "component", F.explode(F.slice("common", F.lit(1), taken)["shingle"]).alias("band"))
    rare = written(rare, "rare")
    stats = rare.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.min("sid").alias("low"), F.bit_xor(F.xxhash64("sid")).alias("who"), F.min("component").alias("least"), F.max("component").alias("most")
    )
    chosen = stats.filter("least < most").groupBy("n", "weight", "low", "who").agg(F.min("band").alias("band"))
    return rare.join(chosen.select("band"), "band", "left_semi")


def _across_blocks(large: DataFrame, seed: int) -> DataFrame:
    """Groups of pairs of blocks of ``large`` (band, sid, n_shingles, component): sets out of the largest component of their bucket with one another, and with those in it."""
    by = large.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    order = F.struct("n", F.negative("component"))
    plan = by.groupBy("band").agg(F.max_by("component", order).alias("main"), F.max_by("n", order).alias("main_n"), F.max_by("weight", order).alias("main_weight"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    out, inside = _blocks(F.col("n") - F.col("main_n"), F.col("weight") - F.col("main_weight")), _blocks(F.col("main_n"), F.col("main_weight"))
    plan = plan.filter("n > main_n").select("band", "main", out.alias("out"), inside.alias("inside"))
    rows = large.join(plan, "band").withColumn("is_out", F.col("component") != F.col("main"))
    own = F.when(F.col("is_out"), _dealt(F.col("out"), seed)).otherwise(F.col("out") + _dealt(F.col("inside"), seed))
    last = F.when(F.col("is_out"), F.col("out") + F.col("inside")).otherwise(F.col("out")) - 1
    rows = rows.select("band", "sid", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return rows.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sid")


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    k: int = 5,
    bands: int | None = None,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``, in which linked documents share a component.

    Two documents link if their sets of distinct ``k``-word shingles (A-Z folded) have Jaccard similarity
    ``threshold`` or more, a multiple of 0.01; ``component_id`` is the smallest id reachable and ``kept`` says that it
    is the document's own. Every link between different sets that shares a band is verified on the full sets, or both
    are joined by others that are; ``bands`` is by default so large that a pair at the threshold is missed with
    probability 1e-8 at most, and closer pairs far more rarely.

    Fewer than ``k`` words: one shingle of them all. Null, empty or blank text: no shingles, linked with nothing.
    Null id: never linked, component null, kept. Rows of the same id are one document, whatever their texts: what links
    with one links with all, and each has its row. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    hundredths = round(threshold * 100)
    bands = bands or banding(threshold, rows)[0]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(F.col(text_col)).alias("h"))
    schema = "id long, h long, n_shingles long, fp1 long, fp2 long, bands array<long>"
    profile = texts.mapInArrow(_profile(k, bands, rows, seed), schema)
    profile = written(profile.withColumn("row", F.monotonically_increasing_id()), "profile")  # numbers are fixed once written

    mark = ["n_shingles", "fp1", "fp2"]
    whole = profile.filter("n_shingles > 0 and id is not null")
    copies = checkpointed(whole.groupBy(*mark).agg(F.min("id").alias("rep"), F.min("row").alias("sid")))

    banded = whole.join(copies.select(F.col("sid").alias("row")), "row", "left_semi").select(F.col("row").alias("sid"), "n_shingles", F.explode("bands").alias("band"))
    stats = banded.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.min("sid").alias("low"), F.bit_xor(F.xxhash64("sid")).alias("who")
    ).filter("n > 1")
    chosen = stats.groupBy("n", "weight", "low", "who").agg(F.min("band").alias("band"))
    chosen = chosen.select("band", "low", _blocks(F.col("n"), F.col("weight")).alias("blocks"))
    members = checkpointed(banded.join(chosen, "band"))

    def sets(of: DataFrame) -> DataFrame:
        """(sid, shingles) of the sets of ``of``. Texts of other ids go before the shuffle, if the ids can be broadcast."""
        numbers = of.select(F.col("sid").alias("row")).distinct()
        wanted = checkpointed(profile.join(numbers, "row", "left_semi").select("id", "h", F.col("row").alias("sid")))
        near = texts.join(F.broadcast(wanted.select("id")), "id", "left_semi") if wanted.count() <= BROADCAST_IDS else texts
        return near.join(wanted, ["id", "h"]).select("sid", "t").mapInArrow(_sets(k), "sid long, shingles binary").dropDuplicates(["sid"])

    links = _verified(_within_blocks(members, seed), sets(members), hundredths).union(_of_one_id(whole, copies, mark))
    joined = connected_components(links)
    large = members.filter("blocks > 1").join(joined.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    large = checkpointed(large.select("band", "sid", "n_shingles", "component"))
    if large.limit(1).count():
        rare = checkpointed(_rare_buckets(large, sets(large), hundredths))
        pairs = _across_blocks(rare, seed)
        more = _verified(pairs, sets(pairs), hundredths)
        joined = connected_components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    named = copies.join(joined.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    folded = named.join(least, "component").select(*mark, "least")
    component = F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.col("least"))
    return profile.select("id", *mark).join(folded, mark, "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _of_one_id(whole: DataFrame, copies: DataFrame, mark: list[str]) -> DataFrame:
    """Links between the different sets of an id."""
    several = whole.groupBy("id").agg(F.min("fp1").alias("least"), F.max("fp1").alias("most")).filter("least <> most")
    own = whole.join(several, "id", "left_semi").join(copies, mark).groupBy("id", "sid").agg(F.lit(0))
    first = own.groupBy("id").agg(F.min("sid").alias("a"))
    return own.join(first, "id").filter("a <> sid").select("a", F.col("sid").alias("b"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of the smallest id; all columns stay.

    Of rows that repeat an id the one of the least text stays (null first), of those alike in it one that is the first
    by a hash of the other columns that can be hashed. Rows of a null id all stay. Empty table: no rows.
    """
    found = near_duplicates(docs, threshold, id_col=id_col, text_col=text_col, **options).filter("doc_id is not null")
    found = found.groupBy(F.col("doc_id").alias(id_col)).agg(F.bool_and("kept").alias("_kept"), F.count("*").alias("_n"))
    found = checkpointed(found.filter("not _kept or _n > 1"))
    kept = docs.join(small_side(found.filter("not _kept").select(id_col), BROADCAST_IDS), id_col, "left_anti").select(*docs.columns)
    repeated = found.filter("_kept").select(id_col)
    if repeated.limit(1).count():
        plain = [F.col(f.name) for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
        first = F.struct(F.col(text_col), F.xxhash64(*plain))
        of_each = kept.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), first).alias("_row")).select("_row.*")
        kept = kept.join(repeated, id_col, "left_anti").select(*docs.columns).union(of_each)
    return kept
