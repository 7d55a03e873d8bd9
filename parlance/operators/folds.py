"""Folds in which no group is split, balanced by stratum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.scores import equal_width_bin
from parlance.operators.ranks import with_row_numbers
from parlance.shared import checkpointed

#: Kinds of groups, by their rows in each stratum, that the driver deals at most; of more, large counts are rounded.
KINDS = 20_000
#: Of a kind of many groups, so many for each fold are dealt one by one, which evens out what larger groups leave.
SINGLY = 8


def stratified_group_folds(df: DataFrame, group: str, stratum: str, k: int = 4, seed: int = 42) -> DataFrame:
    """(group, stratum, fold) of each group: its most frequent stratum, and folds dealt within the stratum in hashed order.

    Each stratum begins with another fold, by its hash, so small ones do not all fall in the first. A stratum's groups
    by fold differ by one at most. Ties between strata: the lesser name.
    """
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("_n"))
    main = counts.groupBy(group).agg(F.min_by(stratum, F.struct(-F.col("_n"), stratum)).alias(stratum))
    hashed = main.select(group, stratum, F.md5(F.concat(F.col(group).cast("string"), F.lit(f":{seed}"))).alias("_h"))
    numbered = with_row_numbers(hashed, [F.col("_h"), F.col(group)], [stratum], "_i")
    turn = F.pmod(F.coalesce(F.crc32(F.col(stratum).cast("string")), F.lit(0)), F.lit(k))
    return numbered.select(group, stratum, F.pmod(F.col("_i") - 1 + turn, F.lit(k)).cast("int").alias("fold"))


def dealt_kinds(kinds: list[tuple[tuple[int, ...], int]], k: int) -> list[list[int]]:
    """For each (rows by stratum, number of groups) the folds of the groups that are dealt one by one; all folds have as many of the rest.

    Kinds of the most uneven rows go first; a group goes where the rows of each stratum, as shares of the stratum, then
    deviate least between folds, of equal ones to the fold of the fewest rows, then to the first.
    """
    whole = np.maximum(1, sum((np.array(v, float) * n for v, n in kinds), np.zeros(len(kinds[0][0]) if kinds else 0)))
    now = np.zeros((k, len(whole)))
    out: list[list[int]] = [[] for _ in kinds]
    for i in sorted(range(len(kinds)), key=lambda i: (-float(np.std(kinds[i][0])), tuple(-x for x in kinds[i][0]))):
        share = np.array(kinds[i][0], float) / whole
        for _ in range(kinds[i][1] if kinds[i][1] <= SINGLY * k else SINGLY * k + kinds[i][1] % k):
            sums, squares = now.sum(0), (now**2).sum(0)
            after = (squares - now**2 + (now + share) ** 2) / k - ((sums + share) / k) ** 2  # the variance of each stratum if a fold takes it
            cost = np.sqrt(np.maximum(after, 0)).mean(1)
            fold = min(range(k), key=lambda f: (round(float(cost[f]), 12), round(float(now[f] @ whole), 6), f))
            now[fold] += share
            out[i].append(fold)
    return out


def row_balanced_group_folds(df: DataFrame, group: str, stratum: str, k: int = 4, seed: int = 42) -> DataFrame:
    """(group, fold): no group is split, and the rows of each stratum are spread evenly over the folds.

    Groups of equal rows by stratum are one kind. All folds get as many of a kind, but for about SINGLY * k groups, which are
    dealt greedily in the driver; it sees kinds, not groups. Which groups these are goes by a seeded hash. With more
    than KINDS kinds, counts keep their three leading bits, then two, then one, in the dealing only. Null groups and strata are
    values of their own. No rows: no groups.
    """
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("_n"))
    strata = {r[0]: i for i, r in enumerate(sorted(counts.select(stratum).distinct().collect(), key=lambda r: (r[0] is not None, r[0])))}
    if not strata:
        return df.select(group, F.lit(0).alias("fold")).limit(0)
    n_of = lambda s: F.coalesce(F.sum(F.when(F.col(stratum).eqNullSafe(F.lit(s)), F.col("_n"))), F.lit(0))
    rows = checkpointed(counts.groupBy(group).agg(F.array(*[n_of(s) for s in strata]).alias("_v")))
    for bits in (0, 3, 2, 1):
        unit = lambda x: F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(x, F.lit(1)))) + 1 - bits))  # noqa: B023, E731
        kept = F.transform("_v", lambda x: (F.round(x / unit(x)) * unit(x)).cast("long")) if bits else F.col("_v")  # noqa: B023
        kinds = rows.groupBy(kept.alias("_v")).agg(F.count("*").alias("n"))
        if kinds.limit(KINDS + 1).count() <= KINDS:
            break
    found = [(tuple(r["_v"]), r["n"]) for r in kinds.orderBy("_v").limit(KINDS).collect()]
    left = [(list(v), folds) for (v, _), folds in zip(found, dealt_kinds(found, k), strict=True)]
    extra = df.sparkSession.createDataFrame(left, "_v array<bigint>, _left array<int>")
    hashed = rows.select(group, kept.alias("_v"), F.md5(F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(f":{seed}"))).alias("_h"))
    numbered = with_row_numbers(hashed, [F.col("_h"), F.col(group)], ["_v"], "_i").join(extra, "_v", "left")
    at = F.col("_i").cast("int") - 1
    turn = F.crc32(F.array_join(F.transform("_v", lambda x: x.cast("string")), ","))  # of kinds beyond KINDS even so, in turn from another fold each
    rest = F.when(F.col("_left").isNull(), at + turn).otherwise(at - F.size("_left"))
    return numbered.select(group, F.when(at < F.size("_left"), F.get("_left", at)).otherwise(F.pmod(rest, F.lit(k))).cast("int").alias("fold"))


def stratified_folds(df: DataFrame, key: str, value: str, k: int = 5, bins: int = 5, seed: int = 42) -> DataFrame:
    """(key, bin, fold) of rows without groups, balanced over ``bins`` equal bins of ``value``'s range; ``key`` names a row."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    binned = df.crossJoin(F.broadcast(ends)).select(key, equal_width_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
    return stratified_group_folds(binned, key, "bin", k, seed)


def group_folds(df: DataFrame, group: str, k: int = 4) -> DataFrame:
    """(group, n, fold): groups by size dealt to and fro, in running numbers by ranges of size and group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    numbered = with_row_numbers(sizes, [F.desc("n"), F.col(group)], [], "_i")
    at = F.pmod(F.col("_i") - 1, F.lit(2 * k))
    return numbered.select(group, "n", F.when(at < k, at).otherwise(2 * k - 1 - at).cast("int").alias("fold"))


def with_folds(df: DataFrame, folds: DataFrame, group: str, always_train: Column | None = None) -> DataFrame:
    """``df`` with ``fold``; null, which is in every training set and never scored, where ``always_train`` holds."""
    out = df.join(folds.select(group, "fold"), group, "left")
    return out if always_train is None else out.withColumn("fold", F.when(~always_train, F.col("fold")))


def fold_distribution(rows: DataFrame, stratum: str, k: int) -> DataFrame:
    """(fold, split, stratum, n) of every fold, split and stratum, zeros included."""
    counts = rows.groupBy("fold", stratum).agg(F.count("*").alias("c"))
    totals = counts.groupBy(stratum).agg(F.sum("c").alias("total"))
    every = totals.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    test = every.join(counts, ["fold", stratum], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return test.select("fold", stratum, F.explode(F.array(F.struct(F.lit("test").alias("split"), F.col("c").alias("n")), F.struct(F.lit("train").alias("split"), (F.col("total") - F.col("c")).alias("n")))).alias("s")).select("fold", "s.split", stratum, "s.n")
