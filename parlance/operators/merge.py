"""Keyed merges of feature tables, with their conflict rules and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.ranks import in_ranges
from parlance.shared import checkpointed


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def prefixed(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def numeric_named(df: DataFrame, *keywords: str) -> list[str]:
    """Numeric columns whose names hold a keyword."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, kind in df.dtypes if kind.startswith(kinds) and any(k in c.lower() for k in keywords)]


def without(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """(``df`` without the named columns, names that it does not have)."""
    return df.drop(*names), [n for n in names if n not in df.columns]


def merge(left: DataFrame, right: DataFrame, key: str, how: str = "inner", prefer: str = "left") -> DataFrame:
    """An equality join in which a column that both sides have is taken from the ``prefer`` side."""
    both = [c for c in left.columns if c in right.columns and c != key]
    return left.join(right.drop(*both), key, how) if prefer == "left" else left.drop(*both).join(right, key, how)


def merge_all(base: DataFrame, parts: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """``base`` with each (table, how) in turn; what is there already stays."""
    for part, how in parts:
        base = merge(base, part, key, how)
    return base


def coverage(joined: DataFrame, column: str) -> DataFrame:
    """(n_rows, n_found, share): how many rows have ``column``."""
    return joined.agg(F.count("*").alias("n_rows"), F.count(column).alias("n_found"), F.avg(F.col(column).isNotNull().cast("double")).alias("share"))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def missing_partners(left: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """(partner, n_missing): rows of ``left`` without a row in each other table."""
    out = None
    for name, other in others.items():
        row = left.join(other.select(key), key, "left_anti").agg(F.lit(name).alias("partner"), F.count("*").alias("n_missing"))
        out = row if out is None else out.unionByName(row)
    return out


def null_census(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null, n_rows) of each named column, from one pass."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_null"), F.col("_n").alias("n_rows")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def empty_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Names of the columns without any value."""
    if not columns:
        return []
    row = df.agg(*[F.count(c).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i] == 0]


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column, n), nulls a value too, the most frequent first."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(top) if top else out


def group_summary(df: DataFrame, group: str, value: str, cut: float = 93.8) -> DataFrame:
    """n, mean, sample deviation, ends of ``value`` by group, and whether the mean reaches ``cut``."""
    out = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.withColumn("verdict", F.when(F.col("mean") >= cut, "control range").otherwise("below control range"))


def largest_per_stem(files: DataFrame, stem: str, path: str, size: str) -> DataFrame:
    """The largest file of each stem; of equal ones the last path."""
    return files.groupBy(stem).agg(F.max_by(path, F.struct(size, path)).alias(path), F.max(size).alias(size))


def first_per_stem(files: DataFrame, stem: str, path: str) -> DataFrame:
    return files.groupBy(stem).agg(F.min(path).alias(path))


def _with_beginnings(parts):
    """Names in order, with those that are open at the start of their range -> (name, beginning) for each name that begins it, itself included."""
    open_ = None
    for part in parts:
        out = []
        for number, name, before in zip(part["part"], part["name"], part["open"], strict=True):
            if open_ is None or open_[0] != number:
                open_ = (number, sorted(before if before is not None else [], key=len))
            while open_[1] and not name.startswith(open_[1][-1]):
                open_[1].pop()
            open_[1].append(name)
            out += [(name, x) for x in open_[1]]
        yield pd.DataFrame(out, columns=["name", "beginning"])


def beginnings(names: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """(name, beginning): for each different name, not null, all names that it begins with, itself included.

    In the order of their bytes a name follows those that begin it, and those in between begin with them too, so a scan keeps the open
    ones in a stack. A range of the order starts with the open ones of its first name: its beginnings that are names.
    """
    different = names.select(F.col(name).alias("name")).filter("name is not null").distinct()
    placed = checkpointed(in_ranges(different, [F.col("name")], "part", rows))
    first = placed.groupBy("part").agg(F.min("name").alias("first"))
    parts = first.filter("first <> ''").select("part", F.explode(F.sequence(F.lit(0), F.length("first") - 1)).alias("n"), "first").select("part", F.expr("substring(first, 1, n)").alias("name"))
    open_ = parts.join(placed.select("name"), "name").groupBy("part").agg(F.collect_list("name").alias("open"))
    ordered = placed.join(open_, "part", "left").repartition("part").sortWithinPartitions("part", "name")
    return ordered.select("part", "name", "open").mapInPandas(_with_beginnings, "name string, beginning string")


def prefix_matches(a: DataFrame, b: DataFrame, a_col: str, b_col: str, rows: int | None = None) -> DataFrame:
    """(a, b): pairs of different names, not empty, of which one begins the other: only names and their beginnings meet."""
    x, y = a.select(F.col(a_col).alias("name")).filter("name <> ''"), b.select(F.col(b_col).alias("name")).filter("name <> ''")
    sides = x.withColumn("a", F.lit(True)).unionByName(y.withColumn("b", F.lit(True)), allowMissingColumns=True)
    known = checkpointed(sides.groupBy("name").agg(F.max("a").alias("a"), F.max("b").alias("b")))
    pairs = beginnings(known, "name", rows).join(known.select("name", F.col("a").alias("_a"), F.col("b").alias("_b")), "name")
    pairs = pairs.join(known.select(F.col("name").alias("beginning"), F.col("a").alias("_c"), F.col("b").alias("_d")), "beginning")
    long_a = pairs.filter("_a and _d").select(F.col("name").alias("a"), F.col("beginning").alias("b"))
    long_b = pairs.filter("_b and _c and name <> beginning").select(F.col("beginning").alias("a"), F.col("name").alias("b"))
    return long_a.union(long_b)


def patched(df: DataFrame, key: str, ids: list, column: str, value: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key).isin(*ids), F.lit(value)).otherwise(F.col(column)))


def role(group: Column, language: Column) -> Column:
    """What a row is for: training, control, or the external set of its language."""
    return F.when((group == "control") & (language == "en"), "control").when((group == "pwa") & (language == "en"), "train").when(group == "pwa", F.concat(F.lit("external_"), language))


def good_votes(up: Column, down: Column) -> Column:
    return (up >= 1) & (down <= up)


def in_duration_band(df: DataFrame, seconds: str, low: float = 2.0, high: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(rows within the band, (n_kept, n_skipped))."""
    inside = F.col(seconds).between(low, high)
    return df.filter(inside), df.agg(F.count_if(inside).alias("n_kept"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_skipped"))


def corpus_totals(clips: DataFrame, group: str, seconds: str) -> DataFrame:
    """Samples, hours and mean seconds by group, and of all (null)."""
    return clips.rollup(group).agg(F.count("*").alias("n"), (F.sum(seconds) / 3600).alias("hours"), F.avg(seconds).alias("mean_sec"))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def synonyms(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns by any of their names, whatever the case: the first present value; null where no name is there."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for name, others in wanted.items():
        found = [F.col(have[o.lower()]) for o in others if o.lower() in have]
        cols.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*cols)
