"""Feature selection: mutual information, forward search, elimination, importances, fixed sets."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import prep
from parlance.operators.ranks import exact_quantiles
from parlance.shared import checkpointed

#: The plain set, of rates, means and shares without the other statistics.
SIMPLE = (
    "den_words_per_min", "den_phones_per_min", "den_W", "den_OCW",
    "den_words_utt_mean", "den_phones_utt_mean",
    "den_nouns", "den_verbs", "den_nouns_per_verb", "den_noun_ratio",
    "den_light_verbs", "den_determiners", "den_demonstratives",
    "den_prepositions", "den_adjectives", "den_adverbs",
    "den_pronoun_ratio", "den_function_words",
    "dys_fillers_per_min", "dys_fillers_per_word", "dys_fillers_per_phone",
    "dys_pauses_per_min", "dys_long_pauses_per_min", "dys_short_pauses_per_min",
    "dys_pauses_per_word", "dys_long_pauses_per_word", "dys_short_pauses_per_word",
    "dys_pause_sec_mean",
    "lex_ttr",
)


def simple_set(columns: list[str], methods: tuple[str, ...] = ()) -> list[str]:
    """SIMPLE and the mean cross-entropies of the named language-model ``methods`` (kn, bo), as far as they are there."""
    wanted = [*SIMPLE, *(f"poslm_{m}_{n}_ce_mean" for m in methods for n in ("bigram", "trigram"))]
    return [c for c in wanted if c in columns]


def full_set(columns: list[str]) -> list[str]:
    return list(columns)


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mi) in nats from counts of quantile bins: an estimate from a joint table, not by neighbours.

    Edges are exact quantiles of all rows; the counts are one aggregation over the unpivoted rows, combined before the
    shuffle; rows with a null in a pair are left out of it.
    """
    edges = exact_quantiles(df, [*columns, target], [i / bins for i in range(1, bins)])
    bin_of = lambda c: sum(((F.col(c) > F.lit(e)).cast("int") for e in sorted({e for e in edges[c] if e is not None})), F.lit(0))
    base = df.filter(F.col(target).isNotNull()).select(bin_of(target).alias("by"), *[F.when(F.col(c).isNotNull(), bin_of(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    long = base.select("by", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("bx")) for i, c in enumerate(columns)])).alias("x")).select("by", "x.*").filter("bx is not null")
    joint = long.groupBy("feature", "bx", "by").agg(F.count("*").alias("n"))
    sums = lambda *keys: joint.groupBy("feature", *keys).agg(F.sum("n").alias("_".join(("s", *keys))))
    rows = joint.join(sums("bx"), ["feature", "bx"]).join(sums("by"), ["feature", "by"]).join(sums(), "feature")
    n, s = F.col("n").cast("double"), F.col("s")
    return rows.groupBy("feature").agg(F.sum(n / s * F.log(n * s / (F.col("s_bx") * F.col("s_by")))).alias("mi"))


def gram_matrices(df: DataFrame, columns: list[str], target: str, fold: str) -> dict[int, np.ndarray]:
    """Sums of products of (1, columns, target) by fold: all that a linear fit of any subset needs, from one pass.

    Rows with a null in a column or the target are left out. A fold's matrix is (columns + 2) squared, whatever the number of rows.
    """
    names = ["_one", *columns, target]
    rows = df.select(fold, F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in (*columns, target)]).dropna(subset=[*columns, target])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = {}
    for row in rows.groupBy(fold).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{n}") for n, (i, j) in enumerate(pairs)]).collect():
        g = np.zeros((len(names), len(names)))
        for n, (i, j) in enumerate(pairs):
            g[i, j] = g[j, i] = row[f"g{n}"]
        found[row[fold]] = g
    return found


def prefiltered(df: DataFrame, columns: list[str], target: str, most_null: float = 0.3, least_variance: float = 0.01, k: int = 80) -> list[str]:
    """The columns, in their order, with a lesser share of nulls and a greater variance; the ``k`` of the greatest F where more are left."""
    left = prep.variance_filter(prep.null_filter(prep.column_report(df, columns, target), most_null), least_variance)
    names = [r["feature"] for r in left.select("feature").collect()]
    if len(names) > k:
        names = [r["feature"] for r in prep.top_by_f(left, k).select("feature").collect()]
    return [c for c in columns if c in names]


def _fold_weights(grams: dict[int, np.ndarray], at: list[int]) -> dict[int, list[float]]:
    """Weights of a linear fit for each fold, from the rows outside of it."""
    whole, last = sum(grams.values()), len(next(iter(grams.values()))) - 1
    return {f: np.linalg.lstsq((whole - g)[np.ix_(at, at)], (whole - g)[at, last], rcond=None)[0].tolist() for f, g in grams.items() if f is not None}


def _absolute_error(names: list[str], target: str, fold: str, weights: dict[int, list[float]]) -> Column:
    """Mean absolute error of the rows that have a fold, each by its fold's weights."""
    fit = lambda w: sum((F.col(c) * x for c, x in zip(names, w[1:], strict=True)), F.lit(w[0]))
    return F.avg(F.coalesce(*[F.when(F.col(fold) == f, F.abs(F.col(target) - fit(w))) for f, w in weights.items()]))


def forward_selection(df: DataFrame, columns: list[str], target: str, fold: str = "fold", most: int = 20) -> list[tuple[str, float]]:
    """(feature, cross-validated mean absolute error with it) in the order chosen, up to the number of features with the least error.

    Nulls are filled by medians; a column without values is never chosen, and rows without a target do not count. Rows
    whose fold is null train every fit and score none. Candidates are linear fits from the folds' Gram matrices; a round
    scores all of them in one pass over the stored columns. No rows: nothing is chosen.
    """
    middles = {c: m for c, m in prep.medians(df, columns).items() if m is not None}
    columns = [c for c in columns if c in middles]
    rows = prep.imputed(df, middles).select(fold, *columns, F.col(target).cast("double").alias(target)).filter(F.col(target).isNotNull())
    rows = checkpointed(rows)
    grams = gram_matrices(rows, columns, target, fold)
    chosen: list[int] = []
    out: list[tuple[str, float]] = []
    while len(chosen) < min(most, len(columns)) and any(f is not None for f in grams):
        tried = [i for i in range(len(columns)) if i not in chosen]
        sets = [[*chosen, i] for i in tried]
        errors = rows.agg(*[_absolute_error([columns[j] for j in x], target, fold, _fold_weights(grams, [0, *[j + 1 for j in x]])).alias(f"e{x[-1]}") for x in sets]).first()
        error, i = min(zip(errors, tried, strict=True))
        chosen.append(i)
        out.append((columns[i], error))
    return out[: min(range(len(out)), key=lambda n: out[n][1]) + 1] if out else out


def _assembled(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df).select("features", F.col(target).cast("double").alias("label"))


def swept(g: np.ndarray, at: int, out: bool = False) -> np.ndarray:
    """Products of columns with the fit of column ``at`` swept in, or ``out`` again: a column that is in has its weight for each other one."""
    pivot, sign = g[at, at], -1.0 if out else 1.0
    new = g - np.outer(g[:, at], g[at]) / pivot
    new[at], new[:, at] = sign * g[at] / pivot, sign * g[:, at] / pivot
    new[at, at] = -1.0 / pivot
    return new


def recursive_elimination(df: DataFrame, columns: list[str], target: str, keep: int = 40, step: int = 5) -> list[tuple[str, int]]:
    """(feature, rank): 1 for those that stay; those of the least standardised weight in a linear fit go ``step`` at a time.

    One pass makes the products of all columns; in their correlations the fit of all is swept in, and what goes is swept out,
    so no round reads the rows. A column without variance, or that the ones before it make up, goes in the first round.
    Rows with a null in a column or the target are left out; without rows all columns go in their order.
    """
    grams = gram_matrices(df.withColumn("_whole", F.lit(0)), columns, target, "_whole")
    g = sum(grams.values()) if grams else np.zeros((len(columns) + 2,) * 2)
    n = max(1.0, g[0, 0])
    centred = (g - np.outer(g[0], g[0]) / n)[1:, 1:]
    size = np.sqrt(np.maximum(np.diag(centred), 0))
    fit = centred / np.outer(np.where(size > 0, size, 1), np.where(size > 0, size, 1))
    at = {c: i for i, c in enumerate(columns)}
    held = set()
    for c, i in at.items():
        if fit[i, i] > 1e-9 and size[i] ** 2 > 1e-12 * max(1.0, g[i + 1, i + 1]):
            fit = swept(fit, i)
            held.add(c)
    left, ranks, round_ = list(columns), {}, 0
    while len(left) > keep:
        weight = [abs(float(fit[at[c], -1])) if c in held else -1.0 for c in left]
        out = [left[i] for i in np.argsort(weight, kind="stable")[: min(step, len(left) - keep)]]
        for c in out:
            if c in held:
                fit = swept(fit, at[c], out=True)
        round_ += 1
        ranks |= dict.fromkeys(out, round_)
        left = [c for c in left if c not in out]
    return [(c, 1 if c in left else round_ - ranks[c] + 2) for c in columns]


def by_importance(df: DataFrame, columns: list[str], target: str, k: int = 40, seed: int = 42) -> list[tuple[str, float]]:
    """The ``k`` features of the greatest importance in a random forest; of the greatest mutual information where it splits by none."""
    model = RandomForestRegressor(numTrees=50, maxDepth=6, seed=seed).fit(_assembled(df, columns, target))
    found = model.featureImportances.toArray()
    if not found.any():
        rows = mutual_information(df, columns, target).orderBy(F.desc("mi"), "feature").limit(k).collect()
        return [(r["feature"], float(r["mi"])) for r in rows]
    ranked = sorted(zip(columns, found, strict=True), key=lambda x: (-x[1], x[0]))
    return [(c, float(v)) for c, v in ranked[:k]]
