"""Additive models of step functions of one feature or two, boosted round by round over binned rows.

Rows become bin numbers once, and rows of the same bins one row with their number and the sum of their targets. A round
fits a step function of few leaves to each feature's histogram of the residuals. All are added at once, shortened where
together they overshoot. The next histograms follow from one aggregate of what the round adds, so a round is one pass over
the binned rows; nothing is kept by row. What comes to the driver is one sum for each bin of each term.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.shared import checkpointed


@dataclass
class Additive:
    """``tables[t]`` has the value of each bin of term ``t``, which is one of ``columns`` or a pair; bin 0 is that of nulls.

    ``edges`` of a column are the last values of its bins from 1 on, but for the last bin, which is open. ``parts`` of a
    column is how many coarser bins it has in pairs.
    """

    columns: list[str]
    edges: list[list[float]]
    terms: list[tuple[int, ...]]
    parts: list[int]
    intercept: float
    tables: list[np.ndarray]

    def predicted(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with ``out``: the intercept and the values of its bins."""
        bins = [binned(F.col(c), e) for c, e in zip(self.columns, self.edges, strict=True)]
        places = [_place(bins, t, self.edges, self.parts) for t in self.terms]
        return df.withColumn(out, _sum_of(self.tables, places) + F.lit(self.intercept))

    def shapes(self, spark: SparkSession) -> DataFrame:
        """(feature, bin, low, high, value) of the terms of one feature: ``low`` < x <= ``high``, null where open and in bin 0."""
        rows = []
        for term, table in zip(self.terms, self.tables, strict=True):
            if len(term) == 1:
                ends = [None, *self.edges[term[0]], None]
                rows += [(self.columns[term[0]], b, None if b == 0 else ends[b - 1], None if b == 0 else ends[b], float(v)) for b, v in enumerate(table)]
        return spark.createDataFrame(rows, "feature string, bin int, low double, high double, value double")

    def text(self) -> str:
        return json.dumps([self.columns, self.edges, self.terms, self.parts, self.intercept, [t.tolist() for t in self.tables]])

    @staticmethod
    def of_text(text: str) -> Additive:
        columns, edges, terms, parts, intercept, tables = json.loads(text)
        return Additive(columns, edges, [tuple(t) for t in terms], parts, intercept, [np.array(t) for t in tables])


def quantile_edges(df: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Different approximate quantiles of each column that part it into ``bins`` or fewer, from one aggregate."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000) for c in columns]).first()
    return [sorted({float(x) for x in found or []}) for found in row]


def binned(x: Column, edges: list[float]) -> Column:
    """0 for null, else 1 and how many edges lie below; a NaN is above all."""
    return F.when(x.isNull() | x.cast("double").isNull(), 0).otherwise(_edges_below(x.cast("double"), edges) + 1).cast("int")


def _edges_below(x: Column, edges: list[float]) -> Column:
    """By halving, so that a value is compared about log2 times."""
    if not edges:
        return F.lit(0)
    at = len(edges) // 2
    return F.when(x > F.lit(edges[at]), _edges_below(x, edges[at + 1 :]) + (at + 1)).otherwise(_edges_below(x, edges[:at]))


def _place(bins: list[Column], term: tuple[int, ...], edges: list[list[float]], parts: list[int]) -> Column:
    """The entry of a term's table that a row has."""
    if len(term) == 1:
        return bins[term[0]]
    i, j = term
    coarse = lambda k: F.floor(bins[k] * parts[k] / F.lit(len(edges[k]) + 2)).cast("int")
    return coarse(i) * parts[j] + coarse(j)


def _sum_of(tables: list[np.ndarray], places: list[Column]) -> Column:
    """The sum of the entries at ``places``; the tables are one constant of the plan, of all bins of all terms."""
    constant = F.from_json(F.lit(json.dumps([t.tolist() for t in tables])), "array<array<double>>")
    return sum((constant[t][p] for t, p in enumerate(places)), F.lit(0.0))


def _histograms(cells: DataFrame, value: Column, places: list[Column], sizes: list[int], rows: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums of ``value`` by entry of each term, and with ``rows`` the numbers of rows."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), p.alias("at")) for t, p in enumerate(places)]))
    long = cells.select(each.alias("x"), value.alias("v"), "n").select("x.*", "v", "n")
    sums, counts = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    for r in long.groupBy("t", "at").agg(F.sum("v").alias("v"), *([F.sum("n").alias("n")] if rows else [])).collect():
        sums[r["t"]][r["at"]] = r["v"]
        if rows:
            counts[r["t"]][r["at"]] = r["n"]
    return sums, counts


def step_function(s: np.ndarray, n: np.ndarray, leaves: int, least: int) -> np.ndarray:
    """Means of at most ``leaves`` intervals of bins, cut one by one where the squared error falls most; the first of equal cuts.

    Each interval has ``least`` rows or more, if all bins together have.
    """
    cuts, ends = [0, len(s)], np.concatenate([[0.0], np.cumsum(s)])
    rows = np.concatenate([[0.0], np.cumsum(n)])
    while len(cuts) <= leaves:
        best, where = 1e-12, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            left, right = rows[a + 1 : b] - rows[a], rows[b] - rows[a + 1 : b]
            fits = (left >= max(1, least)) & (right >= max(1, least))
            if not fits.any():
                continue
            sl, sr = ends[a + 1 : b] - ends[a], ends[b] - ends[a + 1 : b]
            gain = np.where(fits, sl**2 / np.maximum(left, 1) + sr**2 / np.maximum(right, 1) - (ends[b] - ends[a]) ** 2 / max(1.0, rows[b] - rows[a]), -1)
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, where = gain[at], a + 1 + at
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(s))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if rows[b] > rows[a]:
            out[a:b] = (ends[b] - ends[a]) / (rows[b] - rows[a])
    return out


def _boost(cells: DataFrame, places: list[Column], sizes: list[int], residual: list[np.ndarray], counts: list[np.ndarray], fit, rounds: int, rate: float, tolerance: float) -> list[np.ndarray]:
    """Tables of the terms after ``rounds``, or when a round lowers the squared error by less than ``tolerance`` of what the first did."""
    tables, first = [np.zeros(s) for s in sizes], None
    for _ in range(rounds):
        steps = [rate * fit(s, n) for s, n in zip(residual, counts, strict=True)]
        rg = sum(float(g @ s) for g, s in zip(steps, residual, strict=True))
        if rg <= 0:
            break
        added, _ = _histograms(cells, _sum_of(steps, places) * F.col("n"), places, sizes)
        gg = sum(float(g @ h) for g, h in zip(steps, added, strict=True))
        length = min(1.0, rg / gg) if gg > 0 else 0.0
        tables = [t + length * g for t, g in zip(tables, steps, strict=True)]
        residual[:] = [s - length * h for s, h in zip(residual, added, strict=True)]
        gained = 2 * length * rg - length * length * gg
        first = first or gained
        if gained < tolerance * first:
            break
    return tables


def fit_additive(df: DataFrame, columns: list[str], target: str, bins: int = 128, rounds: int = 50, rate: float = 0.1, leaves: int = 3, least: int = 2, interactions: int = 0, pair_bins: int = 16, edges: list[list[float]] | None = None, tolerance: float = 1e-4) -> Additive:
    """An additive model of ``target``: ``rounds`` rounds at learning rate ``rate``, then as many over ``interactions`` pairs.

    A feature's step functions have ``leaves`` intervals of ``least`` rows at least. Pairs are those whose cell means
    lower the squared error of the residuals most, in a table of ``pair_bins`` by ``pair_bins``; the table of single
    features is then kept. Rows without a target do not count; a null feature has a bin of its own. A column without
    values or with one value has no shape. No rows: an intercept of 0 and empty shapes.
    """
    edges = quantile_edges(df, columns, bins) if edges is None else edges
    y = F.col(target).cast("double")
    names = [f"b{i}" for i in range(len(columns))]
    rows = df.filter(y.isNotNull()).select(*[binned(F.col(c), e).alias(b) for c, e, b in zip(columns, edges, names, strict=True)], y.alias("y"))
    cells = checkpointed(rows.groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("y")))
    total, n = cells.agg(F.sum("y"), F.sum("n")).first()
    intercept = total / n if n else 0.0
    sizes = [len(e) + 2 for e in edges]
    parts = [min(pair_bins, s) for s in sizes]
    own = [F.col(b) for b in names]
    terms: list[tuple[int, ...]] = [(i,) for i in range(len(columns))]
    residual, counts = _histograms(cells, F.col("y") - F.col("n") * intercept, own, sizes, rows=True)
    tables = _boost(cells, own, sizes, residual, counts, lambda s, m: step_function(s, m, leaves, least), rounds, rate, tolerance)
    if interactions and len(columns) > 1:
        pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
        left = F.col("y") - F.col("n") * (_sum_of(tables, own) + intercept)
        rest = checkpointed(cells.select(*names, "n", left.alias("y")))
        mean = lambda s, m: np.where(m >= max(1, least), s / np.maximum(m, 1), 0.0)
        places = [_place(own, p, edges, parts) for p in pairs]
        found = _histograms(rest, F.col("y"), places, [parts[i] * parts[j] for i, j in pairs], rows=True)
        gain = [float(mean(s, m) @ s) for s, m in zip(*found, strict=True)]
        best = sorted(sorted(range(len(pairs)), key=lambda k: (-gain[k], k))[:interactions])
        pick = lambda xs: [xs[k] for k in best]
        terms += pick(pairs)
        tables += _boost(rest, pick(places), [len(x) for x in pick(found[0])], pick(found[0]), pick(found[1]), mean, rounds, rate, tolerance)
    return Additive(list(columns), [list(map(float, e)) for e in edges], terms, parts, float(intercept), tables)
