"""Tags in context: a hidden Markov model from count tables, and the most probable tags of a sequence."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.language_model import END, START, train
from parlance.shared import checkpointed

#: So many words, of a dozen scores each, are broadcast; more are joined by a shuffle.
BROADCAST_WORDS = 100_000


@dataclass
class Tagger:
    """``first``, ``steps`` and ``last`` are log probabilities of a tag at the start, after another (row), and before the end.

    ``emissions``: (word, scores), the log probability of the word for each of ``tags``; ``unknown``: of words that
    training has not.
    """

    tags: list[str]
    first: list[float]
    steps: list[list[float]]
    last: list[float]
    emissions: DataFrame
    unknown: list[float]


def train_tagger(sequences: DataFrame, words: str, tags: str, weight: float = 0.1) -> Tagger:
    """A tagger of sequences with arrays of words and their tags; those with a null are left out, and words are taken as they are.

    A step from tag to tag counts once more than it is there. A word counts ``weight`` times more with each tag, and an
    unknown one as often as words that are there once in all have the tag. Tables of tags come to the driver, words do not.
    """
    rows = checkpointed(sequences.select(words, tags).dropna().filter((F.size(words) == F.size(tags)) & (F.size(tags) > 0)))
    counts = rows.select(F.explode(F.arrays_zip(F.col(words).alias("word"), F.col(tags).alias("tag"))).alias("x")).select("x.*").groupBy("word", "tag").agg(F.count("*").alias("c"))
    counts = checkpointed(counts)
    by_tag = {r["tag"]: r["n"] for r in counts.groupBy("tag").agg(F.sum("c").alias("n")).collect()}
    names, n_words = sorted(by_tag), counts.select("word").distinct().count()
    steps = {(r["context"][0], r["tag"]): r["c"] for r in train(rows, tags, 2).counts[2].collect()}
    total = {s: sum(c for (a, _), c in steps.items() if a == s) for s in (START, *names)}
    step = lambda s, t: math.log((steps.get((s, t), 0) + 1) / (total[s] + len(names) + 1))
    by_word = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("tag", "c"))).alias("_c"), F.sum("c").alias("_all"))
    once = {r["tag"]: r["h"] for r in by_word.filter("_all = 1").select(F.explode("_c").alias("tag", "c")).groupBy("tag").agg(F.count("*").alias("h")).collect()}
    whole = {t: by_tag[t] + weight * (n_words + 1) for t in names}
    scores = F.array(*[F.log((F.coalesce(F.try_element_at("_c", F.lit(t)), F.lit(0)) + F.lit(weight)) / F.lit(whole[t])) for t in names]).cast("array<double>")
    emissions = checkpointed(by_word.select("word", scores.alias("scores")))
    return Tagger(names, [step(START, t) for t in names], [[step(s, t) for t in names] for s in names], [step(t, END) for t in names], emissions, [math.log((once.get(t, 0) + weight) / whole[t]) for t in names])


def _constant(values, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def best_path(scores: Column, model: Tagger) -> Column:
    """The most probable tags of an array of the words' scores: one pass keeps the best way to each tag, one goes back. Of equal ways the tag that sorts first."""
    n = len(model.tags)
    steps, ids = _constant(model.steps, "array<array<double>>"), F.sequence(F.lit(0), F.lit(n - 1))
    best_of = lambda value: F.array_max(F.transform(ids, lambda s: F.struct(value(s).alias("v"), (-s).alias("s"))))

    def step(state: Column, word: Column) -> Column:
        ways = F.transform(ids, lambda t: best_of(lambda s: state["v"][s] + steps[s][t]))
        return F.struct(F.zip_with(ways, word, lambda w, e: w["v"] + e).alias("v"), F.array_append(state["back"], F.transform(ways, lambda w: -w["s"])).alias("back"))

    start = F.struct(F.zip_with(_constant(model.first, "array<double>"), scores[0], lambda a, e: a + e).alias("v"), F.array().cast("array<array<int>>").alias("back"))
    last = _constant(model.last, "array<double>")

    def back(state: Column) -> Column:
        end = F.array(-best_of(lambda s: state["v"][s] + last[s])["s"])
        return F.reverse(F.aggregate(F.reverse(state["back"]), end, lambda path, way: F.array_append(path, way[F.element_at(path, -1)])))

    path = F.aggregate(F.slice(scores, F.lit(2), F.size(scores)), start, step, back)
    names = F.array(*map(F.lit, model.tags))
    return F.when(F.size(scores) > 0, F.transform(path, lambda t: names[t])).otherwise(F.array().cast("array<string>"))


def viterbi(sequences: DataFrame, key: list[str], words: str, model: Tagger) -> DataFrame:
    """(key..., tags): the most probable tags of each sequence's words together. Null or no words: no tags; a null word is an unknown one.

    ``key`` names a sequence. Words meet their scores by a join, and a sequence's scores come together by its key.
    """
    small = model.emissions
    small = F.broadcast(small) if small.count() <= BROADCAST_WORDS else small
    if not model.tags:
        return sequences.select(*key, F.transform(F.coalesce(words, F.array()), lambda w: F.lit(None).cast("string")).alias("tags"))
    each = sequences.select(*key, F.posexplode_outer(words).alias("_pos", "word")).join(small, "word", "left")
    score = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("scores", _constant(model.unknown, "array<double>")).alias("scores")))
    rows = each.groupBy(*key).agg(F.array_sort(F.collect_list(score)).alias("_s"))
    return rows.select(*key, best_path(F.col("_s")["scores"], model).alias("tags"))
