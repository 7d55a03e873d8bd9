"""N-gram models as count tables, and probabilities and cross-entropies of sequences by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.stats import sequence_stats
from parlance.operators.ranks import exact_medians
from parlance.shared import checkpointed

START, END = "<s>", "</s>"
FLOOR, BACKOFF = 1e-10, 0.4
#: So many scored n-grams, of some 200 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 200_000
#: Blocks of a speaker's features: (method, order) by the prefix of their columns.
BLOCKS = {
    "poslm_kn_bigram": ("kneser-ney", 2),
    "poslm_kn_trigram": ("kneser-ney", 3),
    "poslm_bo_bigram": ("backoff", 2),
    "poslm_bo_trigram": ("backoff", 3),
}


def ngrams(sequences: DataFrame, key: list[str], tags: str, n: int) -> DataFrame:
    """(key..., pos, context, tag): every n-gram of the padded sequences; ``context`` is an array of n - 1 tags."""
    padded = F.concat(F.array_repeat(F.lit(START), n - 1), F.col(tags), F.array(F.lit(END)))
    rows = sequences.filter(F.col(tags).isNotNull()).select(*key, padded.alias("_p"))
    rows = rows.select(*key, "_p", F.explode(F.sequence(F.lit(0), F.size("_p") - n)).alias("pos"))
    return rows.select(*key, "pos", F.slice("_p", F.col("pos") + 1, n - 1).alias("context"), F.get("_p", F.col("pos") + n - 1).alias("tag"))


@dataclass
class CountModel:
    """Counts for each order up to ``n``: (context, tag, c), and by context (context, total, types)."""

    n: int
    counts: dict[int, DataFrame]
    totals: dict[int, DataFrame]
    vocabulary: int
    tags: dict[int, DataFrame]


def train(sequences: DataFrame, tags: str, n: int = 3) -> CountModel:
    """Count tables of ``sequences``. The vocabulary is the tags seen, start and end."""
    return _model(ngrams(sequences, [], tags, n).groupBy("context", "tag").agg(F.count("*").alias("c")), n)


def train_within(sequences: DataFrame, tags: str, training: Column, n: int = 3) -> tuple[CountModel, DataFrame]:
    """train() on the rows where ``training`` holds, and the different n-grams (context, tag) of all rows, from one pass over them."""
    grams = ngrams(sequences.withColumn("_training", training), ["_training"], tags, n)
    grams = checkpointed(grams.groupBy("context", "tag").agg(F.count_if("_training").alias("c")))
    return _model(grams.filter("c > 0"), n), grams.select("context", "tag")


def _model(grams: DataFrame, n: int) -> CountModel:
    """From counted n-grams (context, tag, c): those of lower orders end them, so their counts are sums."""
    counts, totals, by_tag = {}, {}, {}
    orders = F.explode(F.sequence(F.lit(1), F.lit(n)))
    grams = grams.select(orders.alias("k"), "context", "tag", "c").select("k", F.slice("context", n - F.col("k") + 1, F.col("k") - 1).alias("context"), "tag", "c")
    every = checkpointed(grams.groupBy("k", "context", "tag").agg(F.sum("c").alias("c")))
    for k in range(1, n + 1):
        counts[k] = every.filter(F.col("k") == k).drop("k")
        totals[k] = counts[k].groupBy("context").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        by_tag[k] = counts[k].groupBy("tag").agg(F.sum("c").alias("tag_c"))
    seen = counts[1].filter(F.col("tag") != END).count()
    return CountModel(n, counts, totals, seen + 2, by_tag)


def probabilities(grams: DataFrame, model: CountModel, n: int, method: str = "backoff", alpha: float = 1.0, discount: float = 0.75, true_continuation: bool = False) -> DataFrame:
    """``grams`` (with context, tag of order ``n``) with ``prob``.

    The first order whose context was seen decides, scaled by 0.4 for each order left out; nothing seen: one over the
    vocabulary. ``backoff``: (c + alpha) / (total + alpha V). ``kneser-ney``: max(c - d, 0) / total + d types / total *
    p(tag), p by the tag's count, or by its distinct contexts with ``true_continuation``. Never under 1e-10, at any order.
    """
    rows = grams
    found: list[Column] = []
    for k in range(n, 0, -1):
        suffix = F.slice("context", n - k + 1, k - 1) if k > 1 else F.array().cast("array<string>")
        rows = rows.withColumn(f"_x{k}", suffix)
        total = model.totals[k].select(F.col("context").alias(f"_x{k}"), F.col("total").alias(f"_t{k}"), F.col("types").alias(f"_y{k}"))
        count = model.counts[k].select(F.col("context").alias(f"_x{k}"), "tag", F.col("c").alias(f"_n{k}"))
        rows = rows.join(total, f"_x{k}", "left").join(count, [f"_x{k}", "tag"], "left")
        c, t = F.coalesce(F.col(f"_n{k}"), F.lit(0)).cast("double"), F.col(f"_t{k}").cast("double")
        if method == "backoff":
            p = (c + alpha) / (t + alpha * model.vocabulary)
        else:
            if true_continuation:
                share = model.counts[k].groupBy("tag").agg(F.count("*").alias("tag_c"))
            else:
                share = model.tags[k]
            whole = share.agg(F.sum("tag_c").alias(f"_w{k}"))
            rows = rows.join(share.select("tag", F.col("tag_c").alias(f"_s{k}")), "tag", "left").crossJoin(F.broadcast(whole))
            p = F.greatest(c - discount, F.lit(0.0)) / t + discount * F.col(f"_y{k}") / t * (F.coalesce(F.col(f"_s{k}"), F.lit(0)) / F.col(f"_w{k}"))
        found.append(F.when(t.isNotNull(), F.greatest(p, F.lit(FLOOR))))
    prob: Column = F.coalesce(found[-1], F.lit(1.0 / model.vocabulary))
    for p in found[-2::-1]:
        prob = F.coalesce(p, F.greatest(F.lit(BACKOFF) * prob, F.lit(FLOOR)))
    return rows.withColumn("prob", prob).select(*grams.columns, "prob")


def cross_entropy(sequences: DataFrame, key: list[str], tags: str, model: CountModel, n: int, method: str = "backoff", seen: DataFrame | None = None, **options) -> DataFrame:
    """(key..., n_tags, ce, ppl): mean of -log2 p over a sequence's n-grams; null for sequences shorter than ``n``.

    Each different n-gram is scored once; the table of these is stored, and broadcast up to BROADCAST_GRAMS rows.
    ``seen``: the different n-grams of ``sequences``, if train_within() has found them; else a pass finds them.
    """
    sized = sequences.select(*key, F.size(tags).alias("n_tags"), tags)
    grams = ngrams(sized.filter(F.col("n_tags") >= n), key, tags, n)
    seen = grams.select("context", "tag").distinct() if seen is None else seen
    known = checkpointed(probabilities(seen, model, n, method, **options))
    known = F.broadcast(known) if known.count() <= BROADCAST_GRAMS else known
    ce = grams.join(known, ["context", "tag"]).groupBy(*key).agg(F.avg(-F.log2("prob")).alias("ce"))
    return sized.select(*key, "n_tags").join(ce, key, "left").withColumn("ppl", F.pow(F.lit(2.0), F.col("ce")))


def speaker_features(scored: DataFrame, speaker: str, prefix: str) -> DataFrame:
    """The 13 statistics of cross-entropy, and the mean and median perplexity, of each speaker's sequences."""
    return scored.groupBy(speaker).agg(*sequence_stats(F.col("ce"), f"{prefix}_ce_"), F.avg("ppl").alias(f"{prefix}_ppl_mean"), F.percentile("ppl", F.lit(0.5)).alias(f"{prefix}_ppl_median"))


def block_features(sequences: DataFrame, speaker: str, key: list[str], tags: str, model: CountModel, blocks: dict[str, tuple[str, int]] = BLOCKS, seen: DataFrame | None = None) -> DataFrame:
    """speaker_features() of every block; ``key`` names a sequence and has the speaker in it.

    A sequence has as many n-grams of each order, and those of lower orders end those of the highest. So one pass gives
    the different n-grams of the highest order (``seen``, if train_within() has found them), each of which gets its
    probabilities in all blocks, and another pass and one join the cross-entropies of all blocks. Sequences of one key
    share their mean; of a null in it there is none.
    """
    n = max(order for _, order in blocks.values())
    padded = F.concat(F.array_repeat(F.lit(START), n - 1), F.col(tags), F.array(F.lit(END)))
    rows = sequences.select(*key, F.size(tags).alias("n_tags"), padded.alias("_p"))
    rows = rows.select(*key, "n_tags", F.posexplode_outer(F.transform(F.sequence(F.lit(1), F.size("_p") - (n - 1)), lambda i: F.slice("_p", i, n))).alias("_pos", "_g"))
    known = rows.select("_g").filter("_g is not null").distinct() if seen is None else seen.select(F.concat("context", F.array("tag")).alias("_g"))
    known = known.select("_g", *[F.slice("_g", n - k + 1, k - 1).alias(f"_x{k}") for k in range(1, n + 1)], F.get("_g", F.lit(n - 1)).alias("tag"))
    known = checkpointed(known)
    for prefix, (method, k) in blocks.items():
        scored = probabilities(known.select(F.col(f"_x{k}").alias("context"), "tag").distinct(), model, k, method)
        known = known.join(scored.select(F.col("context").alias(f"_x{k}"), "tag", (-F.log2("prob")).alias(f"_bits_{prefix}")), [f"_x{k}", "tag"])
    known = checkpointed(known.select("_g", *[f"_bits_{prefix}" for prefix in blocks]))
    known = F.broadcast(known) if known.count() <= BROADCAST_GRAMS else known
    first, named = F.coalesce("_pos", F.lit(0)) == 0, F.lit(True)
    for c in key:
        named = named & F.col(c).isNotNull()
    figures, columns = [F.count_if(first).alias("_times")], []
    for prefix, (_, k) in blocks.items():
        figures += [F.avg(F.when(F.col("n_tags") >= k, F.col(f"_bits_{prefix}"))).alias(f"_mean_{prefix}"), F.count_if(first & (F.col("n_tags") >= k)).alias(f"_times_{prefix}")]
        ppl = F.col(f"{prefix}_ppl")
        columns += [*sequence_stats(F.col(f"{prefix}_ce"), f"{prefix}_ce_"), F.avg(ppl).alias(f"{prefix}_ppl_mean"), F.percentile(ppl, F.lit(0.5)).alias(f"{prefix}_ppl_median")]
    means = rows.join(known, "_g", "left").groupBy(*key).agg(*figures)
    each = means.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    each = each.select(speaker, *[F.when(named & (F.col("_i") <= F.col(f"_times_{prefix}")), F.col(f"_mean_{prefix}")).alias(f"{prefix}_ce") for prefix in blocks])
    return each.withColumns({f"{prefix}_ppl": F.pow(F.lit(2.0), F.col(f"{prefix}_ce")) for prefix in blocks}).groupBy(speaker).agg(*columns)


def fill_with_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of ``columns`` by the exact median of each."""
    found = exact_medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(found[c]).cast("double")) for c in columns})
