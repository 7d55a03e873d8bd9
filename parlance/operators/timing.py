"""Gaps and pauses between timed words, and rates from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.stats import minutes, safe_div, summarise
from parlance.operators.merge import require_columns

PAUSE_MIN, PAUSE_LONG, PAUSE_END = 0.150, 0.400, 3.0


def tidy_words(words: DataFrame, least_score: float | None = None) -> DataFrame:
    """Timed words without null times; an end not after its start is put 10 ms later; words trimmed, in lower case.

    ``least_score`` drops lower scores; a null score stays.
    """
    out = words.filter("start_sec is not null and end_sec is not null and not isnan(start_sec) and not isnan(end_sec)")
    out = out.withColumn("end_sec", F.when(F.col("end_sec") <= F.col("start_sec"), F.col("start_sec") + 0.01).otherwise(F.col("end_sec")))
    if "word" in words.columns:
        out = out.withColumn("word", F.lower(F.trim("word"))).filter("word <> ''")
    if least_score is not None and "score" in words.columns:
        out = out.filter(F.col("score").isNull() | (F.col("score") >= least_score))
    return out


def gaps(words: DataFrame, key: str = "patient_id", tie: list[str] | None = None) -> DataFrame:
    """Each word with ``gap``, the time from its end to the next start; null for the last of a speaker."""
    order = Window.partitionBy(key).orderBy("start_sec", "end_sec", *(tie or []))
    return words.withColumn("gap_end", F.lead("start_sec").over(order)).withColumn("gap", F.col("gap_end") - F.col("end_sec"))


def pauses(with_gaps: DataFrame, low: float = PAUSE_MIN, long: float = PAUSE_LONG, end: float = PAUSE_END) -> DataFrame:
    """Rows whose gap is a pause, ``low`` <= gap < ``end``, with ``kind`` long (over ``long``) or short."""
    return with_gaps.filter((F.col("gap") >= low) & (F.col("gap") < end)).withColumn("kind", F.when(F.col("gap") > long, "long").otherwise("short"))


def speaking_time(words: DataFrame, text_words: DataFrame, key: str = "patient_id", least_coverage: float = 0.3, words_per_minute: float = 120.0) -> DataFrame:
    """(key, n_aligned, n_text_words, speech_sec) of each row of ``text_words`` (key, n_text_words).

    The sum of word lengths; the text's words at a normal pace where fewer than ``least_coverage`` of them are timed;
    60 s where none is.
    """
    timed = words.groupBy(key).agg(F.count("*").alias("n_aligned"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("sec"))
    n = F.col("n_text_words")
    seconds = F.when(F.col("n_aligned").isNull(), 60.0).when(F.col("n_aligned") / F.greatest(n, F.lit(1)) < least_coverage, n / words_per_minute * 60).otherwise(F.col("sec"))
    return text_words.join(timed, key, "left").select(key, F.coalesce("n_aligned", F.lit(0)).alias("n_aligned"), "n_text_words", seconds.alias("speech_sec"))


def quiet_gaps(gap_rows: DataFrame, frames: DataFrame, key: str = "patient_id", threshold: float = -35.0, share: float = 0.8, width: float = 1.0) -> DataFrame:
    """``gap_rows`` (gap_id, key, gap_start, gap_end, ...) with ``quiet_share`` and ``silent``; ``gap_id`` names a gap.

    Frames (key, t, rms_db) with gap_start <= t < gap_end are found through buckets of ``width`` seconds, an equality
    join with the exact bounds after it. No frames within a gap: silent; no frames of the speaker at all: not silent.
    """
    rows = require_columns(gap_rows, ["gap_id"]).withColumn("_id", F.col("gap_id"))
    spread = rows.select("_id", F.col(key).alias("_key"), "gap_start", "gap_end", F.explode(F.sequence(F.floor(F.col("gap_start") / width), F.floor(F.col("gap_end") / width))).alias("_bucket"))
    inside = spread.join(frames.select(F.col(key).alias("_key"), "t", "rms_db", F.floor(F.col("t") / width).alias("_bucket")), ["_key", "_bucket"]).filter("t >= gap_start and t < gap_end")
    quiet = inside.groupBy("_id").agg(F.avg((F.col("rms_db") < threshold).cast("double")).alias("quiet_share"))
    heard = frames.select(F.col(key)).distinct().withColumn("_heard", F.lit(True))
    out = rows.join(quiet, "_id", "left").join(heard, key, "left")
    silent = F.when(F.col("_heard").isNull(), False).otherwise(F.coalesce(F.col("quiet_share") >= share, F.lit(True)))
    return out.withColumn("silent", silent).drop("_id", "_heard")


def pause_rates(words: DataFrame, speech: DataFrame, filler_counts: DataFrame | None = None, key: str = "patient_id", tie: list[str] | None = None) -> DataFrame:
    """One row for each row of ``speech`` (key, speech_sec): fillers and pauses by minute, word and phone, and the
    13 statistics of pause lengths. Speakers without timed words have one word, as a floor, and no pauses."""
    timed = gaps(tidy_words(words), key, tie)
    found = pauses(timed)
    per = timed.groupBy(key).agg(F.count("*").alias("n_words"))
    counts = found.groupBy(key).agg(F.count("*").alias("n_pauses"), F.count_if(F.col("kind") == "long").alias("n_long"))
    base = speech.select(key, "speech_sec").join(per, key, "left").join(counts, key, "left")
    if filler_counts is not None:
        base = base.join(filler_counts.select(key, "n_fillers"), key, "left")
    else:
        base = base.withColumn("n_fillers", F.lit(0))
    base = base.fillna(0, ["n_pauses", "n_long", "n_fillers"]).fillna(1, ["n_words"])
    minute, w = minutes(F.col("speech_sec")), F.col("n_words").cast("double")
    phones = F.floor(w * 3.5)
    p, lo, f = F.col("n_pauses").cast("double"), F.col("n_long").cast("double"), F.col("n_fillers").cast("double")
    rates = base.select(
        key,
        (f / minute).alias("dys_fillers_per_min"), safe_div(f, w).alias("dys_fillers_per_word"), safe_div(f, phones).alias("dys_fillers_per_phone"),
        (p / minute).alias("dys_pauses_per_min"), (lo / minute).alias("dys_long_pauses_per_min"), ((p - lo) / minute).alias("dys_short_pauses_per_min"),
        safe_div(p, w).alias("dys_pauses_per_word"), safe_div(lo, w).alias("dys_long_pauses_per_word"), safe_div(p - lo, w).alias("dys_short_pauses_per_word"),
    )
    return rates.join(summarise(found, [key], "gap", "dys_pause_sec_"), key, "left")


def standardise(df: DataFrame, keys: list[str], value: str, out: str = "z") -> DataFrame:
    """``value`` less its mean over its population deviation in the group; a deviation of 0 counts as 1.

    Group figures are aggregated first and joined back, so a large group is not one task.
    """
    figures = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(figures, keys).withColumn(out, (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")
