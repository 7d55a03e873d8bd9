"""The driver's tables in the forms that the operators take, in Spark and in SQL with the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed words: start in ten-thousands of seconds, the value as length."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 1e4
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("patient_id"), "event_id", start.alias("start_sec"), (start + F.col("value") / 1e4).alias("end_sec"), "value")


INTERVALS = """
iv0 as (select user_id::varchar as patient_id, event_id, epoch_us(ts) / 1e6 / 1e4 as start_sec,
               epoch_us(ts) / 1e6 / 1e4 + value / 1e4 as end_raw, value from events),
iv as (select patient_id, event_id, start_sec, case when end_raw <= start_sec then start_sec + 0.01::double else end_raw end as end_sec, value
       from iv0 where start_sec is not null and end_raw is not null),
gp as (select *, lead(start_sec) over (partition by patient_id order by start_sec, end_sec, event_id) - end_sec as gap from iv),
ps as (select *, case when gap > 0.4::double then 'long' else 'short' end as kind from gp where gap >= 0.15::double and gap < 3.0::double)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions of scores between 2 and 100."""
    actual = F.col("l_quantity") * 2
    predicted = F.least(F.lit(100.0), F.greatest(F.lit(0.0), actual + (F.col("l_discount") - 0.05) * 200))
    return read(spark, sf_dir, "lineitem").select("*", actual.alias("actual"), predicted.alias("predicted"))


SCORED = """
sc as (select *, l_quantity * 2 as actual,
              least(100.0::double, greatest(0.0::double, l_quantity * 2 + (l_discount - 0.05::double) * 200)) as predicted from lineitem)
"""

RIGHT = "case when {0} < 0 or {0} > 100 then null when {0} <= 25 then 'Very Severe' when {0} <= 50 then 'Severe' when {0} <= 75 then 'Moderate' else 'Mild' end"
LEFT = "case when {0} < 25 then 'Very Severe' when {0} < 50 then 'Severe' when {0} < 75 then 'Moderate' when {0} is not null then 'Mild' end"
ROUNDED = "least(100.0::double, greatest(0.0::double, round_even({0}, 0)))"


def stats13(x: str, prefix: str = "") -> str:
    q = {"p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}
    cols = [f"min({x}) as {prefix}min", *(f"quantile_cont({x}, {v}) as {prefix}{k}" for k, v in q.items()), f"max({x}) as {prefix}max", f"avg({x}) as {prefix}mean",
            f"case when count({x}) > 0 then coalesce(stddev_samp({x}), 0) end as {prefix}std", f"skewness({x}) as {prefix}skew", f"kurtosis({x}) as {prefix}kurt",
            f"quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) as {prefix}iqr", f"mad({x}) as {prefix}mad"]
    return ", ".join(cols)


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with transcript codes at the end, which they do not hold themselves."""
    return read(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit(" &uh [//] <x> (.) (1.2) xxx 12_34 niño's")))


CODED = "cd as (select * replace (text || ' &uh [//] <x> (.) (1.2) xxx 12_34 niño''s' as text) from documents)"


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, tag, lemma, n_phones) of the benchmark's words: tag by length, lemma without a final s."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[\w'-]+\b"), F.lit(0))).alias("word")
    n = F.length("word")
    tag = F.when(n <= 2, "DET").when(n <= 4, "NOUN").when(n <= 6, "VERB").when(n <= 8, "ADJ").otherwise("ADV")
    return read(spark, sf_dir, "benchmark").select(word).distinct().select("word", tag.alias("tag"), F.regexp_replace("word", "s$", "").alias("lemma"), n.alias("n_phones"))


LEXICON = r"""
lx as (select word, case when length(word) <= 2 then 'DET' when length(word) <= 4 then 'NOUN' when length(word) <= 6 then 'VERB' when length(word) <= 8 then 'ADJ' else 'ADV' end as tag,
              regexp_replace(word, 's$', '') as lemma, length(word)::int as n_phones
       from (select distinct unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_''-]*[\p{L}\p{N}_]|[\p{L}\p{N}_]')) as word from benchmark)),
tk as (select doc_id, word from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_''-]*[\p{L}\p{N}_]|[\p{L}\p{N}_]')) as word from documents)),
tg as (select t.doc_id, t.word, coalesce(l.tag, case when regexp_full_match(t.word, '[0-9]+') then 'NUM' when t.word like '%ly' then 'ADV' when t.word like '%ing' or t.word like '%ed' then 'VERB' else 'X' end) as tag,
              coalesce(l.lemma, t.word) as lemma, l.n_phones from tk t left join lx l on t.word = l.word)
"""


def settled(df: DataFrame) -> DataFrame:
    """Moments within 1e-9 of 0 as 0, which they are in either engine but for its order of summing."""
    return df.withColumns({c: F.when(F.abs(c) < 1e-9, 0.0).otherwise(F.col(c)) for c in df.columns if c.endswith(("_skew", "_kurt"))})


def settled_sql(query: str, names: list[str]) -> str:
    return f"select * replace ({', '.join(f'case when abs({n}) < 1e-9 then 0.0::double else {n} end as {n}' for n in names)}) from ({query})"
