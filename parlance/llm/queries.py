"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import chat, decontaminate, dedup, importance, mixing, ngram_model, periodic, rules, sharding, token_counts, token_files, warc, weak_labels
from parlance.llm.text import WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.85)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("doc.text", F.lit(""))
    return sharding.write_shards(_table(spark, sf_dir, "documents"), shards=8, row_key=sharding.file_position("documents.parquet")).select(
        F.col("doc.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # order 3 scores held-out texts better, but takes more disk than the limit; README has the figures of both
    return ngram_model.held_out_scores(_table(spark, sf_dir, "documents"), order=2)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(_table(spark, sf_dir, "documents"))


_MIXING_SQL = r"""
with base as (
  select doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('11:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(md5(text), '')) as key from documents),
sizes as (select source, sum(size)::bigint as source_size from base group by source),
ranked as (
  select *, (source_size * 2)::double as most,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         row_number() over (order by source nulls last) as rank from sizes),
leveled as (
  select *, (sum(source_size) over ()::double * 1.5::double - coalesce(sum(most) over b, 0::double))
            / (sum(weight) over () - coalesce(sum(weight) over b, 0::double)) as level
  from ranked window b as (order by most / weight, rank rows between unbounded preceding and 1 preceding)),
final as (select arg_min(level, (most / weight, rank)) filter (where most >= level * weight) as final from leveled),
targets as (
  select source, source_size, case when most < final then most when final is null then most else final end as target
  from (select source, source_size, most, final * weight as final from leveled, final)),
placed as (
  select b.*, t.source_size, t.target, sum(b.size) over (partition by b.source order by b.key, b.size rows unbounded preceding) - b.size as before,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs
  from base b join targets t on b.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target, (size * copies)::bigint as taken, copies::int as copies from (
  select *, epochs + case when target - epochs * source_size > 0 and (target - epochs * source_size - before) * 2 >= size then 1 else 0 end as copies
  from placed)
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_digests(spark, path)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.chat_digests(chat.format_chat(rows.union(own)))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``: of a text whose id has h = crc32 with h % 10 = 0, the words from a on repeat p of them, as op 12's contract has it."""
    words = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    words = words.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    words = words.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    words = words.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    tailed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return words.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), tailed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_periodic_tails(_table(spark, sf_dir, "documents")))
    # a run is greater by length / period, then by a smaller start and period; the products are exact
    first = F.expr("reduce(runs, cast(null as struct<start:long,length:long,period:long>), (x, r) -> case when x is null or r.length * x.period > x.length * r.period then r else x end)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(spark, warc.write_archives(_table(spark, sf_dir, "pages"), row_key=sharding.file_position("pages.parquet")))


_WARC_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (
  select *, row_number() over (partition by payload_digest order by page_id nulls last) as k,
         first_value(page_id) over (partition by payload_digest order by page_id nulls last) as first_id from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and k > 1 then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and k > 1 then first_id end as refers_to
from f
"""

_CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as body from t),
r as (select *, '<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10) as rendered from e),
p as (
  select *, sum(length(rendered)) over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as through from r),
f as (
  select conv_id, count(*) as n_turns, string_agg(rendered, '' order by turn nulls first, role, text) as formatted,
         sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256
  from p group by conv_id),
masked as (
  select p.conv_id, string_agg(regexp_replace(substr(formatted, (through - 11 - length(body) + 1)::bigint, length(body)), '<\\(\\*)\|', '<\1|', 'g'), '' order by through) as learnt
  from p join f on p.conv_id is not distinct from f.conv_id where role = 'assistant' group by p.conv_id)
select f.conv_id, n_turns, turns_sha256, coalesce(length(learnt), 0)::bigint as loss_chars, sha256(coalesce(learnt, '')) as loss_sha256,
       length(formatted)::bigint as formatted_chars
from f left join masked on f.conv_id is not distinct from masked.conv_id
"""

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_sharding": op2_sharding,
    "op3_ngram_scores": op3_ngram_scores,
    "op4_source_mixing": op4_source_mixing,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_chat_format": op9_chat_format,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc": op13_warc,
}
ORACLE_SQL: dict[str, str] = {
    "op4_source_mixing": _MIXING_SQL,
    "op9_chat_format": _CHAT_SQL,
    "op13_warc": _WARC_SQL,
}
