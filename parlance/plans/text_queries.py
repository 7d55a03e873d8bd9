"""Text, headers and utterances, with documents, conversations and pages as recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import headers, text
from parlance.operators import transcripts as tr
from parlance.plans import tables as t
from parlance.sources.files import stem

QUERIES, ORACLE_SQL = {}, {}
_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_]"


def clean_text(spark, sf_dir):
    return t.coded(spark, sf_dir).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


def _clean_sql(x: str) -> str:
    steps = ((rf"(^|{_NW})[0-9]+_[0-9]+($|{_NW})", r"\1\2"), (r"\[[\^:]\]", ""), ("<[^>]*>", ""), (r"\[[^\]]*\]", ""), ("xxx|www", ""), (f"&={_W}+", ""), (f"&{_W}+", ""), (f"@{_W}+", ""),
             (r"\(\.\)", " "), (r"\([0-9.]+\)", " "), (r"\([^)]*\)", " "), ("[+/]", " "), ("[:;]", " "), (r"[^\p{L}\p{N}_\s'']", " "), (r"\s+", " "))
    for pattern, put in steps:
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return f"trim({x})"


ORACLE_SQL["clean_text"] = f"with {t.CODED} select doc_id, {_clean_sql('text')} as cleaned from cd"


def tokenize(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


ORACLE_SQL["tokenize"] = "select word, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(regexp_extract_all(replace(text, '_', ' '), '[A-Za-zÀ-ÿ'']+')) as word from documents) group by word"


def lexical_tokens(spark, sf_dir):
    return t.read(spark, sf_dir, "benchmark").select("item_id", F.size(text.lexical_tokens(F.lower("text"))).alias("n"))


ORACLE_SQL["lexical_tokens"] = rf"select item_id, length(regexp_extract_all(lower(text), '{_W}[\p{{L}}\p{{N}}_''-]*{_W}|{_W}'))::int as n from benchmark"


def _as_recordings(spark, sf_dir):
    """Each conversation as a transcript file: users are the speaker, others are not; long turns continue on a second line."""
    rows = t.read(spark, sf_dir, "conversations").withColumn("said", F.regexp_replace("text", "\n", " "))
    mark = F.when(F.col("role") == "user", "*PAR:").otherwise("*INV:")
    line = F.concat(mark, "said", F.lit("\n\tand on\n%mor:\tx"))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))["line"], "\n")
    return rows.groupBy("conv_id").agg(F.concat(F.lit("@UTF8\n@Begin\n"), joined, F.lit("\n@End")).alias("text"))


def utterance_blocks(spark, sf_dir):
    return tr.tier_blocks(_as_recordings(spark, sf_dir), "conv_id")


_UTT = r"""ut as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as utt_idx, trim(replace(text, chr(10), ' ') || ' and on', ' ') as text from conversations where role = 'user')"""
ORACLE_SQL["utterance_blocks"] = f"with {_UTT} select conv_id, utt_idx, text from ut"


def transcript(spark, sf_dir):
    return tr.transcripts(tr.cleaned_utterances(tr.tier_blocks(_as_recordings(spark, sf_dir), "conv_id")), "conv_id")


ORACLE_SQL["transcript"] = f"""with {_UTT}, c as (select conv_id, utt_idx, {_clean_sql('text')} as text from ut)
select conv_id, lower(array_to_string(flatten(list(regexp_extract_all(replace(text, '_', ' '), '[A-Za-zÀ-ÿ'']+') order by utt_idx)), ' ')) as transcript from c where text <> '' group by conv_id"""


def filler_counts(spark, sf_dir):
    return t.coded(spark, sf_dir).select("doc_id", text.fillers(F.col("text")).alias("n_fillers"), text.fillers(F.col("text"), dedupe=True).alias("n_once"))


_CODES = " + ".join(f"length(regexp_extract_all(text, '(?i){p}'))" for p in text.FILLER_PATTERNS)
_REPAIRS = " + ".join(f"length(regexp_extract_all(text, '{p}'))" for p in text.REPAIR_CODES)
_LISTED = ", ".join(f"'{w}'" for w in text.FILLER_WORDS)


def _hits(x: str) -> str:
    return f"length(list_filter(regexp_extract_all({x}, '{_W}+'), lambda w: w in ({_LISTED})))"


ORACLE_SQL["filler_counts"] = f"""with {t.CODED} select doc_id, ({_CODES} + {_hits('lower(text)')} + {_REPAIRS})::int as n_fillers,
({_CODES} + {_hits(f"regexp_replace(lower(text), '&{_W}+', ' ', 'g')")} + {_REPAIRS})::int as n_once from cd"""


def text_lengths(spark, sf_dir):
    x = F.col("text")
    return t.read(spark, sf_dir, "documents").select("doc_id", text.word_count(x).alias("n_words"), text.sentence_marks(x).alias("n_marks"), text.phone_estimate(text.word_count(x)).alias("n_phones"), F.length(text.strip_end_marks(x)).alias("n_stripped"))


ORACLE_SQL["text_lengths"] = r"""select doc_id, length(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))::int as n_words, length(regexp_extract_all(text, '[.?!]'))::int as n_marks,
floor(length(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) * 3.5::double)::int as n_phones, length(regexp_replace(text, '[.!?]+$', ''))::int as n_stripped from documents"""


def wps_trim(spark, sf_dir):
    kept = text.trim_to_rate(text.words(F.col("text")), F.col("n_chars") / 25)
    return t.read(spark, sf_dir, "documents").select("doc_id", F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, " ")).alias("digest"))


ORACLE_SQL["wps_trim"] = """with w as (select doc_id, regexp_extract_all(replace(text, '_', ' '), '[A-Za-zÀ-ÿ'']+') as w, n_chars / 25.0::double as sec from documents),
k as (select doc_id, case when sec <= 0 or length(w) = 0 then [] when length(w) / greatest(sec, 1e-6) > 3.5::double then w[1:greatest(1, least(length(w), floor(sec * 2.6::double)))::int] else w end as k from w)
select doc_id, length(k)::int as n_kept, md5(array_to_string(k, ' ')) as digest from k"""


def word_chunks(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").select("doc_id", F.explode(text.chunks(text.words(F.col("text")), F.col("n_chars") / 15)).alias("c"))
    return rows.select("doc_id", "c.chunk", F.size("c.words").alias("n"), "c.start_sec", "c.end_sec")


ORACLE_SQL["word_chunks"] = """with w as (select doc_id, length(regexp_extract_all(replace(text, '_', ' '), '[A-Za-zÀ-ÿ'']+'))::int as n, n_chars / 15.0::double as sec from documents),
c as (select doc_id, n, sec, unnest(range(0, n, 40))::int as i from w)
select doc_id, (i // 40)::int as chunk, (least(i + 40, n) - i)::int as n, i / n * sec as start_sec, greatest(i / n * sec, least(i + 40, n) / n * sec - 0.001::double) as end_sec from c"""


def subdataset(spark, sf_dir):
    key = F.concat(F.when(F.col("p_partkey") % 5 == 0, F.lit("7")).otherwise(F.lit("")), "p_name")
    return t.read(spark, sf_dir, "part").select("p_partkey", text.sub_dataset(key).alias("subdataset"))


ORACLE_SQL["subdataset"] = """with p as (select p_partkey, lower(regexp_extract(case when p_partkey % 5 = 0 then '7' else '' end || p_name, '^([A-Za-z]+)', 1)) as s from part)
select p_partkey, case when s in ('', 'nan', 'none') then 'unknown' else s end as subdataset from p"""


def language_map(spark, sf_dir):
    raw = F.when(F.col("lang") == "es", "spa").when(F.col("lang") == "fr", "Catalan").otherwise(F.col("lang"))
    guess = headers.guess_language(F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" hola porque entonces qué")).otherwise(F.lit(""))))
    return t.read(spark, sf_dir, "documents").select("doc_id", headers.language(raw).alias("language"), guess.alias("guess"))


_VOTE = "({0})"
ORACLE_SQL["language_map"] = """with d as (select doc_id, lower(case lang when 'es' then 'spa' when 'fr' then 'Catalan' else lang end) as raw,
lower(substr(text || case when doc_id % 3 = 0 then ' hola porque entonces qué' else '' end, 1, 5000)) as low from documents)
select doc_id, case when contains(raw, 'spa') then 'es' when contains(raw, 'cat') then 'ca' else 'en' end as language,
case when contains(low, 'hola')::int + contains(low, 'porque')::int + contains(low, 'entonces')::int + contains(low, 'qué')::int > 2 then 'es'
     when contains(low, 'com')::int + contains(low, 'què')::int + contains(low, 'això')::int + contains(low, 'molt')::int > 2 then 'ca' else 'en' end as guess from d"""


def language_guess(spark, sf_dir):
    """By as many characters as the operator reads; the cue stands near their end."""
    cue = F.when(F.col("doc_id") % 3 == 0, F.lit(" hola porque entonces qué ")).otherwise(F.lit(""))
    said = F.concat(F.substring("text", 1, 4900), cue, F.substring("text", 4901, 2147483647))
    return t.read(spark, sf_dir, "documents").select("doc_id", headers.guess_language(said).alias("guess"))


ORACLE_SQL["language_guess"] = """with d as (select doc_id, lower(substr(substr(text, 1, 4900) || case when doc_id % 3 = 0 then ' hola porque entonces qué ' else '' end || substr(text, 4901), 1, 5000)) as low from documents)
select doc_id, case when contains(low, 'hola')::int + contains(low, 'porque')::int + contains(low, 'entonces')::int + contains(low, 'qué')::int > 2 then 'es'
     when contains(low, 'com')::int + contains(low, 'què')::int + contains(low, 'això')::int + contains(low, 'molt')::int > 2 then 'ca' else 'en' end as guess from d"""


def header_fields(spark, sf_dir):
    """Headers made of the customers' columns, read back."""
    c = t.read(spark, sf_dir, "customer")
    score = F.pmod(F.col("c_custkey") * 7, F.lit(140)).cast("string")
    line = F.concat(F.lit("@UTF8\n@Languages:\tspa\n@ID:\teng|corpus|PAR|"), F.pmod("c_custkey", F.lit(90)).cast("string"), F.lit(";00.|female|"), F.lower("c_mktsegment"), F.lit("||Participant||"), F.lower("c_mktsegment"), F.lit("|"), score, F.lit("|\n*PAR:\tx\n@End"))
    return tr.metadata(c.select(F.col("c_custkey").alias("patient_id"), line.alias("text"))).drop("group", "error")


ORACLE_SQL["header_fields"] = """select c_custkey as patient_id, case when (c_custkey * 7) % 140 <= 100 then ((c_custkey * 7) % 140)::double end as "QA", 'es' as language, 'female' as sex, (c_custkey % 90)::int as age,
lower(c_mktsegment) as aphasia_type, lower(c_mktsegment) as group_original from customer"""


def page_stems(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", stem("url").alias("stem"))


ORACLE_SQL["page_stems"] = r"select page_id, regexp_extract(url, '([^/]+?)(\.[^./]+)?$', 1) as stem from pages"


def group_names(spark, sf_dir):
    name = F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" Healthy")).when(F.col("o_orderkey") % 3 == 1, F.lit(" aphasic")).otherwise(F.lit("")))
    return t.read(spark, sf_dir, "orders").groupBy(headers.named_group(name, F.when(F.col("o_orderstatus") == "F", "control")).alias("g")).agg(F.count("*").alias("n"))


ORACLE_SQL["group_names"] = "select case when o_orderkey % 3 = 0 then 'control' when o_orderkey % 3 = 1 then 'pwa' when o_orderstatus = 'F' then 'control' end as g, count(*) as n from orders group by 1"


def numbered_per_language(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return tr.numbered(rows, "lang", ["doc_id"], 500, "CV23_").select("doc_id", "participant_id")


ORACLE_SQL["numbered_per_language"] = "select doc_id, 'CV23_' || upper(lang) || '_' || lpad(n::varchar, 5, '0') as participant_id from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as n from documents) where n <= 500"

QUERIES |= {f.__name__: f for f in (clean_text, tokenize, lexical_tokens, utterance_blocks, transcript, filler_counts, text_lengths, wps_trim, word_chunks, subdataset, language_map, language_guess, header_fields, page_stems, group_names, numbered_per_language)}
