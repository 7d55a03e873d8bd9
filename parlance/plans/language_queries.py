"""N-gram models, norms and lexical features over documents tagged by the small lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import stats
from parlance.functions.text import tags12
from parlance.operators import language_model as lm
from parlance.operators import lexicon
from parlance.plans import tables as t

QUERIES, ORACLE_SQL = {}, {}
#: So many labels (of two numbers each) are broadcast to the lines of the documents; more are joined by a shuffle.
BROADCAST_LABELS = 4_000_000


def _tagged(spark, sf_dir):
    words = lexicon.tokens(t.read(spark, sf_dir, "documents"), ["doc_id"], "text")
    return lexicon.tagged(words, t.lexicon(spark, sf_dir))


def _sequences(spark, sf_dir):
    """(doc_id, tags, quality): tags of a document by the length of its words, by line as utterances."""
    by_length = lambda w: F.when(F.length(w) <= 2, "DET").when(F.length(w) <= 4, "NOUN").when(F.length(w) <= 6, "VERB").when(F.length(w) <= 8, "ADJ").otherwise("ADV")
    words = F.filter(F.split("line", " "), lambda w: w != "")
    lines = t.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("utt", "line"))
    rows = lines.select("doc_id", "utt", F.transform(words, by_length).alias("tags")).filter(F.size("tags") > 0)
    labels = t.read(spark, sf_dir, "labels").select("doc_id", "quality")
    return rows.join(F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels, "doc_id", "left")


_SEQ = """ln as (select doc_id, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as utt from documents),
sq as (select doc_id, utt, list_transform(list_filter(string_split(line, ' '), lambda w: w <> ''), lambda w: case when length(w) <= 2 then 'DET' when length(w) <= 4 then 'NOUN' when length(w) <= 6 then 'VERB' when length(w) <= 8 then 'ADJ' else 'ADV' end) as tags from ln),
ss as (select s.*, quality from sq s left join labels using (doc_id) where length(tags) > 0)"""


def _grams(name: str, source: str, n: int) -> str:
    pads = ", ".join(["'<s>'"] * (n - 1))
    return f"""{name}p as (select doc_id, utt, [{pads}] || tags || ['</s>'] as p from {source}),
{name} as (select doc_id, utt, p[i:i + {n - 2}] as context, p[i + {n - 1}] as tag, i from (select *, unnest(range(1, length(p) - {n - 2})) as i from {name}p))"""


def _train(spark, sf_dir, n=3):
    return lm.train(_sequences(spark, sf_dir).filter("quality = 1").select("tags"), "tags", n)


def ngram_counts(spark, sf_dir):
    model = _train(spark, sf_dir)
    out = None
    for n in (1, 2, 3):
        part = model.counts[n].select(F.lit(n).alias("n"), F.array_join("context", " ").alias("context"), "tag", "c")
        out = part if out is None else out.unionByName(part)
    return out


_TRAIN = f"{_SEQ}, tr as (select * from ss where quality = 1), {_grams('g1', 'tr', 1)}, {_grams('g2', 'tr', 2)}, {_grams('g3', 'tr', 3)}"
ORACLE_SQL["ngram_counts"] = f"with {_TRAIN} " + " union all ".join(f"select {n} as n, {"''" if n == 1 else "array_to_string(context, ' ')"} as context, tag, count(*) as c from g{n} group by all" for n in (1, 2, 3))

_MODEL = ", ".join(
    f"c{n} as (select {"''" if n == 1 else "array_to_string(context, ' ')"} as cx, tag, count(*) as c from g{n} group by 1, 2), t{n} as (select cx, sum(c) as total, count(*) as types from c{n} group by 1), s{n} as (select tag, sum(c) as s, sum(sum(c)) over () as w from c{n} group by 1)"
    for n in (1, 2, 3)
)


def _scored(n: int, method: str) -> str:
    """SQL of p for every n-gram of all sequences."""
    value = {"backoff": "(coalesce(c, 0) + 1.0::double) / (total + v)", "kneser-ney": "greatest(coalesce(c, 0) - 0.75::double, 0) / total + 0.75::double * types / total * coalesce(s, 0) / w"}[method]
    parts, cols = [], []
    for k in range(n, 0, -1):
        cx = "''" if k == 1 else f"array_to_string(context[{n - k + 1}:], ' ')"
        val = value.replace("total", f"t{k}.total").replace("types", f"t{k}.types").replace("coalesce(c,", f"coalesce(c{k}.c,").replace("coalesce(s,", f"coalesce(s{k}.s,").replace("/ w", f"/ (select max(w) from s{k})").replace("+ v)", "+ (select count(*) + 1 from c1))")
        parts.append(f"left join t{k} on t{k}.cx = {cx} left join c{k} on c{k}.cx = {cx} and c{k}.tag = x.tag left join s{k} on s{k}.tag = x.tag")
        cols.append(f"case when t{k}.total is not null then greatest({val}, 1e-10::double) end")
    prob = f"coalesce({cols[-1]}, 1.0::double / (select count(*) + 1 from c1))"
    for c in cols[-2::-1]:
        prob = f"coalesce({c}, greatest(0.4::double * {prob}, 1e-10::double))"
    return f"{_grams('x0', 'ss', n)}, px as (select x.doc_id, x.utt, x.context, x.tag, {prob} as prob from x0 x {' '.join(parts)})"


def _probabilities(method: str, n: int):
    def run(spark, sf_dir):
        grams = lm.ngrams(_sequences(spark, sf_dir), [], "tags", n).drop("pos").distinct()
        return lm.probabilities(grams, _train(spark, sf_dir), n, method).select(F.array_join("context", " ").alias("context"), "tag", "prob")

    return run


QUERIES |= {"backoff_prob": _probabilities("backoff", 3), "kn_prob": _probabilities("kneser-ney", 3)}
for _name, _method in (("backoff_prob", "backoff"), ("kn_prob", "kneser-ney")):
    ORACLE_SQL[_name] = f"with {_TRAIN}, {_MODEL}, {_scored(3, _method)} select distinct array_to_string(context, ' ') as context, tag, prob from px"


def cross_entropy(spark, sf_dir):
    return lm.cross_entropy(_sequences(spark, sf_dir), ["doc_id", "utt"], "tags", _train(spark, sf_dir), 2)


ORACLE_SQL["cross_entropy"] = f"with {_TRAIN}, {_MODEL}, {_scored(2, 'backoff')}, q as (select doc_id, utt, avg(-log2(prob)) as e from px group by 1, 2) select doc_id, utt, length(tags)::int as n_tags, case when length(tags) >= 2 then e end as ce, case when length(tags) >= 2 then pow(2.0::double, e) end as ppl from ss left join q using (doc_id, utt)"


def poslm_features(spark, sf_dir):
    rows = _sequences(spark, sf_dir)
    model, seen = lm.train_within(rows, "tags", F.col("quality") == 1)
    scored = lm.cross_entropy(rows, ["doc_id", "utt"], "tags", model, 3, "kneser-ney", seen=seen)
    return lm.speaker_features(scored, "doc_id", "poslm_kn_trigram")


def poslm_blocks(spark, sf_dir):
    """Both methods and both orders."""
    rows = _sequences(spark, sf_dir)
    model, seen = lm.train_within(rows, "tags", F.col("quality") == 1)
    return lm.block_features(rows, "doc_id", ["doc_id", "utt"], "tags", model, seen=seen)


_FLAT = "case when stddev_samp(ce) = 0 then 0.0::double else {0}(ce) end"


def _speaker_sql(p: str, method: str, n: int) -> str:
    """SQL of a block's features, after ``with`` and the model's tables."""
    return f"""{_scored(n, method)}, q as (select doc_id, utt, avg(-log2(prob)) as e from px group by 1, 2),
ce as (select doc_id, case when length(tags) >= {n} then e end as ce, case when length(tags) >= {n} then pow(2.0::double, e) end as ppl from ss left join q using (doc_id, utt))
select doc_id, avg(ce) as {p}ce_mean, stddev_pop(ce) as {p}ce_std, min(ce) as {p}ce_min, quantile_cont(ce, 0.25) as {p}ce_q1, quantile_cont(ce, 0.5) as {p}ce_median, quantile_cont(ce, 0.75) as {p}ce_q3, max(ce) as {p}ce_max,
quantile_cont(ce, 0.75) - quantile_cont(ce, 0.25) as {p}ce_iqr, quantile_cont(ce, 0.01) as {p}ce_p1, quantile_cont(ce, 0.99) as {p}ce_p99, quantile_cont(ce, 0.99) - quantile_cont(ce, 0.01) as {p}ce_range_p1_p99,
{_FLAT.format('skewness')} as {p}ce_skewness, {_FLAT.format('kurtosis')} as {p}ce_kurtosis, avg(ppl) as {p}ppl_mean, quantile_cont(ppl, 0.5) as {p}ppl_median from ce group by doc_id"""


ORACLE_SQL["poslm_features"] = f"with {_TRAIN}, {_MODEL}, {_speaker_sql('poslm_kn_trigram_', 'kneser-ney', 3)}"
ORACLE_SQL["poslm_blocks"] = f"with {_TRAIN}, {_MODEL}, " + ", ".join(f"{name} as (with {_speaker_sql(f'{name}_', *block)})" for name, block in lm.BLOCKS.items()) + " select * from " + " join ".join(name if i == 0 else f"{name} using (doc_id)" for i, name in enumerate(lm.BLOCKS))


def median_fill(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").join(t.read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("n_chars"))
    return lm.fill_with_medians(rows, ["quality", "n_chars"])


ORACLE_SQL["median_fill"] = """with r as (select doc_id, quality::double as quality, case when doc_id % 3 > 0 then n_chars end::double as n_chars from documents left join labels using (doc_id)), m as (select quantile_cont(quality, 0.5) as a, quantile_cont(n_chars, 0.5) as b from r)
select doc_id, coalesce(quality, a) as quality, coalesce(n_chars, b) as n_chars from r, m"""


def tag_words(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("lemma").alias("n_lemmas"), F.count("n_phones").alias("n_known"))


ORACLE_SQL["tag_words"] = f"with {t.LEXICON} select tag, count(*) as n, count(distinct lemma) as n_lemmas, count(n_phones) as n_known from tg group by tag"


def tag_map(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set("tag")).alias("tags")).select("doc_id", F.array_join(tags12("tags"), " ").alias("tags"))


ORACLE_SQL["tag_map"] = f"""with {t.LEXICON}, d as (select doc_id, list_sort(list(distinct tag)) as tags from tg group by doc_id)
select doc_id, array_to_string(tags, ' ') as tags from d"""


def type_token_ratio(spark, sf_dir):
    return lexicon.type_token_ratio(_tagged(spark, sf_dir), "doc_id")


_OPEN = "tag in ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN')"
ORACLE_SQL["type_token_ratio"] = f"with {t.LEXICON} select doc_id, count(distinct lower(lemma)) filter (where {_OPEN}) / nullif(count(*) filter (where {_OPEN}), 0) as lex_ttr from tg group by doc_id"


def phone_lookup(spark, sf_dir):
    """Phones by the word, else by its lemma: the table lacks the words that end in s."""
    table = t.lexicon(spark, sf_dir).filter(~F.col("word").endswith("s")).withColumn("variant", F.lit(0))
    words = _tagged(spark, sf_dir).select("doc_id", "word", "lemma")
    return lexicon.phones(words, table).groupBy("doc_id").agg(F.count("n_phones").alias("n_known"), F.sum("n_phones").alias("phones"))


ORACLE_SQL["phone_lookup"] = f"""with {t.LEXICON}, pt as (select word, n_phones from lx where word not like '%s')
select doc_id, count(coalesce(a.n_phones, b.n_phones)) as n_known, sum(coalesce(a.n_phones, b.n_phones))::bigint as phones from tg left join pt a on tg.word = a.word left join pt b on tg.lemma = b.word group by doc_id"""


def norm_stats(spark, sf_dir):
    lex = t.lexicon(spark, sf_dir)
    norms = lex.select(F.lit("freq").alias("kind"), "word", (F.col("n_phones") * 1.5).alias("value")).union(lex.filter("n_phones > 3").select(F.lit("aoa"), "word", F.col("n_phones") / 2))
    return t.settled(lexicon.norm_stats(lexicon.norm_values(lexicon.tokens(t.read(spark, sf_dir, "documents"), ["doc_id"], "text"), ["doc_id"], norms), "doc_id", ["freq", "aoa"]))


ORACLE_SQL["norm_stats"] = f"""with {t.LEXICON}, nv as (select doc_id, 'freq' as kind, n_phones * 1.5::double as v from tg where n_phones is not null union all select doc_id, 'aoa', n_phones / 2 from tg where n_phones > 3),
st as (select doc_id, kind, {t.stats13('v')} from nv group by doc_id, kind)
select d.doc_id, {', '.join(f'{k}.{n} as lex_{k}_{n}' for k in ('freq', 'aoa') for n in stats.STATS13)} from (select distinct doc_id from st) d left join (select * from st where kind = 'freq') freq using (doc_id) left join (select * from st where kind = 'aoa') aoa on d.doc_id = aoa.doc_id"""


def den_features(spark, sf_dir):
    """The density block, with lines as utterances."""
    lines = t.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("utt_idx", "line"))
    words = lexicon.tagged(lexicon.tokens(lines, ["doc_id", "utt_idx"], "line"), t.lexicon(spark, sf_dir))
    speech = t.read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15).alias("speech_sec"))
    return t.settled(lexicon.density_features(lexicon.tag_counts(words, ["doc_id", "utt_idx"]), speech, "doc_id"))


_TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_''-]*[\p{L}\p{N}_]|[\p{L}\p{N}_]"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
ORACLE_SQL["den_features"] = f"""with {t.LEXICON}, li as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as utt from documents),
lt as (select doc_id, utt, unnest(regexp_extract_all(lower(line), '{_TOKEN}')) as word from li),
lg as (select t.doc_id, utt, coalesce(l.tag, case when regexp_full_match(t.word, '[0-9]+') then 'NUM' when t.word like '%ly' then 'ADV' when t.word like '%ing' or t.word like '%ed' then 'VERB' else 'X' end) as tag, lower(coalesce(l.lemma, t.word)) as lemma from lt t left join lx l on t.word = l.word),
u as (select doc_id, utt, count(*)::double as words, floor(count(*) * 3.5::double)::double as phones, count_if(tag in {_in(lexicon.OPEN_TAGS)})::double as open_words, count_if(tag = 'INTJ')::double as interj, count_if(tag in ('NOUN', 'PROPN'))::double as nouns,
 count_if(tag = 'VERB')::double as verbs, count_if(tag = 'VERB' and lemma in {_in(lexicon.LIGHT_VERBS['en'])})::double as light, count_if(tag = 'DET')::double as determiners, count_if(tag = 'DET' and lemma in {_in(lexicon.DEMONSTRATIVES['en'])})::double as demonstratives,
 count_if(tag = 'ADP')::double as prepositions, count_if(tag = 'ADJ')::double as adjectives, count_if(tag = 'ADV')::double as adverbs, count_if(tag = 'PRON')::double as pronouns, count_if(tag in {_in(lexicon.CLOSED_TAGS)})::double as closed from lg group by 1, 2),
s as (select doc_id, {', '.join(f'sum({x}) as {x}' for x in ('words', 'phones', 'open_words', 'interj', 'nouns', 'verbs', 'light', 'determiners', 'demonstratives', 'prepositions', 'adjectives', 'adverbs', 'pronouns', 'closed'))}, {t.stats13('words', 'w_')}, {t.stats13('phones', 'p_')} from u group by doc_id),
z as (select s.*, greatest(n_chars / 15.0::double / 60, 1e-6::double) as m, greatest(words, 1e-6::double) as wd from s join documents using (doc_id))
select doc_id, words / m as den_words_per_min, phones / m as den_phones_per_min, words / greatest(words + interj, 1e-6::double) as "den_W", open_words / wd as "den_OCW", nouns / wd as den_nouns, verbs / wd as den_verbs,
nouns / greatest(verbs, 1e-6::double) as den_nouns_per_verb, nouns / greatest(nouns + verbs, 1e-6::double) as den_noun_ratio, case when verbs > 0 then light / verbs end as den_light_verbs,
{', '.join(f'{x} / wd as den_{x}' for x in ('determiners', 'demonstratives', 'prepositions', 'adjectives', 'adverbs'))}, pronouns / greatest(pronouns + nouns, 1e-6::double) as den_pronoun_ratio, closed / wd as den_function_words,
{', '.join(f'w_{x} as den_words_utt_{x}' for x in stats.STATS13)}, {', '.join(f'p_{x} as den_phones_utt_{x}' for x in stats.STATS13)} from z"""

ORACLE_SQL["norm_stats"] = t.settled_sql(ORACLE_SQL["norm_stats"], ["lex_freq_skew", "lex_aoa_skew", "lex_freq_kurt", "lex_aoa_kurt"])
ORACLE_SQL["den_features"] = t.settled_sql(ORACLE_SQL["den_features"], ["den_words_utt_skew", "den_phones_utt_skew", "den_words_utt_kurt", "den_phones_utt_kurt"])
QUERIES |= {f.__name__: f for f in (ngram_counts, cross_entropy, poslm_features, poslm_blocks, median_fill, tag_words, tag_map, type_token_ratio, phone_lookup, norm_stats, den_features)}
