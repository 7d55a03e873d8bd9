"""Word norms, tags by lexicon, and the lexical and density feature blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.stats import floored_ratio, minutes, summarise
from parlance.shared import checkpointed

#: Tags of content words and of function words.
OPEN_TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")
CLOSED_TAGS = ("ADP", "AUX", "CCONJ", "DET", "INTJ", "NUM", "PART", "PRON", "SCONJ")
#: Light verbs and demonstratives by language.
LIGHT_VERBS = {
    "en": ("be", "have", "come", "go", "give", "take", "make", "do", "get", "move", "put"),
    "es": ("ser", "estar", "haber", "tener", "hacer", "ir", "dar", "poner", "venir", "llevar", "dejar"),
    "ca": ("ser", "estar", "haver", "tenir", "fer", "anar", "donar", "posar", "venir", "dur", "deixar"),
}
DEMONSTRATIVES = {
    "en": ("this", "that", "these", "those"),
    "es": ("este", "esta", "estos", "estas", "ese", "esa", "esos", "esas", "aquel", "aquella", "aquellos", "aquellas"),
    "ca": ("aquest", "aquesta", "aquests", "aquestes", "aquell", "aquella", "aquells", "aquelles"),
}
#: A lexicon or a table of norms is broadcast up to so many bytes, with ROW_BYTES for each row; Spark chooses for larger ones.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def _small(table: DataFrame) -> DataFrame:
    """``table``, stored, to be broadcast if its strings and rows are small."""
    table = checkpointed(table)
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind == "string"), F.lit(ROW_BYTES))
    return F.broadcast(table) if (table.agg(F.sum(text)).first()[0] or 0) <= BROADCAST_BYTES else table


def tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., pos, word) of the lexical tokens of ``text``, in lower case."""
    return df.select(*keys, F.posexplode(T.lexical_tokens(F.lower(text))).alias("pos", "word"))


def tagged(words: DataFrame, lexicon: DataFrame, default: str = "X") -> DataFrame:
    """``words`` with tag, lemma and phones of the lexicon (word, tag, lemma, n_phones).

    A word that it lacks has a tag by its ending: -ly ADV, -ing and -ed VERB, digits NUM, else ``default``; itself as
    lemma; the lemma's phones, else null.
    """
    small = _small(lexicon.select("word", "tag", "lemma", "n_phones"))
    by_end = F.when(F.col("word").rlike("^[0-9]+$"), "NUM").when(F.col("word").endswith("ly"), "ADV").when(F.col("word").endswith("ing") | F.col("word").endswith("ed"), "VERB").otherwise(default)
    return words.join(small, "word", "left").withColumn("tag", F.coalesce("tag", by_end)).withColumn("lemma", F.coalesce("lemma", "word"))


def phones(words: DataFrame, pronunciations: DataFrame) -> DataFrame:
    """``words`` (word, lemma, ...) with ``n_phones`` of the word, else of the lemma, else null."""
    table = _small(pronunciations.groupBy("word").agg(F.min_by("n_phones", "variant").alias("_p")))
    own = words.join(table.withColumnRenamed("_p", "_own"), "word", "left")
    return own.join(table.select(F.col("word").alias("lemma"), F.col("_p").alias("_lemma")), "lemma", "left").withColumn("n_phones", F.coalesce("_own", "_lemma")).drop("_own", "_lemma")


def norm_values(words: DataFrame, keys: list[str], norms: DataFrame) -> DataFrame:
    """(keys..., kind, value) of each token that the norms (kind, word, value) have; the case is folded."""
    small = _small(norms.filter("value is not null").select("kind", F.lower("word").alias("word"), "value").dropDuplicates(["kind", "word"]))
    return words.withColumn("word", F.lower("word")).join(small, "word").select(*keys, "kind", "value")


def norm_stats(values: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """The 13 statistics of each kind's values by ``key``, a column for each: lex_{kind}_{name}."""
    long = summarise(values, [key, "kind"], "value")
    names = [c for c in long.columns if c not in (key, "kind")]
    wide = long.groupBy(key).pivot("kind", kinds).agg(*[F.first(n).alias(n) for n in names])
    return wide.select(key, *[F.col(f"{k}_{n}").alias(f"lex_{k}_{n}") for k in kinds for n in names])


def type_token_ratio(words: DataFrame, key: str) -> DataFrame:
    """(key, lex_ttr): distinct over all lemmas of open-class tokens; null where there are none."""
    lemma = F.when(F.col("tag").isin(*OPEN_TAGS), F.lower("lemma"))
    return words.groupBy(key).agg(F.try_divide(F.count_distinct(lemma), F.count(lemma)).alias("lex_ttr"))


def tag_counts(words: DataFrame, keys: list[str], language: str = "en") -> DataFrame:
    """Fourteen counters of tagged words by ``keys``."""
    tag, lemma = F.col("tag"), F.lower("lemma")
    n = lambda *tags: F.count_if(tag.isin(*tags))
    return words.filter(tag != "PUNCT").groupBy(*keys).agg(
        F.count("*").alias("words"), T.phone_estimate(F.count("*")).alias("phones"), n(*OPEN_TAGS).alias("open_words"), n("INTJ").alias("interj"),
        n("NOUN", "PROPN").alias("nouns"), n("VERB").alias("verbs"), F.count_if((tag == "VERB") & lemma.isin(*LIGHT_VERBS[language])).alias("light_verbs"),
        n("DET").alias("determiners"), F.count_if((tag == "DET") & lemma.isin(*DEMONSTRATIVES[language])).alias("demonstratives"),
        n("ADP").alias("prepositions"), n("ADJ").alias("adjectives"), n("ADV").alias("adverbs"), n("PRON").alias("pronouns"), n(*CLOSED_TAGS).alias("function_words"),
    )


def density_features(by_utterance: DataFrame, speech: DataFrame, key: str) -> DataFrame:
    """The density block: rates by minute, two shares, 2 x 13 utterance statistics and 12 tag ratios, 42 in all.

    ``by_utterance``: tag_counts of each utterance, which are stored; ``speech``: (key, speech_sec).
    """
    by_utterance = checkpointed(by_utterance)
    names = [c for c in by_utterance.columns if c not in (key, "utt_idx")]
    sums = by_utterance.groupBy(key).agg(*[F.sum(c).cast("double").alias(c) for c in names]).join(speech.select(key, "speech_sec"), key)
    c, r = F.col, floored_ratio
    minute = minutes(c("speech_sec"))
    ratios = sums.select(
        key, (c("words") / minute).alias("den_words_per_min"), (c("phones") / minute).alias("den_phones_per_min"),
        r(c("words"), c("words") + c("interj")).alias("den_W"), r(c("open_words"), c("words")).alias("den_OCW"),
        r(c("nouns"), c("words")).alias("den_nouns"), r(c("verbs"), c("words")).alias("den_verbs"), r(c("nouns"), c("verbs")).alias("den_nouns_per_verb"),
        r(c("nouns"), c("nouns") + c("verbs")).alias("den_noun_ratio"), F.when(c("verbs") > 0, c("light_verbs") / c("verbs")).alias("den_light_verbs"),
        *[r(c(x), c("words")).alias(f"den_{x}") for x in ("determiners", "demonstratives", "prepositions", "adjectives", "adverbs")],
        r(c("pronouns"), c("pronouns") + c("nouns")).alias("den_pronoun_ratio"), r(c("function_words"), c("words")).alias("den_function_words"),
    )
    return ratios.join(summarise(by_utterance, [key], "words", "den_words_utt_"), key).join(summarise(by_utterance, [key], "phones", "den_phones_utt_"), key)
