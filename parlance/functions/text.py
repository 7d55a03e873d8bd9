"""Transcript text: cleaning, tokens, counts, chunks. Patterns are Unicode-aware where words are meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewrites of transcript codes, in order.
CLEANING = (
    (r"(?U)\b\d+_\d+\b", ""),
    (r"\[[\^:]\]", ""),
    (r"<[^>]*>", ""),
    (r"\[[^\]]*\]", ""),
    (r"xxx|www", ""),
    (r"(?U)&=\w+", ""),
    (r"(?U)&\w+", ""),
    (r"(?U)@\w+", ""),
    (r"\(\.\)", " "),
    (r"(?U)\([\d.]+\)", " "),
    (r"\([^)]*\)", " "),
    (r"[+/]", " "),
    (r"[:;]", " "),
    (r"(?U)[^\w\s']", " "),
    (r"(?U)\s+", " "),
)
WORDS = r"[A-Za-zÀ-ÿ']+"
#: Filled pauses and repair codes.
FILLER_PATTERNS = ("&uh+", "&um+", "&er+", "&mm+", "&hmm+", "&eh+", "&em+", "&ah+", "&oh+")
FILLER_WORDS = ("uh", "um", "er", "mm", "hmm", "mhm", "uh-huh", "um-hum", "eh", "em", "este", "pues", "doncs")
REPAIR_CODES = (r"\[/\]", r"\[//\]", r"\[/\?\]")


def clean(text: Column) -> Column:
    """Speech without transcript codes, in single spaces, trimmed."""
    for pattern, put in CLEANING:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put))
    return F.trim(text)


def words(text: Column) -> Column:
    """Runs of Latin letters and apostrophes; an underscore is a space. Null: none."""
    return F.coalesce(F.regexp_extract_all(F.replace(text, F.lit("_"), F.lit(" ")), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def lexical_tokens(text: Column) -> Column:
    """Words with inner or outer hyphens and apostrophes."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b[\w'-]+\b"), F.lit(0))


def strip_end_marks(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"[.!?]+$"), F.lit(""))


def fillers(text: Column, dedupe: bool = False) -> Column:
    """Filled pauses by code, by word, and repair codes. A coded one that is a listed word counts twice unless ``dedupe``."""
    coded = sum((F.regexp_count(text, F.lit("(?i)" + p)) for p in FILLER_PATTERNS), F.lit(0))
    said = F.regexp_replace(F.lower(text), F.lit(r"(?U)&\w+"), F.lit(" ")) if dedupe else F.lower(text)
    tokens = F.regexp_extract_all(said, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    listed = F.size(F.filter(tokens, lambda w: w.isin(*FILLER_WORDS)))
    return coded + listed + sum((F.regexp_count(text, F.lit(p)) for p in REPAIR_CODES), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def sentence_marks(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[.?!]")), F.lit(0))


def trim_to_rate(tokens: Column, seconds: Column, most: float = 3.5, target: float = 2.6) -> Column:
    """Where there are more than ``most`` words a second: the first ``target`` a second, one at least; none in no time."""
    n = F.size(tokens)
    keep = F.greatest(F.lit(1), F.least(n, F.floor(seconds * target).cast("int")))
    fast = n / F.greatest(seconds, F.lit(1e-6)) > most
    return F.when((seconds <= 0) | (n == 0), F.array().cast("array<string>")).when(fast, F.slice(tokens, F.lit(1), keep)).otherwise(tokens)


def chunks(tokens: Column, seconds: Column, size: int = 40) -> Column:
    """array<struct<chunk, words, start_sec, end_sec>>: runs of ``size`` words with their share of the time, less 1 ms at the end."""
    def cut(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        end = lambda i: F.least(i + size, n) / n * seconds
        return F.transform(starts, lambda i: F.struct((i / size).cast("int").alias("chunk"), F.slice(w, i + 1, F.lit(size)).alias("words"), (i / n * seconds).alias("start_sec"), F.greatest(i / n * seconds, end(i) - 0.001).alias("end_sec")))

    return F.get(F.transform(F.array(tokens), cut), F.lit(0))  # the words are made once, not for each chunk


def sub_dataset(key: Column) -> Column:
    """Leading letters of a key in lower case, else ``unknown``."""
    letters = F.lower(F.regexp_extract(F.coalesce(key, F.lit("")), r"^([A-Za-z]+)", 1))
    return F.when(letters.isin("", "nan", "none"), "unknown").otherwise(letters)


def phone_estimate(n: Column) -> Column:
    return F.floor(n * 3.5).cast("int")


#: 17 universal tags to 12.
TAGS12 = {"NOUN": "NOUN", "PROPN": "NOUN", "VERB": "VERB", "AUX": "VERB", "ADJ": "ADJ", "ADV": "ADV", "PRON": "PRON", "DET": "DET", "ADP": "ADP", "NUM": "NUM", "CONJ": "CONJ", "CCONJ": "CONJ", "SCONJ": "CONJ", "PART": "PRT", "PUNCT": ".", "INTJ": "X", "SYM": "X", "X": "X"}


def tags12(tags: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TAGS12.items() for x in pair])
    return F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), F.lit("X")))
