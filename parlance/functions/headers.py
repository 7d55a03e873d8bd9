"""Fields of transcript headers, and values normalised from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diagnoses that make a speaker one of the patients, and the one that makes a control.
PATIENT_GROUPS = ("anomic", "broca", "conduction", "wernicke", "global", "transmotor", "transsensory", "isolation", "pwa", "control")
CONTROL_GROUPS = ("notaphasicbywab",)
#: What to look for, in order, in fields that may name a group.
GROUP_WORDS = (("control", "control"), ("typical", "control"), ("nonaphasic", "control"), ("healthy", "control"), ("pwa", "pwa"), ("aphasia", "pwa"), ("aphasic", "pwa"))
#: Words that vote for a language where no header names it.
LANGUAGE_WORDS = (("es", ("hola", "porque", "entonces", "qué")), ("ca", ("com", "què", "això", "molt")))
#: Ages of decades.
DECADES = {"teens": 18, "twenties": 25, "thirties": 35, "fourties": 45, "forties": 45, "fifties": 55, "sixties": 65, "seventies": 75, "eighties": 85, "nineties": 95}


def header(text: Column, name: str) -> Column:
    """The rest of the first line ``@name:``, trimmed; null if there is none."""
    found = F.trim(F.regexp_extract(text, rf"(?m)^@{name}:[ \t]*([^\n]*)", 1))
    return F.when(found != "", found)


def id_field(text: Column, index: int) -> Column:
    """A pipe field of the ``@ID`` line, from 0; null if empty or missing."""
    field = F.trim(F.get(F.split(header(text, "ID"), r"\|"), F.lit(index)))
    return F.when(field != "", field)


def id_custom(text: Column) -> Column:
    """All that follows the ninth pipe of the ``@ID`` line."""
    return F.regexp_replace(F.regexp_extract(header(text, "ID"), r"^(?:[^|]*\|){9}(.*)$", 1), r"\|$", "")


def language(raw: Column) -> Column:
    """es, ca, else en."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low.contains("spa"), "es").when(low.contains("cat"), "ca").otherwise("en")


def guess_language(text: Column, named: Column | None = None, look: int = 5000) -> Column:
    """By the header's language if there is one, else where over two of a language's words occur in the first ``look`` characters, else en."""
    low = F.lower(F.substring(text, 1, look))
    guess = F.lit(None).cast("string")
    for code, words in reversed(LANGUAGE_WORDS):
        votes = sum((low.contains(w).cast("int") for w in words), F.lit(0))
        guess = F.when(votes > 2, code).otherwise(guess)
    guess = F.coalesce(guess, F.lit("en"))
    if named is None:
        return guess
    raw = F.lower(named)
    by_name = F.when(raw.contains("es") | raw.contains("spa"), "es").when(raw.contains("ca"), "ca").when(raw.contains("en"), "en")
    return F.coalesce(by_name, guess)


def is_english(text: Column, stem: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)@Languages:\s*eng"), F.lit(False)) | F.coalesce(stem.endswith("_en"), F.lit(False))


def simple_group(raw: Column, patients: tuple[str, ...] = PATIENT_GROUPS, controls: tuple[str, ...] = CONTROL_GROUPS) -> Column:
    """control or pwa by the listed diagnoses, else null. ``control`` itself counts among the patients by default."""
    return F.when(raw.isin(*controls), "control").when(raw.isin(*patients), "pwa")


def named_group(*fields: Column) -> Column:
    """The group that the first telling field names, by the first of GROUP_WORDS that it contains."""
    def one(field: Column) -> Column:
        found = F.lit(None).cast("string")
        for word, group in reversed(GROUP_WORDS):
            found = F.when(F.lower(field).contains(word), group).otherwise(found)
        return found

    return F.coalesce(*map(one, fields))


def path_group(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("control") | low.contains("typical") | low.contains("healthy"), "Control").otherwise("PWA")


def age_years(raw: Column) -> Column:
    """``55;00.`` is 55; null where no number leads."""
    return F.element_at(F.split(F.element_at(F.split(raw, ";"), 1), r"\."), 1).try_cast("int")


def decade_years(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DECADES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(raw)), raw.try_cast("int"))


def gender(raw: Column) -> Column:
    """female or male; female is asked first, as it contains male."""
    low = F.lower(raw)
    return F.when(low.contains("female"), "female").when(low.contains("male"), "male")


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(raw: Column) -> Column:
    """A double where the trimmed text is a plain number, else null."""
    text = F.trim(raw)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def custom_score(raw: Column) -> Column:
    """The last of the pipe fields that is a number from 0 to 100."""
    found = F.filter(F.transform(F.split(raw, r"\|"), number), lambda x: x.between(0, 100))
    return F.try_element_at(found, F.lit(-1))


def custom_type(raw: Column) -> Column:
    """The last of the pipe fields that is no number."""
    found = F.filter(F.transform(F.split(raw, r"\|"), F.trim), lambda x: (x != "") & ~x.rlike(_NUMBER) & ~x.rlike(r"^[\d.]+$"))
    return F.try_element_at(found, F.lit(-1))
