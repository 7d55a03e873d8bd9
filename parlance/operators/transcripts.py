"""Speaker tiers, transcripts and metadata of whole recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import headers as H
from parlance.functions import text as T


def tier_blocks(recordings: DataFrame, key: str = "patient_id", text: str = "text", speaker: str = "PAR") -> DataFrame:
    """(key, utt_idx, text): utterances of ``speaker``, each with its continuation lines (they begin with a tab).

    A line that begins with ``*`` or ``%`` or ``@`` ends an utterance. Blocks are runs between such lines, by a running
    count within the recording. Blank utterances are left out.
    """
    lines = recordings.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.withColumn("starts", F.col("line").rlike(r"^[*%@]").cast("int"))
    block = F.sum("starts").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    mark = f"*{speaker}:"
    said = F.when(F.col("line").startswith(mark), F.substr("line", F.lit(len(mark) + 1))).when(F.col("line").startswith("\t"), F.substr("line", F.lit(2)))
    parts = lines.withColumn("block", block).select(key, "block", "pos", said.alias("said"), F.col("line").startswith(mark).alias("own"))
    grouped = parts.groupBy(key, "block").agg(F.max("own").alias("own"), F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("pos", "said")))).alias("parts"))
    spoken = grouped.filter("own").select(key, "block", F.trim(F.array_join("parts.said", " ")).alias("text")).filter("text <> ''")
    order = Window.partitionBy(key).orderBy("block")
    return spoken.select(key, (F.row_number().over(order) - 1).alias("utt_idx"), "text")


def cleaned_utterances(utterances: DataFrame, text: str = "text") -> DataFrame:
    """With ``text`` cleaned and ``n_words``; what cleans to nothing is left out."""
    return utterances.withColumn(text, T.clean(F.col(text))).filter(F.col(text) != "").withColumn("n_words", F.size(T.words(F.col(text))))


def transcripts(utterances: DataFrame, key: str = "patient_id", order: str = "utt_idx", text: str = "text") -> DataFrame:
    """(key, transcript): the words of all utterances in order, in lower case; null if there are none."""
    rows = utterances.select(key, F.struct(order, T.words(F.col(text)).alias("words")).alias("u"))
    joined = F.array_join(F.flatten(F.col("us.words")), " ")
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("u")).alias("us"))
    return grouped.select(key, F.when(joined != "", F.lower(joined)).alias("transcript"))


def metadata(recordings: DataFrame, key: str = "patient_id", text: str = "text") -> DataFrame:
    """A row of header fields for each recording, with ``error`` where it has no header."""
    t = F.col(text)
    raw = F.lower(H.id_field(t, 5))
    return recordings.select(
        key,
        H.simple_group(raw).alias("group"),
        H.custom_score(H.id_custom(t)).alias("QA"),
        H.language(H.header(t, "Languages")).alias("language"),
        H.gender(H.id_field(t, 4)).alias("sex"),
        H.age_years(H.id_field(t, 3)).alias("age"),
        H.custom_type(H.id_custom(t)).alias("aphasia_type"),
        raw.alias("group_original"),
        F.when(H.header(t, "ID").isNull(), "no speaker header").alias("error"),
    )


def rejected(df: DataFrame, key: str = "patient_id", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, (key, error) of the others)."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull()).select(key, error)


def render(records: DataFrame, key: str, text: str, language: str, sex: str, age: str, corpus: str = "clips") -> DataFrame:
    """(key, value): each record as a transcript file, with age and group in their own fields."""
    code = F.when(F.col(language) == "es", "spa").when(F.col(language) == "ca", "cat").otherwise("eng")
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    speaker = F.concat_ws("|", code, F.lit(corpus), F.lit("PAR"), part(H.decade_years(F.col(age).cast("string"))), part(H.gender(F.col(sex))), F.lit("control"), F.lit(""), F.lit("Participant"), F.lit(""), F.lit(""))
    value = F.concat(F.lit("@UTF8\n@Begin\n@Languages:\t"), code, F.lit("\n@Participants:\tPAR Participant\n@ID:\t"), speaker, F.lit("\n@Media:\t"), F.col(key).cast("string"), F.lit(", audio\n*PAR:\t"), F.coalesce(text, F.lit("")), F.lit("\n@End\n"))
    return records.select(key, value.alias("value"))


def numbered(df: DataFrame, partition: str, order: list[str], most: int, prefix: str) -> DataFrame:
    """The first ``most`` rows of each ``partition`` in ``order``, with ``participant_id`` counting from 1."""
    n = F.row_number().over(Window.partitionBy(partition).orderBy(*order))
    return df.withColumn("_n", n).filter(F.col("_n") <= most).withColumn("participant_id", F.concat(F.lit(prefix), F.upper(partition), F.lit("_"), F.lpad(F.col("_n").cast("string"), 5, "0"))).drop("_n")
