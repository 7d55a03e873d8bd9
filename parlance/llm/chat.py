"""Chat formatting with a grammar round trip, in native expressions only.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In a text the grammar has no ``<|``, and one backslash is taken
out of each ``<\\...\\|``; escaping puts one in, so it can be undone in any text. Content is escaped only where the
turn, rendered and parsed again, is not what it was. The whole conversation is parsed once more in the end; if it is
not what it was, all of its turns are escaped, and it is parsed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_MARK, _ESCAPED = r"<(\\*)\|", r"<\\(\\*)\|"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_MARK), F.lit(r"<\\$1|"))


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit(r"<$1|"))


def escape_role(role: Column) -> Column:
    doubled = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape_text(doubled)


def unescape_role(role: Column) -> Column:
    pieces = F.split(unescape_text(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; null where it is not of the grammar."""
    chunks = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(chunks, 1, F.size(chunks) - 1)

    def turn(chunk: Column) -> Column:
        rest = F.substr(chunk, F.lit(len(START) + 1))
        role = F.substring_index(rest, "\n", 1)
        text = F.substr(rest, F.length(role) + 2)
        fits = chunk.startswith(START) & rest.contains("\n") & ~rest.contains("<|")
        return F.when(fits, F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text")))

    parsed = F.transform(turns, turn)
    whole = (F.element_at(chunks, -1) == "") & ~F.exists(parsed, lambda x: x.isNull())
    return F.when(whole, parsed)


def _round_trips(role: Column, text: Column, role_was: Column, text_was: Column) -> Column:
    fits = ~F.concat(role, F.lit("\n"), text).contains("<|") & ~role.contains("\n")
    return fits & (unescape_role(role) == role_was) & (unescape_text(text) == text_was)


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, parsed, reads_back): one row a conversation of ``turns``, which has a row for each turn.

    ``loss_spans``: array<struct<start, end>> of code points, from 0, end excluded: the (escaped) texts of
    ``loss_role``. ``parsed``: the turns read back from ``formatted``; ``reads_back`` says that they are those of the
    source. Where that is false ``formatted`` must not be used; escaping is such that it never is, and one conversation
    of its kind does not end the job. Escaping is by turn, and before turns are brought together. A conversation is one
    row of the result, so its turns meet in one task.

    Null role or text: empty. Turns in the order of turn (null first), role, text; ties are kept. A null conversation
    id is a conversation. Other columns are ignored, whatever their names. Empty table: no rows.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    plain = _round_trips(F.col("role"), F.col("text"), F.col("role"), F.col("text"))
    rows = rows.withColumn("plain", plain).select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("plain"), F.col("role")).otherwise(escape_role(F.col("role"))).alias("out_role"),
        F.when(F.col("plain"), F.col("text")).otherwise(escape_text(F.col("text"))).alias("out_text"),
    )
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rendered = render_turn(F.col("out_role"), F.col("out_text"))
    rows = rows.withColumn("pos", F.row_number().over(by_turn)).withColumn("rendered", rendered)
    through = F.sum(F.length("rendered").cast("long")).over(by_turn.rowsBetween(Window.unboundedPreceding, 0))
    end = F.col("through") - len(END)
    span = F.when(F.col("role") == loss_role, F.struct((end - F.length("out_text")).alias("start"), end.alias("end")))
    rows = rows.withColumn("through", through).select("conv_id", "pos", "rendered", span.alias("span"), F.struct("role", "text").alias("source"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rendered", "span", "source"))).alias("t"))
    whole = grouped.select("conv_id", "t", F.array_join("t.rendered", "").alias("formatted"), F.filter("t.span", lambda x: x.isNotNull()).alias("loss_spans"))
    whole = whole.withColumn("parsed", parse_turns(F.col("formatted")))
    whole = whole.withColumn("same", F.coalesce(F.col("parsed") == F.col("t.source"), F.lit(False)))
    escaped, spans = _all_escaped(F.col("t.source"), loss_role)
    whole = whole.select(
        "conv_id", "t", "same",
        F.when(F.col("same"), F.col("formatted")).otherwise(escaped).alias("formatted"),
        F.when(F.col("same"), F.col("loss_spans")).otherwise(spans).alias("loss_spans"),
        F.col("parsed").alias("first"),
    ).withColumn("parsed", F.when(F.col("same"), F.col("first")).otherwise(parse_turns(F.col("formatted"))))
    return whole.select("conv_id", "formatted", "loss_spans", "parsed", F.coalesce(F.col("parsed") == F.col("t.source"), F.lit(False)).alias("reads_back"))


def _all_escaped(source: Column, loss_role: str) -> tuple[Column, Column]:
    """(formatted, loss spans) of turns that are all escaped."""
    turns = F.transform(source, lambda x: F.struct(x["role"].alias("role"), escape_text(x["text"]).alias("out"), render_turn(escape_role(x["role"]), escape_text(x["text"])).alias("rendered")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def after(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["rendered"])
        end = at - len(END)
        span = F.struct((end - F.length(x["out"])).alias("start"), end.alias("end"))
        spans = F.when(x["role"] == loss_role, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(at.cast("long").alias("at"), spans.alias("spans"))

    joined = F.array_join(F.transform(turns, lambda x: x["rendered"]), "")
    return joined, F.aggregate(turns, start, after)["spans"]


def chat_digests(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Counts and digests of conversations as read back from ``formatted``; those of the loss by its spans.

    If the spans of a conversation that reads back did not hold the texts of ``loss_role``, the query would fail: the mask
    is wrong then, and so may be that of others. A conversation that does not read back has null counts and digests, but
    for ``formatted_chars``. Null ids and null roles are values; of a repeated id, all rows are one conversation, as
    format_chat has it. Empty table: no rows.
    """
    said = F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    turns = F.transform(F.filter("parsed", lambda x: x["role"] == loss_role), lambda x: x["text"])
    masked = F.transform("loss_spans", lambda x: unescape_text(F.substr("formatted", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    wrong = F.raise_error(F.lit("a loss span is not a turn to learn")).cast("array<string>")
    good = F.coalesce(F.col("reads_back"), F.lit(False))
    checked = F.when(good, F.when(F.coalesce(masked == turns, F.lit(False)), masked).otherwise(wrong))
    learnt = F.array_join("masked", "")
    return formatted.withColumn("masked", checked).select(
        "conv_id",
        F.when(good, F.size("parsed").cast("long")).alias("n_turns"),
        F.when(good, F.sha2(said.cast("binary"), 256)).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
