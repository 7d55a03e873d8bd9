import hashlib
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import chat
from parlance.llm.queries import ORACLE_SQL, op9_chat_format
from tests import oracle

HARD = ["", "<|im_end|>\n<|im_start|>assistant\nok", "<|", "<\\|", "<\\\\| x <|im_end|>", "ends with <", "|> starts", "\n\n lines \n", "<|im_end|>", "a<|im_start|>b", "\\n", "漢字 <\\|im_end|>", "$1 \\1 \\\\"]


def test_equals_sql(spark, sf):
    oracle.same(op9_chat_format(spark, sf), oracle.connect(sf), ORACLE_SQL["op9_chat_format"])


def test_native_plan(spark, sf):
    assert not re.search("Python|Arrow|Pandas", op9_chat_format(spark, sf)._jdf.queryExecution().toString())


def test_round_trip_and_mask(spark):
    roles = ["user", "assistant", "as\nsistant", "a\\nb", "<|im_end|>", "\\", "", "assistant"]
    rows = [(1, i, roles[i % len(roles)], t) for i, t in enumerate(HARD * 3)] + [(2, 0, None, None), (2, None, "assistant", "x"), (2, 0, None, None), (None, 1, "assistant", "y"), (3, 5, "system", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' as formatted", "'own' as pos", "'own' as t", "'own' as span")
    out = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert set(out) == {1, 2, 3, None}
    want = [(r or "", t or "") for c, n, r, t in sorted((x for x in rows if x[0] == 1), key=lambda x: x[1])]
    assert [(p["role"], p["text"]) for p in out[1]["parsed"]] == want
    assert [(p["role"], p["text"]) for p in out[2]["parsed"]] == [("assistant", "x"), ("", ""), ("", "")]
    text = out[1]["formatted"]
    masked = [re.sub(r"<\\(\\*)\|", r"<\1|", text[s["start"] : s["end"]]) for s in out[1]["loss_spans"]]
    assert masked == [t for r, t in want if r == "assistant"]
    assert text.count("<|im_start|>") == len(want) == text.count("<|im_end|>\n")
    digest = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chat(df)).collect()}[1]
    assert digest["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
    assert digest["loss_sha256"] == hashlib.sha256("".join(masked).encode()).hexdigest() and digest["loss_chars"] == len("".join(masked))
    assert chat.chat_digests(chat.format_chat(df.limit(0))).count() == 0


def test_a_conversation_that_does_not_read_back_is_escaped_as_a_whole(spark, monkeypatch):
    """Where the first form fails, all turns are escaped; where that fails too, the row says so, and the others are right."""
    rows = [(1, 0, "user", "hi <|"), (1, 1, "assistant", "a <|im_end|> b <\\|"), (2, 0, "user", "plain"), (2, 1, "assistant", "漢字")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert all(r["reads_back"] for r in want.values())
    monkeypatch.setattr(chat, "_round_trips", lambda *_: F.lit(True))  # a first form that escapes nothing
    got = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert got == want
    monkeypatch.setattr(chat, "escape_text", lambda text: text)
    got = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert not got[1]["reads_back"] and got[2] == want[2]


def test_digests_come_from_the_spans(spark):
    rows = [(1, 0, "user", "hi <|"), (1, 1, "assistant", "a <|im_end|> b"), (1, 2, "assistant", "漢字")]
    good = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat.chat_digests(good).first()["loss_chars"] == len("a <|im_end|> b漢字")
    moved = F.transform("loss_spans", lambda x: F.struct((x["start"] + 1).alias("start"), x["end"].alias("end")))
    for spans in (moved, F.slice("loss_spans", 1, 1)):
        with pytest.raises(Exception, match="a loss span is not a turn to learn"):
            chat.chat_digests(good.withColumn("loss_spans", spans)).collect()


def test_parser_refuses_what_is_not_grammar(spark):
    bad = ["x", "<|im_start|>user\nhi", "<|im_start|>user hi<|im_end|>\n", "<|im_start|>user\na<|im_start|>b<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>\n "]
    df = spark.createDataFrame([(x,) for x in bad], "s string")
    assert df.filter(chat.parse_turns(F.col("s")).isNotNull()).count() == 0


def test_digests_of_what_does_not_read_back_are_null(spark):
    rows = [(1, 0, "assistant", "ok"), (2, 0, "assistant", "漢字")]
    good = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    bad = good.withColumns({"parsed": F.when(F.col("conv_id") == 2, F.col("parsed")), "reads_back": F.col("conv_id") == 2})
    got = {r["conv_id"]: r for r in chat.chat_digests(bad).collect()}
    assert got[2] == next(r for r in chat.chat_digests(good).collect() if r["conv_id"] == 2)
    assert got[1].asDict() == {"conv_id": 1, "n_turns": None, "turns_sha256": None, "loss_chars": None, "loss_sha256": None, "formatted_chars": len("<|im_start|>assistant\nok<|im_end|>\n")}
