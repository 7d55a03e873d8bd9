from datetime import datetime

from pyspark.sql import functions as F

from parlance.functions import headers, scores, text
from parlance.operators import history, transcripts as tr
from parlance.sources import files

CHA = """@UTF8
@Begin
@Languages:\teng
@Participants:\tPAR Participant
@ID:\teng|corpus|PAR|55;00.|female|anomic||Participant|x|65.5|broca|
*PAR:\thello [//] <x> (.) (1.2) &uh &=laughs xxx @l 12_34 niño's
\tgoes on .
%mor:\tn|x
\tnot this
*INV:\tother one
*PAR:\t.
*PAR:\tlast word !
@End"""


def test_recording_to_transcript(spark):
    rec = spark.createDataFrame([("p1", CHA), ("p2", "*INV:\tnobody"), ("p3", ""), ("p4", None)], "patient_id string, text string")
    utt = tr.cleaned_utterances(tr.tier_blocks(rec)).orderBy("utt_idx").collect()
    assert [(r["patient_id"], r["text"]) for r in utt] == [("p1", "hello niño's goes on"), ("p1", "last word")]
    assert tr.transcripts(tr.cleaned_utterances(tr.tier_blocks(rec))).first()["transcript"] == "hello niño's goes on last word"
    meta = {r["patient_id"]: r for r in tr.metadata(rec).collect()}
    m = meta["p1"]
    assert (m["group"], m["QA"], m["language"], m["sex"], m["age"], m["aphasia_type"], m["error"]) == ("pwa", 65.5, "en", "female", 55, "broca", None)
    good, bad = tr.rejected(tr.metadata(rec))
    assert good.count() == 1 and bad.count() == 3


def test_render_reads_back(spark):
    df = spark.createDataFrame([("c1", "hola amigo", "es", "male", "thirties"), ("c2", None, "ca", None, None)], "id string, said string, lang string, sex string, age string")
    out = tr.render(df, "id", F.col("said"), "lang", "sex", "age").withColumnsRenamed({"id": "patient_id", "value": "text"})
    got = {r["patient_id"]: r for r in tr.metadata(out).collect()}
    assert (got["c1"]["language"], got["c1"]["age"], got["c1"]["sex"], got["c1"]["group_original"]) == ("es", 35, "male", "control")
    assert got["c2"]["age"] is None and got["c2"]["sex"] is None


def test_values(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("v")).first()["v"]
    assert one(text.fillers(F.lit("&uh well [/] um"))) == 4 and one(text.fillers(F.lit("&uh well [/] um"), dedupe=True)) == 3
    assert one(headers.age_years(F.lit("55;00."))) == 55 and one(headers.age_years(F.lit("x"))) is None
    assert one(headers.custom_score(F.lit("12|x|140|77.5|nan"))) == 77.5 and one(headers.custom_score(F.lit("x"))) is None
    assert one(headers.gender(F.lit("Female"))) == "female"
    assert one(headers.named_group(F.lit(None).cast("string"), F.lit("a Typical one"))) == "control"
    assert one(text.trim_to_rate(F.array(*map(F.lit, "abcdefgh")), F.lit(1.0))) == ["a", "b"]
    assert one(text.trim_to_rate(F.array(F.lit("a")), F.lit(0.0))) == []
    assert one(text.tags12(F.array(F.lit("PROPN"), F.lit("?")))) == ["NOUN", "X"]
    assert [one(scores.severity(F.lit(x))) for x in (0, 25, 25.5, 50, 75, 100, 101)] == ["Very Severe", "Very Severe", "Severe", "Severe", "Moderate", "Mild", None]
    assert [one(scores.severity_level(F.lit(x), "left")) for x in (24.9, 25, 50, 75, 120)] == [0, 1, 2, 3, 3]
    assert [one(scores.to_score(F.lit(x))) for x in (2.5, 3.5, -1.0, 100.4)] == [2.0, 4.0, 0.0, 100.0]


def test_files(spark, tmp_path):
    for folder, name, body in (("a", "p1.cha", CHA), ("b/c", "p1.cha", "later"), ("b", "p2.cha", "x"), ("b", "p2.txt", "no")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(body, encoding="utf-8")
    rec = files.recordings(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    got = {r["patient_id"]: r["text"] for r in rec.collect()}
    assert got == {"p1": CHA, "p2": "x"}
    index = files.file_index(spark, [str(tmp_path / "b")], ("txt",)).collect()
    assert [(r["stem"], r["length"]) for r in index] == [("p2", 2)]
    (tmp_path / "norms").mkdir()
    (tmp_path / "norms/SUBTLEX-US.csv").write_text("Words,zipfus\nThe,7.1\nbad,x\n")
    assert [tuple(r) for r in files.norms(spark, str(tmp_path / "norms")).collect()] == [("freq", "the", 7.1)]
    (tmp_path / "names").write_text("# comment\n a \n\nb\n")
    assert sorted(r["name"] for r in files.name_list(spark, str(tmp_path / "names")).collect()) == ["a", "b"]
    df = spark.createDataFrame([(2, "es", float("nan")), (1, "en", 1.0)], "k int, language string, x double")
    files.write_table(df, str(tmp_path / "out"), "k", "csv")
    back = files.table(spark, str(tmp_path / "out"), "k int, language string, x double")
    assert sorted(map(tuple, back.collect())) == [(1, "en", 1.0), (2, "es", None)]
    files.write_by(df, "language", str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").glob("language=*")} == {"language=en", "language=es"}
    rec = history.record(spark, {"model": "svr"}, {"mae": 1.5}, {"model__C": 3}, datetime(2020, 1, 1))
    files.append_record(rec, str(tmp_path / "log"))
    files.append_record(rec, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    out = tr.render(spark.createDataFrame([("c1", "hi")], "id string, said string").withColumns({"l": F.lit("es"), "s": F.lit("male"), "a": F.lit("30")}), "id", F.col("said"), "l", "s", "a")
    files.write_transcripts(out, "id", str(tmp_path / "cha"))
    assert "*PAR:\thi" in next((tmp_path / "cha/id=c1").glob("part*")).read_text()
