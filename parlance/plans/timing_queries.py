"""Distributions of values and pauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import stats
from parlance.operators import timing
from parlance.plans import tables as t

QUERIES, ORACLE_SQL = {}, {}


def stats13_by_group(spark, sf_dir):
    return stats.summarise(t.read(spark, sf_dir, "events"), ["user_id"], "value")


ORACLE_SQL["stats13_by_group"] = f"select user_id, {t.stats13('value')} from events group by user_id"


def mad(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select("user_id", "value")
    return stats.deviations(rows, ["user_id"], "value", rows.groupBy("user_id").agg(F.percentile("value", F.lit(0.5)).alias("median")))


ORACLE_SQL["mad"] = "select user_id, mad(value) as mad from events group by user_id"


def _words(spark, sf_dir):
    return timing.tidy_words(t.intervals(spark, sf_dir))


def pause_gaps(spark, sf_dir):
    return timing.pauses(timing.gaps(_words(spark, sf_dir), tie=["event_id"])).select("patient_id", "event_id", "gap", "kind")


ORACLE_SQL["pause_gaps"] = f"with {t.INTERVALS} select patient_id, event_id, gap, kind from ps"


def pause_profile(spark, sf_dir):
    """Each speaker's pauses with the total of words, ordered by speaker."""
    words = _words(spark, sf_dir)
    profile = stats.summarise(timing.pauses(timing.gaps(words, tie=["event_id"])), ["patient_id"], "gap", "pause_")
    totals = words.groupBy("patient_id").agg(F.count("*").alias("n_words"))
    return totals.join(profile, "patient_id", "left").orderBy("patient_id")


ORACLE_SQL["pause_profile"] = f"""with {t.INTERVALS}, pr as (select patient_id, {t.stats13('gap', 'pause_')} from ps group by patient_id)
select n.patient_id, n.n_words, pr.* exclude (patient_id) from (select patient_id, count(*) as n_words from iv group by patient_id) n left join pr on n.patient_id = pr.patient_id"""


def dys_rates(spark, sf_dir):
    words = t.intervals(spark, sf_dir)
    speech = words.groupBy("patient_id").agg((F.sum("value") / 1e2).alias("speech_sec"))
    fillers = words.groupBy("patient_id").agg(F.count_if(F.col("value") < 20).alias("n_fillers"))
    return timing.pause_rates(words, speech, fillers, tie=["event_id"])


ORACLE_SQL["dys_rates"] = f"""with {t.INTERVALS},
sp as (select patient_id, sum(value) / 1e2 as sec, count_if(value < 20)::double as f from iv0 group by patient_id),
n as (select patient_id, count(*)::double as w from iv group by patient_id),
c as (select patient_id, count(*)::double as p, count_if(kind = 'long')::double as lo, {t.stats13('gap', 'dys_pause_sec_')} from ps group by patient_id),
b as (select sp.patient_id, greatest(sec / 60, 1e-6) as m, f, coalesce(w, 1) as w, floor(coalesce(w, 1) * 3.5) as ph, coalesce(p, 0) as p, coalesce(lo, 0) as lo, c.* exclude (patient_id, p, lo)
      from sp left join n using (patient_id) left join c on sp.patient_id = c.patient_id)
select patient_id, f / m as dys_fillers_per_min, f / w as dys_fillers_per_word, case when ph > 0 then f / ph end as dys_fillers_per_phone,
       p / m as dys_pauses_per_min, lo / m as dys_long_pauses_per_min, (p - lo) / m as dys_short_pauses_per_min,
       p / w as dys_pauses_per_word, lo / w as dys_long_pauses_per_word, (p - lo) / w as dys_short_pauses_per_word,
       {', '.join('dys_pause_sec_' + x for x in stats.STATS13)} from b"""


def speaking_time(spark, sf_dir):
    text = t.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("patient_id"), F.size(F.filter(F.split("text", r"[ \n\t\r\f\x0B]+"), lambda x: x != "")).alias("n_text_words"))
    return timing.speaking_time(_words(spark, sf_dir), text)


ORACLE_SQL["speaking_time"] = rf"""with {t.INTERVALS},
tx as (select doc_id::varchar as patient_id, length(list_filter(regexp_split_to_array(text, '[ \n\t\r\f\x0B]+'), lambda x: x <> ''))::int as n_text_words from documents),
tm as (select patient_id, count(*) as n_aligned, sum(end_sec - start_sec) as sec from iv group by patient_id)
select patient_id, coalesce(n_aligned, 0) as n_aligned, n_text_words,
       case when n_aligned is null then 60.0::double when n_aligned / greatest(n_text_words, 1) < 0.3::double then n_text_words / 120.0::double * 60 else sec end as speech_sec
from tx left join tm using (patient_id)"""


def quiet_gap_fraction(spark, sf_dir):
    """Pauses against the speaker's other events as frames, their value less 100 as the level."""
    words = _words(spark, sf_dir)
    found = timing.pauses(timing.gaps(words, tie=["event_id"])).select("patient_id", F.col("event_id").alias("gap_id"), F.col("end_sec").alias("gap_start"), F.col("gap_end"))
    frames = words.select("patient_id", (F.col("start_sec") - 0.05).alias("t"), (F.col("value") - 100).alias("rms_db"))
    return timing.quiet_gaps(found, frames).select("patient_id", "gap_id", "quiet_share", "silent")


ORACLE_SQL["quiet_gap_fraction"] = f"""with {t.INTERVALS},
g as (select patient_id, event_id as gap_id, end_sec as gap_start, lead(start_sec) over (partition by patient_id order by start_sec, end_sec, event_id) as gap_end, gap from gp),
f as (select patient_id, start_sec - 0.05::double as t, value - 100 as rms_db from iv)
select g.patient_id, g.gap_id, avg((rms_db < -35)::int) as quiet_share, coalesce(avg((rms_db < -35)::int) >= 0.8::double, true) as silent
from g left join f on g.patient_id = f.patient_id and f.t >= gap_start and f.t < gap_end
where gap >= 0.15::double and gap < 3.0::double group by g.patient_id, g.gap_id"""


def frame_standardise(spark, sf_dir):
    rows = t.read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return timing.standardise(rows, ["label", "dim"], "x").select("vec_id", "dim", F.round("z", 6).alias("z"))


ORACLE_SQL["frame_standardise"] = """with e as (select vec_id, label, unnest(embedding)::double as x, (generate_subscripts(embedding, 1) - 1)::int as dim from embeddings),
f as (select label, dim, avg(x) as m, stddev_pop(x) as s from e group by label, dim)
select vec_id, e.dim, round((x - m) / case when s > 0 then s else 1.0 end, 6) as z from e join f on e.label = f.label and e.dim = f.dim"""

QUERIES |= {f.__name__: f for f in (stats13_by_group, mad, pause_gaps, pause_profile, dys_rates, speaking_time, quiet_gap_fraction, frame_standardise)}
