"""Choice of columns, maps of values, side outputs, run records and reports of attributions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from parlance.functions import headers
from parlance.operators import ensemble, evaluate, folds, history, merge
from parlance.operators import transcripts as tr
from parlance.plans import tables as t

QUERIES, ORACLE_SQL = {}, {}


def english_filter(spark, sf_dir):
    """Documents that name English in a header, or whose stem ends in _en."""
    docs = t.read(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 4 == 0, F.lit("@languages:\tENG\n")).when(F.col("doc_id") % 4 == 1, F.lit("@Languages:\tspa\n")).otherwise(F.lit(""))
    stem = F.concat(F.col("doc_id").cast("string"), F.lit("_"), "lang")
    return docs.filter(headers.is_english(F.concat(head, "text"), stem)).select("doc_id", "lang")


ORACLE_SQL["english_filter"] = "select doc_id, lang from documents where doc_id % 4 = 0 or lang = 'en' or (doc_id % 4 <> 1 and regexp_matches(text, '@[Ll]anguages:\\s*eng'))"


def simplified_groups(spark, sf_dir):
    """Customers with diagnoses by their segment, as patients and controls; what is listed as neither has no group."""
    names = {"AUTOMOBILE": "anomic", "BUILDING": "broca", "FURNITURE": "notaphasicbywab", "MACHINERY": "control"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = t.read(spark, sf_dir, "customer").select("c_custkey", headers.simple_group(F.try_element_at(table, F.col("c_mktsegment"))).alias("g"))
    return rows.groupBy("g").agg(F.count("*").alias("n"))


ORACLE_SQL["simplified_groups"] = """select case c_mktsegment when 'AUTOMOBILE' then 'pwa' when 'BUILDING' then 'pwa' when 'FURNITURE' then 'control' when 'MACHINERY' then 'pwa' end as g, count(*) as n
from customer group by 1"""


def decades_and_genders(spark, sf_dir):
    names = F.array(*map(F.lit, ["teens", "Twenties", "thirties", "fourties", "forties", "fifties", "41", "no age"]))
    sexes = F.array(*map(F.lit, ["male_masculine", "Female", "other", "FEMALE_feminine"]))
    rows = t.read(spark, sf_dir, "orders").select(F.get(names, (F.col("o_orderkey") % 8).cast("int")).alias("age"), F.get(sexes, (F.col("o_custkey") % 4).cast("int")).alias("sex"))
    return rows.groupBy(headers.decade_years(F.col("age")).alias("years"), headers.gender(F.col("sex")).alias("gender")).agg(F.count("*").alias("n"))


ORACLE_SQL["decades_and_genders"] = """select case o_orderkey % 8 when 0 then 18 when 1 then 25 when 2 then 35 when 3 then 45 when 4 then 45 when 5 then 55 when 6 then 41 end as years,
case o_custkey % 4 when 0 then 'male' when 1 then 'female' when 3 then 'female' end as gender, count(*) as n from orders group by 1, 2"""


def path_groups(spark, sf_dir):
    path = F.concat(F.lit("/data/"), F.when(F.col("p_partkey") % 4 == 0, "Controls/").when(F.col("p_partkey") % 4 == 1, "typical/").otherwise("Wernicke/"), "p_name")
    return t.read(spark, sf_dir, "part").groupBy(headers.path_group(path).alias("g")).agg(F.count("*").alias("n"))


ORACLE_SQL["path_groups"] = """select case when p_partkey % 4 < 2 or contains(lower(p_name), 'control') or contains(lower(p_name), 'typical') or contains(lower(p_name), 'healthy') then 'Control' else 'PWA' end as g, count(*) as n
from part group by 1"""


def prefixed_columns(spark, sf_dir):
    """Null counts of the columns that a method's prefixes name."""
    rows = t.read(spark, sf_dir, "lineitem")
    rows = rows.withColumn("l_tax", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_tax")))
    return merge.null_census(rows, merge.prefixed(rows, "l_ta", "l_dis", "l_ship"))


ORACLE_SQL["prefixed_columns"] = """select 'l_tax' as "column", count_if(l_orderkey % 5 = 0 or l_tax is null) as n_null, count(*) as n_rows from lineitem union all select 'l_discount', count_if(l_discount is null), count(*) from lineitem
union all select 'l_shipdate', count_if(l_shipdate is null), count(*) from lineitem"""


def numeric_columns(spark, sf_dir):
    """Sums of the numeric columns whose names hold a keyword; texts and dates of such names are left out."""
    rows = t.read(spark, sf_dir, "lineitem")
    names = merge.numeric_named(rows, "price", "tax", "line", "ship")
    return rows.agg(*[F.sum(c).alias(f"sum_{c}") for c in names])


ORACLE_SQL["numeric_columns"] = "select sum(l_linenumber)::bigint as sum_l_linenumber, sum(l_extendedprice) as sum_l_extendedprice, sum(l_tax) as sum_l_tax from lineitem"


def without_metadata(spark, sf_dir):
    """Customers without the named columns, those it lacks among them."""
    return merge.without(t.read(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_comment"])[0]


ORACLE_SQL["without_metadata"] = "select * exclude (c_name, c_mktsegment) from customer"


def unknown_exclusions(spark, sf_dir):
    """What an exclusion list names and the table lacks."""
    rows = t.read(spark, sf_dir, "customer")
    kept, unknown = merge.without(rows, ["c_name", "c_comment", "c_fax"])
    return kept.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*map(F.lit, unknown))).alias("unknown"), F.lit(len(kept.columns)).alias("n_columns"), "n_rows")


ORACLE_SQL["unknown_exclusions"] = "select unnest(['c_comment', 'c_fax']) as unknown, 4::int as n_columns, n from (select count(*) as n from customer)".replace("n from (select count(*) as n", "n_rows from (select count(*) as n_rows")


def empty_excluded(spark, sf_dir):
    """Documents with labels, without the columns that hold nothing."""
    docs = t.read(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.join(t.read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("nothing", F.lit(None).cast("double")).withColumn("never", F.when(F.col("doc_id") < 0, F.col("quality")))
    return rows.drop(*merge.empty_columns(rows, ["quality", "toxic", "nothing", "never"]))


ORACLE_SQL["empty_excluded"] = "select doc_id, lang, quality, toxic from documents left join labels using (doc_id)"


def synonym_columns(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").withColumn("sentence", F.when(F.col("doc_id") % 2 == 0, F.upper("source")))
    return merge.synonyms(rows, {"said": ["Sentence", "SOURCE"], "language": ["locale", "Lang"], "accent": ["accents", "accent"]}).groupBy("said", "language", "accent").agg(F.count("*").alias("n"))


ORACLE_SQL["synonym_columns"] = "select coalesce(case when doc_id % 2 = 0 then upper(source) end, source) as said, lang as language, null::varchar as accent, count(*) as n from documents group by 1, 2"


def required_columns(spark, sf_dir):
    rows = merge.require_columns(t.read(spark, sf_dir, "events"), ["user_id", "ts", "value"])
    return rows.agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


ORACLE_SQL["required_columns"] = "select count(*) as n, count(value) as n_values from events"


def _recordings(spark, sf_dir):
    c = t.read(spark, sf_dir, "customer")
    line = F.concat(F.lit("@UTF8\n@ID:\teng|corpus|PAR|60;|male|broca||Participant||"), F.col("c_mktsegment"), F.lit("|\n*PAR:\tx\n"))
    return c.select(F.col("c_custkey").alias("patient_id"), F.when(F.col("c_custkey") % 3 > 0, line).otherwise(F.lit("*PAR:\tno header\n")).alias("text"))


def rejected_records(spark, sf_dir):
    """The errors that are written beside the table."""
    return tr.rejected(tr.metadata(_recordings(spark, sf_dir)))[1]


ORACLE_SQL["rejected_records"] = "select c_custkey as patient_id, 'no speaker header' as error from customer where c_custkey % 3 = 0"


def accepted_groups(spark, sf_dir):
    """The table that is left, by group and original name."""
    return tr.rejected(tr.metadata(_recordings(spark, sf_dir)))[0].groupBy("group", "group_original", "sex", "age").agg(F.count("*").alias("n"))


ORACLE_SQL["accepted_groups"] = "select 'pwa' as \"group\", 'broca' as group_original, 'male' as sex, 60::int as age, count(*) as n from customer where c_custkey % 3 > 0"


def rendered_transcripts(spark, sf_dir):
    """Whole conversations as transcript files, their turns joined by blanks."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    rows = t.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"))
    rows = rows.select(F.concat(F.lit("CV_"), F.col("conv_id").cast("string")).alias("participant_id"), "text", F.when(F.col("conv_id") % 3 == 0, "es").when(F.col("conv_id") % 3 == 1, "ca").otherwise("en").alias("language"),
                       F.when(F.col("conv_id") % 2 == 0, "female_feminine").otherwise("male_masculine").alias("sex"), F.when(F.col("conv_id") % 2 == 0, "fourties").otherwise("teens").alias("age"))
    return tr.render(rows, "participant_id", "text", "language", "sex", "age")


ORACLE_SQL["rendered_transcripts"] = """with r as (select 'CV_' || conv_id as participant_id, text, case conv_id % 3 when 0 then 'spa' when 1 then 'cat' else 'eng' end as code,
case when conv_id % 2 = 0 then '45|female' else '18|male' end as who from (select conv_id, string_agg(coalesce(text, ''), ' ' order by turn, coalesce(text, '')) as text from conversations group by conv_id))
select participant_id, '@UTF8' || chr(10) || '@Begin' || chr(10) || '@Languages:' || chr(9) || code || chr(10) || '@Participants:' || chr(9) || 'PAR Participant' || chr(10) || '@ID:' || chr(9) || code || '|clips|PAR|' || who || '|control||Participant||' || chr(10)
|| '@Media:' || chr(9) || participant_id || ', audio' || chr(10) || '*PAR:' || chr(9) || text || chr(10) || '@End' || chr(10) as value from r"""


def baseline_delta(spark, sf_dir):
    """Metrics of the predictions, and their differences to published ones."""
    report = evaluate.report(t.scored(spark, sf_dir)).select("mae", "rmse")
    return evaluate.against_baseline(report, {"mae": 12.5, "rmse": 15.0})


ORACLE_SQL["baseline_delta"] = f"with {t.SCORED}, r as (select avg(abs(predicted - actual)) as mae, sqrt(avg((predicted - actual) * (predicted - actual))) as rmse from sc) select mae, rmse, mae - 12.5::double as delta_mae, rmse - 15.0::double as delta_rmse from r"


def mean_attribution(spark, sf_dir):
    """Mean absolute values of the columns of an attribution table."""
    rows = t.read(spark, sf_dir, "lineitem")
    return ensemble.mean_absolute(rows.select((F.col("l_discount") - 0.05).alias("l_discount"), (F.col("l_tax") - F.col("l_discount")).alias("l_tax"), "l_quantity"))


ORACLE_SQL["mean_attribution"] = """select 'l_discount' as feature, avg(abs(l_discount - 0.05::double)) as value from lineitem union all select 'l_tax', avg(abs(l_tax - l_discount)) from lineitem
union all select 'l_quantity', avg(abs(l_quantity)) from lineitem"""


def fold_importance(spark, sf_dir):
    """Means over folds, the 30 greatest."""
    rows = t.read(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 41).cast("string")).alias("feature"), (F.col("p_partkey") % 5).alias("fold"), F.col("p_retailprice").alias("importance"))
    return ensemble.mean_over_folds(rows)


ORACLE_SQL["fold_importance"] = "select 'f' || p_partkey % 41 as feature, avg(p_retailprice) as importance from part group by 1 order by importance desc, feature limit 30"


def stratified_folds(spark, sf_dir):
    """Orders in five folds, balanced over five bins of the price."""
    return folds.stratified_folds(t.read(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice").groupBy("bin", "fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _turns(k: int, names: int) -> str:
    from zlib import crc32

    return "case bin " + " ".join(f"when {i} then {crc32(str(i).encode()) % k}" for i in range(names)) + " end"


ORACLE_SQL["stratified_folds"] = f"""with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
b as (select o_orderkey, least(4, greatest(0, ceil((o_totalprice - lo) / ((hi - lo) / 5)) - 1))::int as bin from orders, e),
f as (select *, ((row_number() over (partition by bin order by md5(o_orderkey::varchar || ':42'), o_orderkey) - 1 + {_turns(5, 5)}) % 5)::int as fold from b)
select bin, fold, count(*) as n, sum(o_orderkey)::bigint as keys from f group by 1, 2"""


def controls_in_training(spark, sf_dir):
    """Rows to train on and to score by fold: controls are in every training set and never scored."""
    orders = t.read(spark, sf_dir, "orders")
    dealt = folds.with_folds(orders, folds.group_folds(orders, "o_custkey", 4), "o_custkey", always_train=F.col("o_orderstatus") == "P")
    return dealt.groupBy("fold").agg(F.count("*").alias("n_test"), F.count_if(F.col("o_orderstatus") == "P").alias("n_controls"))


ORACLE_SQL["controls_in_training"] = """with s as (select o_custkey, count(*) as n from orders group by 1), i as (select o_custkey, (row_number() over (order by n desc, o_custkey) - 1) % 8 as i from s),
f as (select o_custkey, (case when i < 4 then i else 7 - i end)::int as fold from i), r as (select o_orderstatus, case when o_orderstatus <> 'P' then fold end as fold from orders join f using (o_custkey))
select fold, count(*) as n_test, count_if(o_orderstatus = 'P') as n_controls from r group by 1"""


def run_record(spark, sf_dir):
    """The record of a run whose figures are the predictions' metrics, one row a figure; parameters without model prefixes."""
    found = evaluate.report(t.scored(spark, sf_dir)).select("mae", "rmse").first().asDict()
    row = history.record(spark, {"model": "ridge", "cv": 4}, found, {"model__alpha": 0.5, "svr__C": 10, "seed": 42}, at=datetime(2024, 1, 2))
    return row.select(F.col("config.model").alias("model"), F.col("config.cv").alias("cv"), F.array_join(F.array_sort(F.map_keys("params")), ",").alias("params"), F.explode("results").alias("metric", "value"))


ORACLE_SQL["run_record"] = f"with {t.SCORED}, r as (select avg(abs(predicted - actual)) as mae, sqrt(avg((predicted - actual) * (predicted - actual))) as rmse from sc) select 'ridge' as model, '4' as cv, 'C,alpha,seed' as params, 'mae' as metric, mae as value from r union all select 'ridge', '4', 'C,alpha,seed', 'rmse', rmse from r"

QUERIES |= {f.__name__: f for f in (english_filter, simplified_groups, decades_and_genders, path_groups, prefixed_columns, numeric_columns, without_metadata, unknown_exclusions, empty_excluded, synonym_columns, required_columns, rejected_records, accepted_groups, rendered_transcripts,
                                    baseline_delta, mean_attribution, fold_importance, stratified_folds, controls_in_training, run_record)}
