"""Evaluation of predictions, with line items as the table of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import scores
from parlance.operators import evaluate, folds, merge, ranks
from parlance.plans import tables as t

QUERIES, ORACLE_SQL = {}, {}
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_METRICS = f"""count(*) as n, avg(abs(predicted - actual)) as mae, sqrt(avg((predicted - actual) * (predicted - actual))) as rmse,
  1 - sum((predicted - actual) * (predicted - actual)) / nullif(var_pop(actual) * count(*), 0) as r2, corr(actual, predicted) as r"""
_OFF = f"abs({t.ROUNDED.format('predicted')} - actual)"
_ACC = f"avg(({_OFF} <= 1)::int) as acc_1, avg(({_OFF} <= 5)::int) as acc_5, avg(({_OFF} <= 10)::int) as acc_10, avg(({_OFF} = 0)::int) as acc_exact"
_SEV = f"avg(({t.RIGHT.format('actual')} = {t.RIGHT.format(t.ROUNDED.format('predicted'))})::int) as severity_accuracy"


def regression_metrics(spark, sf_dir):
    return evaluate.report(t.scored(spark, sf_dir))


ORACLE_SQL["regression_metrics"] = f"with {t.SCORED} select {_METRICS}, {_ACC}, {_SEV} from sc"


def metrics_by_group(spark, sf_dir):
    return evaluate.report(t.scored(spark, sf_dir), by=["l_returnflag"])


ORACLE_SQL["metrics_by_group"] = f"with {t.SCORED} select l_returnflag, {_METRICS}, {_ACC}, {_SEV} from sc group by l_returnflag"


def acc_within_k(spark, sf_dir):
    return t.scored(spark, sf_dir).groupBy("l_linestatus").agg(*evaluate.accuracies(F.col("actual"), F.col("predicted")))


ORACLE_SQL["acc_within_k"] = f"with {t.SCORED} select l_linestatus, {_ACC} from sc group by l_linestatus"


def _bins(closed):
    def run(spark, sf_dir):
        y = F.col("actual")
        return t.scored(spark, sf_dir).groupBy(scores.severity(y, closed).alias("severity"), scores.severity_level(y, closed).alias("level")).agg(F.count("*").alias("n"))

    return run


QUERIES |= {"severity_bins_right": _bins("right"), "severity_bins_left": _bins("left")}
for _name, _case in (("right", t.RIGHT), ("left", t.LEFT)):
    ORACLE_SQL[f"severity_bins_{_name}"] = f"""with {t.SCORED}, s as (select {_case.format('actual')} as severity from sc)
select severity, case severity when 'Very Severe' then 0 when 'Severe' then 1 when 'Moderate' then 2 when 'Mild' then 3 end as level, count(*) as n from s group by 1, 2"""


def equal_width_bins(spark, sf_dir):
    rows = t.scored(spark, sf_dir)
    ends = rows.agg(F.min("actual").alias("lo"), F.max("actual").alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).groupBy(scores.equal_width_bin(F.col("actual"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("n"))


ORACLE_SQL["equal_width_bins"] = f"""with {t.SCORED}, e as (select min(actual) as lo, (max(actual) - min(actual)) / 5 as w from sc)
select least(4, greatest(0, ceil((actual - lo) / w) - 1))::int as bin, count(*) as n from sc, e group by 1"""


def prediction_table(spark, sf_dir):
    return evaluate.predictions(t.scored(spark, sf_dir), KEY)


_W = t.ROUNDED.format("predicted")
ORACLE_SQL["prediction_table"] = f"""with {t.SCORED} select {', '.join(KEY)}, actual as qa_real, predicted as qa_pred_cont, {_W}::int as qa_pred_int,
{t.RIGHT.format('actual')} as severity_real, {t.RIGHT.format(_W)} as severity_pred, predicted - actual as error_cont, {_W} - actual as error_int, abs({_W} - actual) as abs_error_int from sc"""


def _matrix(spark, sf_dir):
    rows = t.scored(spark, sf_dir).select(scores.severity(F.col("actual")).alias("a"), scores.severity(scores.to_score(F.col("predicted"))).alias("p"))
    return evaluate.confusion(rows, "a", "p")


def confusion(spark, sf_dir):
    return _matrix(spark, sf_dir)


_LABELS = "lb as (select unnest(['Very Severe', 'Severe', 'Moderate', 'Mild']) as label)"
_CONFUSION = f"""{t.SCORED}, {_LABELS}, cc as (select {t.RIGHT.format('actual')} as a, {t.RIGHT.format(_W)} as p, count(*) as c from sc group by 1, 2),
cm as (select x.label as actual, y.label as predicted, coalesce(c, 0)::bigint as n from lb x cross join lb y left join cc on cc.a = x.label and cc.p = y.label)"""
ORACLE_SQL["confusion"] = f"with {_CONFUSION} select *, coalesce(n / nullif(sum(n) over (partition by actual), 0), 0) as share from cm"


def class_report(spark, sf_dir):
    return evaluate.class_report(_matrix(spark, sf_dir))


ORACLE_SQL["class_report"] = f"""with {_CONFUSION},
b as (select l.label, (select sum(n) from cm where actual = l.label) as support, (select sum(n) from cm where predicted = l.label) as said, (select sum(n) from cm where actual = l.label and predicted = l.label) as hit from lb l),
r as (select label, coalesce(hit / nullif(said, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall, support, hit from b),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from r)
select label, precision, recall, f1, support::bigint as support from f
union all select 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support)::bigint from f
union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::bigint from f
union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::bigint from f"""


def error_groups(spark, sf_dir):
    return evaluate.error_groups(t.scored(spark, sf_dir))


_GROUPS = f"{t.SCORED}, eg as (select *, abs(predicted - actual) as e, case when abs(predicted - actual) <= 5.316::double then 'low' else 'high' end as g from sc)"
ORACLE_SQL["error_groups"] = f"with {_GROUPS} select g as error_group, count(*) as n, avg(e) as mae_mean, stddev_pop(e) as mae_std, avg(actual) as qa_mean, stddev_pop(actual) as qa_std from eg group by g"


def welch_t(spark, sf_dir):
    rows = t.scored(spark, sf_dir).withColumn("g", F.when(F.abs(F.col("predicted") - F.col("actual")) <= evaluate.ERROR_CUT, "low").otherwise("high"))
    return evaluate.welch(rows, "g", "actual", "low", "high")


ORACLE_SQL["welch_t"] = f"""with {_GROUPS}, x as (select avg(actual) filter (where g = 'low') as m0, avg(actual) filter (where g = 'high') as m1, var_samp(actual) filter (where g = 'low') / count(*) filter (where g = 'low') as a,
var_samp(actual) filter (where g = 'high') / count(*) filter (where g = 'high') as b, count(*) filter (where g = 'low') as n0, count(*) filter (where g = 'high') as n1 from eg)
select (m0 - m1) / sqrt(a + b) as t, (a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1)) as df from x"""


def error_histogram(spark, sf_dir):
    return evaluate.histogram(t.scored(spark, sf_dir).withColumn("e", F.round(F.abs(F.col("predicted") - F.col("actual")), 6)), "e")


ORACLE_SQL["error_histogram"] = f"""with {t.SCORED}, e as (select round(abs(predicted - actual), 6) as e from sc), m as (select min(e) as lo, (max(e) - min(e)) / 30 as w from e)
select least(29, floor((e - lo) / w))::int as bin, count(*) as n from e, m group by 1"""


def spearman(spark, sf_dir):
    return evaluate.spearman(t.scored(spark, sf_dir))


ORACLE_SQL["spearman"] = f"""with {t.SCORED}, r as (select rank() over (order by actual) + (count(*) over (partition by actual) - 1) / 2.0::double as a, rank() over (order by predicted) + (count(*) over (partition by predicted) - 1) / 2.0::double as b from sc)
select corr(a, b) as rho from r"""


def improvement(spark, sf_dir):
    rows = _models(t.scored(spark, sf_dir))
    return evaluate.improvement(rows, "actual", ["m1", "m2", "m3"], "ens")


def _models(rows):
    """Three models of different errors, and a blend."""
    rows = rows.withColumns({"m1": F.col("predicted"), "m2": F.col("actual") + (F.col("l_tax") - 0.04) * 300, "m3": F.col("actual") + (F.col("l_linenumber") - 4) * 3.0})
    return rows.withColumn("ens", F.col("m1") * 0.5 + F.col("m2") * 0.25 + F.col("m3") * 0.25)


MODELS = f"""{t.SCORED}, m0 as (select *, predicted as m1, actual + (l_tax - 0.04::double) * 300 as m2, actual + (l_linenumber - 4) * 3.0::double as m3 from sc),
md as (select *, m1 * 0.5::double + m2 * 0.25::double + m3 * 0.25::double as ens from m0)"""
ORACLE_SQL["improvement"] = f"""with {MODELS}, e as (select least(avg(abs(m1 - actual)), avg(abs(m2 - actual)), avg(abs(m3 - actual))) as best_single_mae, avg(abs(ens - actual)) as ensemble_mae from md)
select *, best_single_mae - ensemble_mae as gain, (best_single_mae - ensemble_mae) * 100 / best_single_mae as gain_pct,
case when best_single_mae - ensemble_mae <= 0 then 'no gain' when best_single_mae - ensemble_mae < 0.05::double then 'small gain' else 'gain' end as verdict from e"""


def error_correlates(spark, sf_dir):
    rows = t.scored(spark, sf_dir).withColumn("e", F.col("predicted") - F.col("actual")).join(t.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return evaluate.error_correlates(rows, "e", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"], least=0.002)


ORACLE_SQL["error_correlates"] = f"""with {t.SCORED}, j as (select *, abs(predicted - actual) as e from sc left join orders on l_orderkey = o_orderkey),
c as ({' union all '.join(f"select '{x}' as covariate, corr({x}, e) as r from j" for x in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'o_totalprice'))})
select * from c where abs(r) > 0.002::double"""


def critical_cases(spark, sf_dir):
    errors = t.scored(spark, sf_dir).select(*KEY, "actual", "predicted", (F.col("predicted") - F.col("actual")).alias("error")).withColumn("o_orderkey", F.col("l_orderkey"))
    data = t.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return evaluate.critical_cases(errors, "error", data, ["o_orderkey"], over=9.5)


ORACLE_SQL["critical_cases"] = f"""with {t.SCORED} select {', '.join(KEY)}, actual, predicted, predicted - actual as error, l_orderkey as o_orderkey, o_orderpriority, o_totalprice
from sc left join orders on l_orderkey = o_orderkey where abs(predicted - actual) > 9.5::double"""


def bad_against_all(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").join(t.read(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluate.bad_against_all(rows, F.col("quality") == 0, "n_chars")


ORACLE_SQL["bad_against_all"] = """with a as (select avg(n_chars) filter (where quality = 0) as bad_mean, avg(n_chars) as all_mean from documents left join labels using (doc_id))
select *, case when bad_mean < all_mean then 'bad cases are shorter' else 'bad cases are not shorter' end as verdict from a"""


def short_sample_cap(spark, sf_dir):
    words = F.regexp_count("text", F.lit("[^ \n]+"))
    rows = t.read(spark, sf_dir, "documents").select("doc_id", (F.pmod(F.col("doc_id") * 37, F.lit(101)).cast("double")).alias("p"), words.alias("n"))
    return rows.select("doc_id", scores.capped_for_short(F.col("p"), F.col("n")).alias("capped"))


ORACLE_SQL["short_sample_cap"] = r"""with d as (select doc_id, ((doc_id * 37) % 101)::double as p, length(regexp_extract_all(text, '[^ \n]+')) as n from documents)
select doc_id, case when n < 10 then least(p, 40.0::double) else p end as capped from d"""


def metrics_by_fold(spark, sf_dir):
    rows = t.scored(spark, sf_dir)
    dealt = folds.group_folds(rows, "l_orderkey", 4)
    by = evaluate.report(folds.with_folds(rows, dealt, "l_orderkey"), by=["fold"])
    return evaluate.fold_summary(by)


_SNAKE = """gs as (select {0} as g, count(*) as n from {1} group by 1), gi as (select *, (row_number() over (order by n desc, g) - 1) % 8 as turn from gs),
gf as (select g, n, (case when turn < 4 then turn else 7 - turn end)::int as fold from gi)"""
ORACLE_SQL["metrics_by_fold"] = f"""with {t.SCORED}, {_SNAKE.format('l_orderkey', 'lineitem')}, b as (select fold, avg(abs(predicted - actual)) as mae from sc join gf on l_orderkey = g group by fold)
select avg(mae) as mean, stddev_samp(mae) as std, arg_min(fold, mae) as best_fold from b"""


def group_folds(spark, sf_dir):
    return folds.group_folds(t.read(spark, sf_dir, "orders"), "o_custkey", 4)


ORACLE_SQL["group_folds"] = f"with {_SNAKE.format('o_custkey', 'orders')} select g as o_custkey, n, fold from gf"


def average_rank(spark, sf_dir):
    return ranks.average_ranks(t.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


ORACLE_SQL["average_rank"] = "select o_orderkey, o_totalprice, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0::double as rank from orders"

QUERIES |= {f.__name__: f for f in (regression_metrics, metrics_by_group, acc_within_k, equal_width_bins, prediction_table, confusion, class_report, error_groups, welch_t, error_histogram, spearman, improvement, error_correlates, critical_cases, bad_against_all, short_sample_cap, metrics_by_fold, group_folds, average_rank)}
