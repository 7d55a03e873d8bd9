"""Folds, preparation, selection, models, ensembles and run histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import ensemble, evaluate, folds, history, models, prep, selection
from parlance.plans import tables as t
from parlance.plans.evaluation_queries import MODELS, _models

QUERIES, ORACLE_SQL = {}, {}
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def strat_group_folds(spark, sf_dir):
    return folds.stratified_group_folds(t.read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


# the turn of a stratum is the crc32 of its name modulo 4, which DuckDB has no function for: five names, five values
_TURN = "case stratum when '1-URGENT' then {0} when '2-HIGH' then {1} when '3-MEDIUM' then {2} when '4-NOT SPECIFIED' then {3} when '5-LOW' then {4} end"


def _crc_turns() -> list[int]:
    from zlib import crc32

    return [crc32(x) % 4 for x in (b"1-URGENT", b"2-HIGH", b"3-MEDIUM", b"4-NOT SPECIFIED", b"5-LOW")]


_FOLDS = f"""fc as (select o_custkey, o_orderpriority as stratum, count(*) as n from orders group by 1, 2),
fm as (select o_custkey, arg_min(stratum, (-n, stratum)) as stratum from fc group by 1),
fd as (select o_custkey, stratum, ((row_number() over (partition by stratum order by md5(o_custkey::varchar || ':42'), o_custkey) - 1 + {_TURN.format(*_crc_turns())}) % 4)::int as fold from fm)"""
ORACLE_SQL["strat_group_folds"] = f"with {_FOLDS} select o_custkey, stratum as o_orderpriority, fold from fd"


def fold_distribution(spark, sf_dir):
    orders = t.read(spark, sf_dir, "orders")
    dealt = folds.stratified_group_folds(orders, "o_custkey", "o_orderpriority")
    return folds.fold_distribution(folds.with_folds(orders, dealt, "o_custkey"), "o_orderpriority", 4)


ORACLE_SQL["fold_distribution"] = f"""with {_FOLDS}, r as (select o.o_orderpriority, fold from orders o join fd using (o_custkey)), c as (select fold, o_orderpriority, count(*) as c from r group by 1, 2),
e as (select f.fold, o_orderpriority, total from (select unnest([0, 1, 2, 3])::int as fold) f, (select o_orderpriority, sum(c)::bigint as total from c group by 1)),
x as (select e.fold, e.o_orderpriority, total, coalesce(c, 0) as n from e left join c on c.fold = e.fold and c.o_orderpriority = e.o_orderpriority)
select fold, 'test' as split, o_orderpriority, n from x union all select fold, 'train', o_orderpriority, total - n from x"""


def median_impute(spark, sf_dir):
    rows = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(F.col("l_partkey") % 4 > 0, F.col("l_extendedprice")).alias("x"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_tax")).alias("y"))
    return prep.imputed(rows, prep.medians(rows, ["x", "y"]))


ORACLE_SQL["median_impute"] = """with r as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_partkey % 4 > 0 then l_extendedprice end as x, case when l_suppkey % 3 > 0 then l_tax end as y from lineitem),
m as (select quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my from r) select l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(x, mx) as x, coalesce(y, my) as y from r, m"""


def standard_scale(spark, sf_dir):
    rows = t.read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    return prep.standard_scaled(rows, rows.filter("c_custkey % 2 = 0"), ["c_acctbal", "n"])


ORACLE_SQL["standard_scale"] = """with f as (select avg(c_acctbal) as a, stddev_pop(c_acctbal) as b, avg(c_nationkey) as c, stddev_pop(c_nationkey) as d from customer where c_custkey % 2 = 0)
select c_custkey, (c_acctbal - a) / b as c_acctbal, (c_nationkey - c) / d as n from customer, f"""


def control_znorm(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").join(t.read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("n_chars").cast("double").alias("x"), F.length("text").cast("double").alias("y"), "quality")
    stats = prep.control_stats(rows, ["x", "y"], F.col("quality") == 1)
    return prep.control_scaled(rows, stats).select("doc_id", "x", "y")


ORACLE_SQL["control_znorm"] = """with r as (select doc_id, n_chars::double as x, length(text)::double as y, quality from documents left join labels using (doc_id)),
f as (select avg(x) as a, stddev_samp(x) as b, avg(y) as c, stddev_samp(y) as d from r where quality = 1) select doc_id, (x - a) / b as x, (y - c) / d as y from r, f"""


def _report(spark, sf_dir):
    rows = t.scored(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_tax")))
    return prep.column_report(rows, _NUMBERS, "predicted")


_REPORT = f"""{t.SCORED}, s0 as (select * replace (case when l_orderkey % 5 > 0 then l_tax end as l_tax) from sc),
rp as ({' union all '.join(f"select '{c}' as feature, avg(({c} is null)::int) as null_share, var_pop({c}::double) as variance, corr({c}::double, predicted) as r, count({c}) as n from s0" for c in _NUMBERS)}),
rf as (select feature, null_share, variance, r, r * r * (n - 2) / (1 - r * r) as f from rp)"""


def f_test_topk(spark, sf_dir):
    return prep.top_by_f(_report(spark, sf_dir), 3)


ORACLE_SQL["f_test_topk"] = f"with {_REPORT} select * from rf order by f desc, feature limit 3"


def variance_filter(spark, sf_dir):
    return prep.variance_filter(prep.null_filter(_report(spark, sf_dir), 0.5))


ORACLE_SQL["variance_filter"] = f"with {_REPORT} select * from rf where variance > 0.01::double and null_share < 0.5::double"


def mutual_info_topk(spark, sf_dir):
    return selection.mutual_information(t.scored(spark, sf_dir), _NUMBERS, "predicted").orderBy(F.desc("mi"), "feature").limit(3)


_EDGES = "[" + ", ".join(f"{i / 10}::double" for i in range(1, 10)) + "]"
_AT = lambda c: f"length(list_filter(list_distinct(e_{c}), lambda e: {c}::double > e))"
ORACLE_SQL["mutual_info_topk"] = f"""with {t.SCORED}, ed as (select {', '.join(f'quantile_cont({c}::double, {_EDGES}) as e_{c}' for c in (*_NUMBERS, 'predicted'))} from sc),
bn as (select {', '.join(f'{_AT(c)} as b_{c}' for c in _NUMBERS)}, {_AT('predicted')} as b_y from sc, ed),
jt as ({' union all '.join(f"select '{c}' as feature, b_{c} as bx, b_y as b, count(*) as n from bn group by 2, 3" for c in _NUMBERS)}),
js as (select *, sum(n) over (partition by feature) as s, sum(n) over (partition by feature, bx) as sx, sum(n) over (partition by feature, b) as sy from jt)
select feature, sum(n::double / s * ln(n::double * s / (sx * sy))) as mi from js group by feature order by mi desc, feature limit 3"""


def forward_selection(spark, sf_dir):
    rows = t.scored(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(4)).cast("int"))
    rows = rows.withColumns({c: F.col(c) * 100 for c in ("l_discount", "l_tax")})
    chosen = selection.forward_selection(rows, selection.prefiltered(rows, _NUMBERS, "predicted"), "predicted")
    return spark.createDataFrame([(i, c, e) for i, (c, e) in enumerate(chosen)], "step int, feature string, mae double")


def oof_metrics(spark, sf_dir):
    rows = t.scored(spark, sf_dir)
    dealt = folds.with_folds(rows, folds.group_folds(rows, "l_orderkey", 4), "l_orderkey").select("actual", "fold", *_NUMBERS).drop("l_quantity").withColumn("noisy", F.col("actual") + (F.col("l_discount") - 0.05) * 100)
    found = models.out_of_fold(dealt, ["noisy", "l_tax", "l_extendedprice"], "actual", "ridge", 4)
    return evaluate.report(found)


_XS = "xs as (select round(predicted, 0) as x, avg(actual) as m, count(*) as w from sc group by 1), xc as (select x, sum(w) over (order by x) as cw, sum(m * w) over (order by x) as cs, w, m * w as s from xs)"


def isotonic(spark, sf_dir):
    rows = t.scored(spark, sf_dir).withColumn("predicted", F.round("predicted", 0))
    return models.calibrate(rows).groupBy("predicted").agg(F.first("calibrated").alias("calibrated"))


ORACLE_SQL["isotonic"] = f"""with {t.SCORED}, {_XS}, p as (select j.x as lo, k.x as hi, (k.cs - j.cs + j.s) / (k.cw - j.cw + j.w) as m from xc j join xc k on k.x >= j.x),
n as (select xs.x, p.lo, min(p.m) as m from xs join p on p.lo <= xs.x and p.hi >= xs.x group by 1, 2)
select x as predicted, least(100, greatest(0, max(m))) as calibrated from n group by x"""


def weighted_ensemble(spark, sf_dir):
    rows = _models(t.scored(spark, sf_dir))
    w = ensemble.inverse_error_weights(rows, "actual", ["m1", "m2", "m3"])
    joined = rows.crossJoin(F.broadcast(w))
    own = F.col("m1") * F.col("w_m1") + F.col("m2") * F.col("w_m2") + F.col("m3") * F.col("w_m3")
    y = F.col("actual")
    return joined.agg(F.avg(F.abs(own - y)).alias("mae_inverse"), F.avg(F.abs(ensemble.blend(["m1", "m2", "m3"]) - y)).alias("mae_mean"), F.avg(F.abs(ensemble.blend(["m1", "m2", "m3"], ensemble.FIXED_WEIGHTS) - y)).alias("mae_fixed"))


ORACLE_SQL["weighted_ensemble"] = f"""with {MODELS}, e as (select 1 / avg(abs(m1 - actual)) as a, 1 / avg(abs(m2 - actual)) as b, 1 / avg(abs(m3 - actual)) as c from md)
select avg(abs((m1 * a + m2 * b + m3 * c) / (a + b + c) - actual)) as mae_inverse, avg(abs((m1 + m2 + m3) / 3 - actual)) as mae_mean, avg(abs(ens - actual)) as mae_fixed from md, e"""


def simplex_search(spark, sf_dir):
    rows = _models(t.scored(spark, sf_dir))
    return ensemble.best_weights(ensemble.simplex_errors(rows, "actual", ["m1", "m2", "m3"]))


ORACLE_SQL["simplex_search"] = f"""with {MODELS}, g as (select a / 20.0::double as w0, b / 20.0::double as w1, (20 - a - b) / 20.0::double as w2 from (select unnest(range(21)) as a), (select unnest(range(21)) as b) where a + b <= 20)
select w0, w1, w2, avg(abs(m1 * w0 + m2 * w1 + m3 * w2 - actual)) as mae from md, g group by all order by mae, w0 desc, w1 desc limit 1"""


def seed_spread(spark, sf_dir):
    rows = t.scored(spark, sf_dir)
    seeds = rows.select("l_returnflag", "l_linestatus", F.explode(F.array(*[F.col("predicted") + F.sin(F.col("l_linenumber") * i) for i in (1, 2, 3)])).alias("p"))
    return ensemble.seed_spread(seeds, ["l_returnflag", "l_linestatus"], "p")


ORACLE_SQL["seed_spread"] = f"with {t.SCORED}, s as (select l_returnflag, l_linestatus, predicted + sin(l_linenumber * i) as p from sc, (select unnest([1, 2, 3]) as i)) select l_returnflag, l_linestatus, avg(p) as mean, stddev_pop(p) as std from s group by 1, 2"


def permutation_importance(spark, sf_dir):
    """Of a fixed linear rule, over the line items."""
    rows = t.scored(spark, sf_dir).withColumn("id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).select("id", "l_quantity", "l_discount", "l_tax", "predicted")
    predict = lambda df: df.withColumn("prediction", F.col("l_quantity") * 2 + (F.col("l_discount") - 0.05) * 200)
    return ensemble.permutation_importance(rows, "id", ["l_quantity", "l_discount", "l_tax"], "predicted", predict)


_MOVED = ", ".join(f"coalesce(lag({c}) over w, last_value({c}) over (w rows between unbounded preceding and unbounded following)) as m_{c}" for c in ("l_quantity", "l_discount"))
ORACLE_SQL["permutation_importance"] = f"""with {t.SCORED}, ro as (select *, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber as id from sc),
rr as (select ro.*, r, md5(id || ':' || (42 + r)) as h, dg from ro, (select greatest(0, ceil(ln(count(*) / 5000.0::double) / ln(16.0::double)))::int as dg from sc), (select unnest(range(10)) as r)),
mv as (select r, l_quantity, l_discount, predicted, {_MOVED} from rr window w as (partition by r, substr(h, 1, dg) order by h, id, l_quantity, l_discount, l_tax)),
er as (select r, avg(abs(m_l_quantity * 2 + (l_discount - 0.05::double) * 200 - predicted)) as q, avg(abs(l_quantity * 2 + (m_l_discount - 0.05::double) * 200 - predicted)) as d, avg(abs(l_quantity * 2 + (l_discount - 0.05::double) * 200 - predicted)) as b from mv group by r)
select 'l_quantity' as feature, avg(q - b) as importance_mean, stddev_pop(q - b) as importance_std from er union all select 'l_discount', avg(d - b), stddev_pop(d - b) from er union all select 'l_tax', 0.0::double, 0.0::double"""


def group_importance(spark, sf_dir):
    parts = t.read(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "den_").when(F.col("p_partkey") % 3 == 1, "dys_").otherwise("x_"), F.col("p_partkey").cast("string")).alias("feature"), F.col("p_retailprice").alias("importance_mean"))
    return ensemble.group_importance(parts, {"den_": "DEN", "dys_": "DYS", "lex_": "LEX", "poslm_": "POSLM"})


ORACLE_SQL["group_importance"] = """with p as (select case p_partkey % 3 when 0 then 'DEN' when 1 then 'DYS' else 'OTHER' end as feature_group, p_retailprice as v from part)
select feature_group, sum(v) as sum, avg(v) as mean, count(*) as n, sum(v) * 100 / (select sum(v) from p) as pct from p group by 1"""


def _history(spark, sf_dir):
    return t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("model_type"), F.col("o_orderstatus").alias("selector"), (F.col("o_totalprice") / 1000).alias("mae"))


_HIST = "h as (select o_orderkey as run, o_orderpriority as model_type, o_orderstatus as selector, o_totalprice / 1000 as mae from orders)"


def best_run(spark, sf_dir):
    return history.best_run(_history(spark, sf_dir), "mae", "run", where={"selector": "F"})


ORACLE_SQL["best_run"] = f"with {_HIST} select * from h where selector = 'F' order by mae, run limit 1"


def compare_runs(spark, sf_dir):
    return history.compare(_history(spark, sf_dir), "model_type", "mae")


ORACLE_SQL["compare_runs"] = f"with {_HIST} select model_type, count(mae) as n, avg(mae) as mean, stddev_samp(mae) as std, min(mae) as min, max(mae) as max from h group by 1"


def run_summary(spark, sf_dir):
    return history.summary(_history(spark, sf_dir), ["model_type", "selector"])


ORACLE_SQL["run_summary"] = f"with {_HIST} select 'model_type' as dimension, model_type as value, count(*) as n from h group by 2 union all select 'selector', selector, count(*) from h group by 2"


def history_ensemble(spark, sf_dir):
    return history.top_runs(_history(spark, sf_dir), "mae", "run", 5, ["1-URGENT", "2-HIGH"])


ORACLE_SQL["history_ensemble"] = f"with {_HIST}, b as (select * from h where mae > 0 and model_type in ('1-URGENT', '2-HIGH') order by mae, run limit 5) select *, 1 / mae / (select sum(1 / mae) from b) as weight from b"

QUERIES |= {f.__name__: f for f in (strat_group_folds, fold_distribution, median_impute, standard_scale, control_znorm, f_test_topk, variance_filter, mutual_info_topk, forward_selection, oof_metrics, isotonic, weighted_ensemble, simplex_search, seed_spread, permutation_importance, group_importance, best_run, compare_runs, run_summary, history_ensemble)}
