"""Models whose fits are Spark aggregates, information by neighbours, and attributions."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from parlance.operators import additive, attribution, encoding, ensemble, evaluate, folds, history, isotonic, models, neighbors, selection, tagging
from parlance.plans import tables as t
from parlance.plans.evaluation_queries import MODELS, _models
from parlance.shared import checkpointed

QUERIES, ORACLE_SQL = {}, {}
#: Columns of the line items and the last values of their bins.
_EDGES = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_discount": [0.02, 0.05, 0.08], "l_tax": [0.03, 0.06]}
_ROUNDS, _RATE = 6, 0.3


def ebm_shapes(spark, sf_dir):
    """Shapes of the predicted score, by line items of which every fifth order lacks its tax."""
    rows = t.scored(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_tax")))
    model = additive.fit_additive(rows, list(_EDGES), "predicted", rounds=_ROUNDS, rate=_RATE, leaves=2, edges=list(_EDGES.values()), tolerance=0.0)
    return model.shapes(spark)


def _additive_sql() -> str:
    names, edges = list(_EDGES), list(_EDGES.values())
    f, keys = range(len(names)), ", ".join(f"b{i}" for i in range(len(names)))
    bins = ", ".join(f"case when {c} is null then 0 else 1 + " + " + ".join(f"({c} > {x}::double)::int" for x in e) + f" end as b{i}" for i, (c, e) in enumerate(_EDGES.items()))
    parts = [t.SCORED.strip(), "s0 as (select * replace (case when l_orderkey % 5 > 0 then l_tax end as l_tax) from sc)"]
    parts.append(f"c0 as materialized (select {keys}, count(*) as n, sum(predicted) as y from (select {bins}, predicted from s0) group by {keys})")
    parts.append(f"r0 as materialized (select {keys}, n, y - n * (select sum(y) / sum(n) from c0) as r from c0)")
    for k in range(_ROUNDS):
        parts.append(f"h{k} as (" + " union all ".join(f"select {i} as f, b{i} as b, sum(r) as s, sum(n) as n from r{k} group by b{i}" for i in f) + ")")
        parts.append(f"w{k} as (select f, b, sum(s) over (partition by f order by b) as sl, sum(n) over (partition by f order by b) as nl, sum(s) over (partition by f) as sa, sum(n) over (partition by f) as na from h{k})")
        parts.append(f"k{k} as materialized (select f, b as cut, {_RATE}::double * sl / nl as lv, {_RATE}::double * (sa - sl) / (na - nl) as rv from w{k} where nl >= 2 and na - nl >= 2 qualify row_number() over (partition by f order by sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) desc, b) = 1)")
        step = " + ".join(f"(select case when r{k}.b{i} <= cut then lv else rv end from k{k} where f = {i})" for i in f)
        parts.append(f"g{k} as materialized (select {keys}, n, r, {step} as g from r{k})")
        parts.append(f"a{k} as materialized (select least(1.0::double, sum(r * g) / sum(n * g * g)) as a from g{k})")
        parts.append(f"r{k + 1} as materialized (select {keys}, n, r - a * n * g as r from g{k}, a{k})")
    ends = lambda e: [("null", "null"), *zip(["null", *e], [*e, "null"], strict=True)]
    parts.append("bn(f, feature, bin, low, high) as (values " + ", ".join(f"({i}, '{c}', {b}, {lo}::double, {hi}::double)" for i, (c, e) in enumerate(zip(names, edges, strict=True)) for b, (lo, hi) in enumerate(ends(e))) + ")")
    value = " + ".join(f"(select a * (case when bin <= cut then lv else rv end) from k{k}, a{k} where k{k}.f = bn.f)" for k in range(_ROUNDS))
    return f"with {', '.join(parts)} select feature, bin::int as bin, low, high, {value} as value from bn"


ORACLE_SQL["ebm_shapes"] = _additive_sql()


def _orders(spark, sf_dir):
    return t.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_custkey") % 7 > 0, F.col("o_totalprice")).alias("price"))


def ordered_target_stats(spark, sf_dir):
    """Of orders by priority and status; every seventh customer's have no price."""
    return encoding.ordered_target_stats(_orders(spark, sf_dir), "o_orderkey", ["o_orderpriority", "o_orderstatus"], "price").drop("price")


_BEFORE = lambda c: f"(partition by {c} order by md5(o_orderkey::varchar || ':42'), o_orderkey rows between unbounded preceding and 1 preceding)"
_STAT = lambda c: f"""case when price is null then (coalesce(sum(price) over (partition by {c}), 0) + m) / (count(price) over (partition by {c}) + 1.0::double)
  else (coalesce(sum(price) over {_BEFORE(c)}, 0) + m) / (count(price) over {_BEFORE(c)} + 1.0::double) end as {c}_ts"""  # noqa: E731
ORACLE_SQL["ordered_target_stats"] = f"""with o as (select o_orderkey, o_orderpriority, o_orderstatus, case when o_custkey % 7 > 0 then o_totalprice end as price from orders)
select o_orderkey, o_orderpriority, o_orderstatus, {_STAT('o_orderpriority')}, {_STAT('o_orderstatus')} from o, (select avg(price) as m from o)"""

def _parts(spark, sf_dir):
    return t.read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.length("p_name").cast("double").alias("name_chars"), "p_retailprice")


def neighbour_information(spark, sf_dir):
    """Of a part's size and the length of its name about its price."""
    return neighbors.neighbour_information(_parts(spark, sf_dir), ["p_size", "name_chars"], "p_retailprice")


_PSI = lambda n: f"(ln({n} + 6.0::double) - 0.5 / ({n} + 6) - 1 / (12.0::double * ({n} + 6) ** 2) + 1 / (120.0::double * ({n} + 6) ** 4) - 1 / (252.0::double * ({n} + 6) ** 6) + 1 / (240.0::double * ({n} + 6) ** 8) - 1 / (132.0::double * ({n} + 6) ** 10) - " + " - ".join(f"1.0::double / ({n} + {i})" for i in range(6)) + ")"
_TEN_DIGITS = lambda x: f"(round({x} * pow(10.0::double, 9 - floor(log10({x})))) / pow(10.0::double, 9 - floor(log10({x}))))"
ORACLE_SQL["neighbour_information"] = f"""with r as (select p_partkey as id, unnest(['p_size', 'name_chars']) as feature, unnest([p_size::double, length(p_name)::double]) as x, p_retailprice::double as y from part),
v as (select *, stddev_pop(x) over (partition by feature) as sx, stddev_pop(y) over (partition by feature) as sy from r),
s as (select id, feature, round(x / {_TEN_DIGITS('sx')} * 4294967296)::bigint as a, round(y / {_TEN_DIGITS('sy')} * 4294967296)::bigint as b from v),
d as materialized (select p.feature, p.id, abs(p.a - q.a) as da, abs(p.b - q.b) as db, p.id <> q.id as other from s p join s q on p.feature = q.feature),
k as materialized (select feature, id, list_sort(list(greatest(da, db)))[3] as r from d where other group by all),
c as (select d.feature, d.id, count(*) filter (case when r > 0 then da < r else da = 0 end) as na, count(*) filter (case when r > 0 then db < r else db = 0 end) as nb from d join k on d.feature = k.feature and d.id = k.id group by all)
select feature, count(*) as n, greatest(0, {_PSI('count(*)')} + {_PSI('3')} - avg({_PSI('na')} + {_PSI('nb')})) as mi from c group by feature"""

_WEIGHTS = {"l_quantity": 1.5, "l_discount": -40.0, "l_tax": 25.0}
#: Two trees over the columns of _WEIGHTS: (feature, threshold, left, right), and leaves' values.
_TREES = ((0, 25.0, (1, 0.05, -8.0, 3.0), (2, 0.04, 5.0, 12.0)), (2, 0.02, (0, 40.0, 1.0, -6.0), (1, 0.03, 4.0, (0, 10.0, -2.0, 9.0))))


def _lines(spark, sf_dir):
    return t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_tax")).alias("l_tax"))


def linear_attributions(spark, sf_dir):
    """Of a linear rule, over the line items; every fifth order lacks its tax."""
    return attribution.linear_attributions(_lines(spark, sf_dir), _WEIGHTS).drop(*_WEIGHTS)


ORACLE_SQL["linear_attributions"] = "with l as (select * replace (case when l_orderkey % 5 > 0 then l_tax end as l_tax) from lineitem) select l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(f"{w}::double * ({c} - avg({c}) over ()) as phi_{c}" for c, w in _WEIGHTS.items()) + " from l"


def _nodes(spark):
    rows = []
    for number, tree in enumerate(_TREES):
        todo, n = [(tree, 0)], 1
        while todo:
            node, at = todo.pop()
            if isinstance(node, tuple):
                rows.append((number, at, node[0], node[1], n, n + 1, None, None, 0.5))
                todo += [(node[2], n), (node[3], n + 1)]
                n += 2
            else:
                rows.append((number, at, None, None, None, None, node, None, 0.5))
    return spark.createDataFrame(rows, attribution.NODES)


def tree_attributions(spark, sf_dir):
    """Of the mean of two trees, with covers counted over the line items."""
    rows, names = _lines(spark, sf_dir), list(_WEIGHTS)
    nodes = attribution.counted_cover(_nodes(spark), rows, names)
    return attribution.tree_attributions(rows, names, nodes).drop(*names)


def _tree_sql() -> str:
    """Shapley values by all subsets: f_{bits} is the expectation when the features of these bits are known."""
    names, shares = list(_WEIGHTS), []

    def expected(node, known, path) -> str:
        if not isinstance(node, tuple):
            return f"{node}::double"
        f, cut, left, right = node
        test = f"coalesce({names[f]} <= {cut}::double, false)"
        name = f"s{len(shares)}"
        shares.append(f"avg({test}::int) filter ({path}) as {name}")
        part = f"{test}::int" if known >> f & 1 else name
        low, high = expected(left, known, f"{path} and {test}"), expected(right, known, f"{path} and not {test}")
        return f"({part} * {low} + (1 - {part}) * {high})"

    games = [f"({' + '.join(expected(tree, bits, 'true') for tree in _TREES)}) / 2 as f_{bits}" for bits in range(8)]
    phi = []
    for j, c in enumerate(names):
        others = [i for i in range(3) if i != j]
        terms = [(sum(1 << i for i in s), {0: 3, 1: 6, 2: 3}[n]) for n in range(3) for s in combinations(others, n)]
        phi.append(" + ".join(f"(f_{b | 1 << j} - f_{b}) / {d}" for b, d in terms) + f" as phi_{c}")
    return f"""with l as (select * replace (case when l_orderkey % 5 > 0 then l_tax end as l_tax) from lineitem), sh as materialized (select {', '.join(shares)} from l),
g as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(games)} from l, sh) select l_orderkey, l_partkey, l_suppkey, l_linenumber, f_0 as base, {', '.join(phi)} from g"""


ORACLE_SQL["tree_attributions"] = _tree_sql()

def least_error_weights(spark, sf_dir):
    """Of two models of the line items."""
    weights, error = ensemble.least_error_weights(_models(t.scored(spark, sf_dir)), "actual", ["m1", "m2"])
    return spark.createDataFrame([(weights["m1"], weights["m2"], error)], "w_m1 double, w_m2 double, mae double")


# the best weight of two models is a median: of the weights that would be right for a row, each as heavy as the models differ
ORACLE_SQL["least_error_weights"] = f"""with {MODELS}, p as (select (actual - m2) / (m1 - m2) as w, abs(m1 - m2) as h from md where m1 <> m2), q as (select w, sum(h) as h from p group by w),
c as (select w, sum(h) over (order by w) as through, sum(h) over () as whole from q), b as (select least(1, greatest(0, min(w))) as w from c where through >= whole / 2)
select any_value(b.w) as w_m1, 1 - any_value(b.w) as w_m2, avg(abs(m1 * b.w + m2 * (1 - b.w) - actual)) as mae from md, b"""


def recursive_elimination(spark, sf_dir):
    """Of three columns of the line items, one at a time."""
    found = selection.recursive_elimination(t.read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", keep=1, step=1)
    return spark.createDataFrame(found, "feature string, rank int")


ORACLE_SQL["recursive_elimination"] = """with r as (select corr(l_quantity, l_discount) as ab, corr(l_quantity, l_tax) as ac, corr(l_discount, l_tax) as bc, corr(l_quantity, l_extendedprice) as a, corr(l_discount, l_extendedprice) as b, corr(l_tax, l_extendedprice) as c from lineitem),
w as (select unnest([{'f': 'l_quantity', 'w': abs(a * (1 - bc * bc) + b * (ac * bc - ab) + c * (ab * bc - ac))}, {'f': 'l_discount', 'w': abs(a * (ac * bc - ab) + b * (1 - ac * ac) + c * (ab * ac - bc))}, {'f': 'l_tax', 'w': abs(a * (ab * bc - ac) + b * (ab * ac - bc) + c * (1 - ab * ab))}]) as x from r),
g as (select arg_min(x.f, x.w) as f from w),
v as (select unnest(case f when 'l_quantity' then [{'f': 'l_discount', 'w': abs(b - c * bc)}, {'f': 'l_tax', 'w': abs(c - b * bc)}] when 'l_discount' then [{'f': 'l_quantity', 'w': abs(a - c * ac)}, {'f': 'l_tax', 'w': abs(c - a * ac)}]
  else [{'f': 'l_quantity', 'w': abs(a - b * ab)}, {'f': 'l_discount', 'w': abs(b - a * ab)}] end) as x from r, g)
select f as feature, 3 as rank from g union all select x.f, row_number() over (order by x.w desc)::int from v"""


def forward_steps(spark, sf_dir):
    """Forward search over two columns of the line items, folds by a hash of the order."""
    fold = F.conv(F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 1), 16, 10).cast("int") % 4
    rows = t.scored(spark, sf_dir).select("l_quantity", (F.col("l_discount") * 100).alias("discount_pct"), "predicted", fold.alias("fold"))
    chosen = selection.forward_selection(rows, ["l_quantity", "discount_pct"], "predicted")
    return spark.createDataFrame([(i, c, e) for i, (c, e) in enumerate(chosen)], "step int, feature string, mae double")


ORACLE_SQL["forward_steps"] = f"""with {t.SCORED}, r as (select l_quantity as a, l_discount * 100 as b, predicted as y, ('0x' || substr(md5(l_orderkey::varchar), 1, 1))::int % 4 as fold from sc),
m as (select f.fold as f, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as bry from r, (select unnest([0, 1, 2, 3]) as fold) f where r.fold <> f.fold group by f.fold),
e as (select avg(abs(my + ay / aa * (a - ma) - y)) as ea, avg(abs(my + bry / bb * (b - mb) - y)) as eb,
  avg(abs(my + (ay * bb - bry * ab) / (aa * bb - ab * ab) * (a - ma) + (bry * aa - ay * ab) / (aa * bb - ab * ab) * (b - mb) - y)) as eab from r join m on m.f = r.fold)
select 0 as step, case when ea <= eb then 'l_quantity' else 'discount_pct' end as feature, least(ea, eb) as mae from e
union all select 1, case when ea <= eb then 'discount_pct' else 'l_quantity' end, eab from e where eab < least(ea, eb)"""


def row_balanced_folds(spark, sf_dir):
    """Orders by customer, with the rows of each priority spread over four folds."""
    return folds.row_balanced_group_folds(t.read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


def svr_metrics(spark, sf_dir):
    """Of a kernel machine of the line items' scores, trained on three folds of the orders, for those of the fourth."""
    rows = t.scored(spark, sf_dir)
    rows = checkpointed(folds.with_folds(rows, folds.group_folds(rows, "l_orderkey", 4), "l_orderkey").withColumn("actual", F.col("predicted")).select("actual", "fold", *_EDGES))
    fitted = models.pipeline(list(_EDGES), models.estimator("svr")[0].setParams(dims=64, C=10.0), "actual").fit(rows.filter("fold <> 0"))
    return evaluate.report(fitted.transform(rows.filter("fold = 0")).select("actual", F.col("prediction").alias("predicted")))


def external_scores(spark, sf_dir):
    """A rule for English documents, by their length, scored raw and calibrated in the other languages."""
    rows = t.read(spark, sf_dir, "documents").join(t.read(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", "lang", "n_chars", (F.col("quality") * 100.0).alias("actual"))
    rule = PipelineModel([SQLTransformer(statement="select *, least(12.0d, greatest(6.0d, floor(log2(n_chars + 1)) + 0.0d)) * 8 as prediction from __THIS__")])
    blocks = isotonic.isotonic_blocks(rule.transform(rows.filter("lang = 'en'")), "actual", "prediction")
    languages = [r["lang"] for r in rows.select("lang").distinct().filter("lang <> 'en'").orderBy("lang").collect()]
    out = None
    for found in models.score_external(rule, rows, "lang", languages, blocks).values():
        out = found if out is None else out.unionByName(found)
    return out.select("doc_id", "lang", "prediction", "calibrated")


ORACLE_SQL["external_scores"] = """with r as (select d.doc_id, lang, least(12.0::double, greatest(6.0::double, floor(log2(n_chars + 1)))) * 8 as prediction, quality * 100.0::double as actual from documents d left join labels using (doc_id)),
xs as (select prediction as x, sum(actual) as s, count(*) as w from r where lang = 'en' and actual is not null group by 1),
p as (select j.x as lo, k.x as hi, (select sum(s) / sum(w) from xs where x between j.x and k.x) as m from xs j join xs k on k.x >= j.x),
n as (select xs.x, p.lo, min(p.m) as m from xs join p on p.lo <= xs.x and p.hi >= xs.x group by 1, 2), f as (select x, max(m) as v from n group by x),
a as (select r.*, (select max(x) from f where x <= prediction) as xa, (select min(x) from f where x >= prediction) as xb from r where lang <> 'en'),
b as (select a.*, (select v from f where x = xa) as va, (select v from f where x = xb) as vb from a)
select doc_id, lang, prediction, case when xa is null then vb when xb is null or xa = xb then va else va + (vb - va) * (prediction - xa) / (xb - xa) end as calibrated from b"""

_SHARES = (0.2, 0.5, 0.8)


def config_sweep(spark, sf_dir):
    """Errors of three settings of a blend, the best first."""
    rows = _models(t.scored(spark, sf_dir))
    run = lambda s: rows.agg(F.avg(F.abs(F.col("m1") * s["share"] + F.col("m2") * (1 - s["share"]) - F.col("actual"))).alias("mae"))
    return history.sweep([{"share": x} for x in _SHARES], run, "mae")


ORACLE_SQL["config_sweep"] = f"with {MODELS} " + " union all ".join(f"select avg(abs(m1 * {x}::double + m2 * {1 - x}::double - actual)) as mae, {i} as setting from md" for i, x in enumerate(_SHARES))

_LETTERS = "case when length({0}) <= 2 then 'DET' when length({0}) <= 4 then 'NOUN' when length({0}) <= 6 then 'VERB' when length({0}) <= 8 then 'ADJ' else 'ADV' end"


def viterbi_tags(spark, sf_dir):
    """Tags of the benchmark's texts, by a tagger of the conversations, in which a word after one of two letters is a noun."""
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    said = t.read(spark, sf_dir, "conversations").select(words.alias("words"))
    said = said.withColumn("tags", F.expr(f"transform(words, (w, i) -> case when i > 0 and length(get(words, i - 1)) <= 2 then 'NOUN' else {_LETTERS.format('w')} end)"))
    model = tagging.train_tagger(said, "words", "tags")
    texts = t.read(spark, sf_dir, "benchmark").select("item_id", words.alias("words"))
    return tagging.viterbi(texts, ["item_id"], "words", model).select("item_id", F.array_join("tags", " ").alias("tags"))


ORACLE_SQL["viterbi_tags"] = f"""with recursive cv as (select row_number() over () as id, list_filter(string_split(lower(text), ' '), lambda w: w <> '') as words from conversations where text is not null),
ct as (select id, words, list_transform(words, lambda w, i: case when i > 1 and length(words[i - 1]) <= 2 then 'NOUN' else {_LETTERS.format('w')} end) as tags from cv),
tk as (select unnest(words) as w, unnest(tags) as t from ct), tg as (select t, count(*) as n from tk group by t), nv as (select count(distinct w) as v from tk),
wc as (select w, t, count(*) as c from tk group by w, t), once as (select t, count(*) as h from wc where w in (select w from wc group by w having sum(c) = 1) group by t),
bg as (select unnest(['<s>'] || tags) as s, unnest(tags || ['</s>']) as t from ct), bc as (select s, t, count(*) as c from bg group by s, t), bs as (select s, sum(c) as total from bc group by s),
tr as materialized (select s.s, t.t, ln((coalesce(c, 0) + 1.0::double) / (coalesce(total, 0) + (select count(*) from tg) + 1)) as lp from (select t as s from tg union all select '<s>') s cross join (select t from tg union all select '</s>') t left join bc on bc.s = s.s and bc.t = t.t left join bs on bs.s = s.s),
dw as (select item_id, unnest(words) as w, generate_subscripts(words, 1) as pos from (select item_id, list_filter(string_split(lower(text), ' '), lambda w: w <> '') as words from benchmark)),
e as materialized (select item_id, pos, tg.t, ln((case when dw.w in (select w from wc) then coalesce(c, 0) else coalesce(h, 0) end + 0.1::double) / (n + 0.1::double * (v + 1))) as lp from dw cross join tg cross join nv left join wc on wc.w = dw.w and wc.t = tg.t left join once on once.t = tg.t),
vt(item_id, pos, t, score, path) as (
  select item_id, pos, e.t, tr.lp + e.lp, [e.t] from e join tr on tr.s = '<s>' and tr.t = e.t where pos = 1
  union all
  select vt.item_id, vt.pos + 1, e.t, max(vt.score + tr.lp) + any_value(e.lp), list_append(arg_max(vt.path, vt.score + tr.lp), e.t) from vt join e on e.item_id = vt.item_id and e.pos = vt.pos + 1 join tr on tr.s = vt.t and tr.t = e.t group by vt.item_id, vt.pos, e.t),
en as (select vt.item_id, vt.path, vt.score + tr.lp as score from vt join tr on tr.s = vt.t and tr.t = '</s>' where vt.pos = (select max(pos) from dw where dw.item_id = vt.item_id))
select item_id, array_to_string(arg_max(path, score), ' ') as tags from en group by item_id"""

QUERIES |= {f.__name__: f for f in (ebm_shapes, ordered_target_stats, neighbour_information, linear_attributions, tree_attributions, least_error_weights, recursive_elimination, forward_steps, row_balanced_folds, svr_metrics, external_scores, config_sweep, viterbi_tags)}
